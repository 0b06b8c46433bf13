"""The pipeline: stages in order, each decision against its operator's own answer."""

import corpus_pipeline as cp
from llm_cases import docs, none, odd, rows, split_words  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, docs, tmp_path):
    frame, kept = docs, []
    for name, stage in cp.STAGES:
        stage(spark, frame, SMALL).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(after.count())
        if name != "mixture":
            assert after.columns == docs.columns
        frame = after
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixture"]
    assert docs.count() >= kept[0] > kept[1] > 0 and kept[1] >= kept[2] == kept[3] == kept[4]
    toxic_words = {"idiot", "scum", "moron", "pathetic", "worthless", "trash", "disgusting", "clown", "stupid", "loser"}
    ids = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/toxicity").collect()}
    loud = {r.doc_id for r in docs.collect() if sum(w.strip(".,") in toxic_words for w in split_words(r.text)) >= 4}
    assert len(loud & ids) <= 0.2 * len(loud)
    again = cp.run(spark, SMALL)
    assert rows(again) == rows(frame)
    assert {r.doc_id: r.size for r in frame.collect()} == {
        r.doc_id: len(split_words(r.text)) for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}


def test_every_stage_takes_odd_rows(spark, odd, none):
    for frame in (odd, none):
        for name, stage in cp.STAGES:
            out = stage(spark, frame, SMALL)
            n = out.count()
            assert n <= frame.count()
            if name != "mixture":
                assert out.columns == frame.columns
