"""Every query against its SQL oracle, and the shape of the plans."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as contract

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(repr(r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_oracle(spark, db, name):
    df = contract.queries()[name](spark, SF)
    want = db.sql(contract.oracle_sql()[name])
    types = dict(zip(want.columns, map(str, want.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == {
        # SQL sums are wider than the counts they add up
        c: {"HUGEINT": "BIGINT"}.get(t, t) for c, t in types.items()}
    got, expected = canonical(df.toPandas()), canonical(want.df())
    assert len(got) == len(expected) and got == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def plan(spark, name):
    df = contract.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


CORE = [n for n in sorted(contract.oracle_sql()) if not n.startswith("stream_")]


@pytest.mark.parametrize("name", CORE)
def test_core_stays_in_the_jvm_without_cartesian_products(spark, name):
    text = plan(spark, name)
    for operator in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                     "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


def test_text_is_scanned_once(spark):
    for name in ("feed_aspect_filter", "product_complaints", "review_intelligence"):
        assert plan(spark, name).count("regexp_extract_all(") == 1
    assert plan(spark, "etl_pipeline").count("[^a-z]+") == 1


def test_copies_are_cut_before_the_shuffle(spark):
    text = plan(spark, "dedup_clean_text")
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_scans_read_only_what_they_need(spark):
    text = plan(spark, "sentiment_pulse")
    assert "ReadSchema: struct<l_returnflag:string>" in text
    assert "IsNotNull(o_orderkey)" in plan(spark, "reviews_by_prediction")
    assert "TakeOrderedAndProject" in plan(spark, "paginate_reviews")


def test_terms_are_counted_without_a_second_shuffle(spark):
    text = plan(spark, "tfidf_table")
    main = text[:text.index("BroadcastExchange")]
    assert main.count("Exchange hashpartitioning(doc_id") == 1
