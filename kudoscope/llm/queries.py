"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kudoscope.llm.alignment import op12_token_alignment
from kudoscope.llm.chat import op2_preference_format
from kudoscope.llm.decontam import op7_decontamination
from kudoscope.llm.langid import op6_langid
from kudoscope.llm.mixing import op1_mixing
from kudoscope.llm.negatives import op13_hard_negatives
from kudoscope.llm.pii import op3_pii
from kudoscope.llm.polytope import op11_embedding_dedup
from kudoscope.llm.simhash import op8_simhash
from kudoscope.llm.styletree import op5_main_text
from kudoscope.llm.substring import op4_substring_dedup
from kudoscope.llm.toxicity import op9_toxicity
from kudoscope.llm.weighted import op10_weighted_sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mixing, op2_preference_format, op3_pii, op4_substring_dedup, op5_main_text, op6_langid,
        op7_decontamination, op8_simhash, op9_toxicity, op10_weighted_sampling, op11_embedding_dedup,
        op12_token_alignment, op13_hard_negatives)}

ORACLE: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
                FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
        low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, p FROM (
                    SELECT win.doc_id, unnest(range(win.i, win.i + 50)) AS p
                    FROM win JOIN low USING (k) WHERE win.doc_id > low.m)),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
                 FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_embedding_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
        fit AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL
                AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
                AND len(list_filter(x, lambda c: c <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fit AS a JOIN fit AS b USING (label)
                 WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
        reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
        named AS (SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id
                  FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id)
        SELECT *, vec_id = component_id AS kept FROM named""",
    "op13_hard_negatives": r"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)) AS x
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND
                   len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
        pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                        list_dot_product(a.x, b.x)::BIGINT AS s
                 FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positive AS (SELECT * FROM pair WHERE same
                     QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
        SELECT p.anchor_id, p.other AS positive_id, rank::INTEGER AS rank, q.other AS negative_id,
               p.s AS positive_score, q.s AS negative_score
        FROM (SELECT p.anchor_id, p.other AS pos, q.other AS neg,
                     row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY q.s DESC, q.other) AS rank
              FROM positive AS p JOIN pair AS q USING (anchor_id)
              WHERE NOT q.same AND 50 * p.s <= 100 * q.s AND 100 * q.s <= 95 * p.s) AS r
        JOIN positive AS p ON p.anchor_id = r.anchor_id AND p.other = r.pos
        JOIN pair AS q ON q.anchor_id = r.anchor_id AND q.other = r.neg WHERE rank <= 3""",
}
