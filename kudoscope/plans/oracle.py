"""The same queries in plain SQL, written independently of the operators.

Only the fixed values (word lists, phrases, constants) are shared.
"""

from __future__ import annotations

from kudoscope.functions import labels, rules, text as tx
from kudoscope.operators import analytics, etl
from kudoscope.plans import adapters as ad, pipelines
from kudoscope.schemas import LABELS
from kudoscope.sources import readers


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return ", ".join(lit(v) for v in values)


def pick(values, index: str) -> str:
    return f"list_extract([{strings(values)}], CAST(({index}) + 1 AS BIGINT))"


# RE2 has no Unicode \s, so the class is spelled out
WS = (r"\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
      r"\x{000B}\x{001C}-\x{001F}")


def trim(e: str) -> str:
    return f"regexp_replace({e}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def blank(e: str) -> str:
    return f"({trim(e)} = '')"


def no_html(e: str) -> str:
    return f"regexp_replace({e}, '<[^>]+>', ' ', 'g')"


def no_urls(e: str) -> str:
    return f"regexp_replace({e}, 'http[^{WS}]+|www[^{WS}]+|https[^{WS}]+', ' ', 'g')"


def spelled(e: str) -> str:
    for short, long in tx.CONTRACTIONS.items():
        e = f"replace({e}, {lit(short)}, {lit(long)})"
    return e


def letters(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def clean(e: str) -> str:
    plain = letters(spelled(no_urls(no_html(f"lower(coalesce({e}, ''))"))))
    kept = (f"list_filter(string_split({plain}, ' '), "
            f"lambda w: w NOT IN ({strings(tx.REMOVED_WORDS)}))")
    return f"coalesce(array_to_string({kept}, ' '), '')"


def hashed(prefix: str, *parts: str) -> str:
    joined = " || '_' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"'{prefix}' || substr(sha256({joined}), 1, 16)"


def stars_label(e: str) -> str:
    return (f"CASE WHEN {e} BETWEEN 1 AND 2 THEN 'negative' WHEN {e} = 3 THEN 'neutral' "
            f"WHEN {e} BETWEEN 4 AND 5 THEN 'positive' END")


def share(part: str, whole: str) -> str:
    return f"coalesce({part} * 100.0::DOUBLE / nullif({whole}, 0), 0)"


def draw(e: str, seed: int = 42) -> str:
    return f"md5(CAST({e} AS VARCHAR) || '_{seed}')"


def mismatch(r: str = "rating", s: str = "sentiment") -> str:
    return (f"coalesce(({r} >= 4 AND {s} = 'negative') OR ({r} <= 2 AND {s} = 'positive'), false)")


def star_text(e: str) -> str:
    n = f"CAST(greatest(1, least(5, round_even({e}, 0))) AS INTEGER)"
    return f"repeat('★', {n}) || repeat('☆', 5 - {n}) || ' ' || {n} || '/5'"


POLARITY = ("CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'neutral' "
            "ELSE 'positive' END")

R = f"""r AS (
  SELECT {hashed('rev_', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey',
                 'CAST(l_quantity AS BIGINT)', 'CAST(round(l_extendedprice * 100) AS BIGINT)')}
           AS review_id,
         'P' || l_partkey AS product,
         CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS DOUBLE) AS rating,
         {POLARITY} AS sentiment, l_linestatus = 'F' AS verified_purchase,
         CAST(l_linenumber AS INTEGER) AS helpful_votes, l_shipdate AS date_dt,
         {pick(labels.MODELS, 'l_linenumber % 3')} AS model_used,
         {pick(ad.MODEL_REQUESTS, 'l_linenumber - 1')} AS model_requested
  FROM lineitem)"""

LABEL_CLASS = ("CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 0 THEN 'neutral' "
               "WHEN quality = 1 THEN 'positive' END")

T = f"""t0 AS (
  SELECT d.doc_id AS row_order, {pick(ad.PHRASES, 'd.doc_id % 16')} || ' ' || d.text AS text,
         {pick(ad.TITLES, 'd.doc_id % 8')} AS title,
         CAST(1 + d.doc_id % 5 AS DOUBLE) AS rating, d.source AS product,
         d.doc_id % 3 <> 0 AS verified_purchase,
         CAST(d.n_chars % 23 AS INTEGER) AS helpful_votes,
         DATE '2018-01-01' + CAST(d.doc_id * 7 % 2000 AS INTEGER) AS day, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
t AS (
  SELECT * EXCLUDE (quality, toxic, day), CAST(day AS TIMESTAMP) AS date_dt,
         strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS date,
         {hashed('rev_', 'row_order', 'product', 'text')} AS review_id,
         coalesce({LABEL_CLASS}, {stars_label('rating')}) AS sentiment
  FROM t0)"""

L = f"""l AS (
  SELECT d.doc_id AS row_order, d.text, {LABEL_CLASS} AS sentiment,
         {hashed('rev_', 'd.doc_id', 'd.source', 'd.text')} AS review_id
  FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id)"""

PREPARED = f"""{L},
cleaned AS MATERIALIZED (
  SELECT *, {clean('text')} AS clean_text FROM l
  WHERE sentiment IS NOT NULL AND NOT {blank('text')}),
p AS MATERIALIZED (
  SELECT * EXCLUDE (nth) FROM (
    SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY row_order) AS nth
    FROM cleaned WHERE clean_text <> '') WHERE nth = 1)"""

RAW = f"""raw AS (
  SELECT doc_id AS row_order, CAST(n_chars % 7 AS DOUBLE) AS rating,
         {trim("coalesce(text, '')")} AS text, {trim("coalesce(nullif(lang, 'en'), '')")} AS title,
         'u' || doc_id AS user_id,
         CASE WHEN source IN ('src8', 'src9') THEN 'parent_' || source ELSE source END AS product,
         CASE WHEN lang = 'de' THEN 0
              ELSE (1514764800 + doc_id * 7 % 2000 * 86400) * 1000 END AS ms,
         CAST(n_chars % 23 AS INTEGER) AS helpful_votes,
         lang <> 'fr' AND doc_id % 3 <> 0 AS verified_purchase
  FROM documents),
std AS MATERIALIZED (
  SELECT row_order, {hashed('rev_', 'user_id', 'product', 'ms', 'text')} AS review_id, text, title,
         rating, product, 'All_Beauty' AS category, '' AS price,
         CASE WHEN ms = 0 THEN ''
              ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') END AS date,
         helpful_votes, verified_purchase, {stars_label('rating')} AS sentiment,
         'amazon_reviews_2023' AS source, {trim("text || ' ' || title")} AS combined,
         {clean(trim("text || ' ' || title"))} AS clean_text
  FROM raw)"""

PROCESSED = f"""{RAW},
usable AS (
  SELECT *, row_number() OVER (PARTITION BY clean_text ORDER BY row_order) AS nth FROM std
  WHERE sentiment IS NOT NULL AND combined <> '' AND clean_text <> ''),
e AS MATERIALIZED (
  SELECT review_id, text, title, rating, product, category, price, date, helpful_votes,
         verified_purchase, sentiment, source, clean_text FROM usable WHERE nth = 1)"""


def any_of(group) -> str:
    return f"regexp_matches(lt, {lit('|'.join(group))})"


def intelligence(base: str, sentiment: str = "sentiment", keep: str = "true") -> str:
    """CTEs from table ``base`` to table ``intel``."""
    aspects = ", ".join(f"CASE WHEN {any_of(k)} THEN {lit(a)} END"
                        for a, k in rules.ASPECT_KEYWORDS.items())
    rule = " ".join(f"WHEN {any_of(k)} THEN {i}" for i, (_, _, k) in enumerate(rules.ISSUE_RULES))
    rule_aspect = pick([r[0] for r in rules.ISSUE_RULES], "rule")
    rule_issue = pick([r[1] for r in rules.ISSUE_RULES], "rule")
    bad = " ".join(f"WHEN primary_aspect = {lit(a)} THEN {lit(v)}"
                   for a, v in rules.NEGATIVE_ACTIONS.items())
    good = " ".join(f"WHEN primary_aspect = {lit(a)} THEN {lit(v)}"
                    for a, v in rules.POSITIVE_ACTIONS.items())
    return f"""seen AS (
  SELECT *, lower(text) AS lt, coalesce(lower({sentiment}) = 'negative' OR rating <= 2, false) AS neg,
         coalesce(lower({sentiment}) = 'positive' OR rating >= 4, false) AS pos
  FROM {base} WHERE {keep}),
found AS MATERIALIZED (
  SELECT *, list_filter([{aspects}], lambda a: a IS NOT NULL) AS det, CASE {rule} END AS rule,
         {any_of(rules.SEVERE_TERMS)} AS severe, {any_of(rules.REACTION_TERMS)} AS reaction
  FROM seen),
ruled AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN {rule_aspect} END AS rule_aspect,
         CASE WHEN rule IS NULL THEN 'General Feedback' ELSE {rule_issue} END AS issue FROM found),
placed AS (
  SELECT *, coalesce(rule_aspect, det[1], 'Product Quality') AS primary_aspect,
         CASE WHEN rule_aspect IS NOT NULL AND NOT list_contains(det, rule_aspect)
              THEN list_prepend(rule_aspect, det)
              WHEN len(det) = 0 THEN ['General'] ELSE det END AS all_aspects FROM ruled),
intel AS MATERIALIZED (
  SELECT *, CASE WHEN neg AND severe THEN 'HIGH' WHEN neg THEN 'MEDIUM' ELSE 'LOW' END AS priority,
         CASE WHEN neg THEN CASE {bad}
                WHEN contains(issue, 'Reaction') OR reaction THEN {lit(rules.REACTION_ACTION)}
                ELSE {lit(rules.NEGATIVE_ACTION)} END
              WHEN pos THEN CASE {good} ELSE {lit(rules.POSITIVE_ACTION)} END
              ELSE {lit(rules.NEUTRAL_ACTION)} END AS suggested_action
  FROM placed)"""


NEG = intelligence("t", "'negative'", "sentiment = 'negative'")


def complaints(keys: str = "") -> str:
    """CTEs from ``intel`` to ``groups`` per ``keys`` (with trailing comma) and aspect."""
    return f"""issue_n AS (
  SELECT {keys} primary_aspect AS aspect, issue, count(*) AS n FROM intel
  WHERE issue <> 'General Feedback' GROUP BY ALL),
top_issue AS (
  SELECT {keys} aspect, issue FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} aspect ORDER BY n DESC, issue) AS k
    FROM issue_n) WHERE k = 1),
base AS (
  SELECT {keys} primary_aspect AS aspect, count(*) AS count,
         count(*) FILTER (priority = 'HIGH') AS high_priority,
         arg_min(suggested_action, row_order) AS action FROM intel GROUP BY ALL),
groups AS (
  SELECT base.*, coalesce(top_issue.issue, 'General Complaints') AS issue
  FROM base LEFT JOIN top_issue USING ({keys} aspect))"""


SUMMARY = f"""{T},
{NEG},
{complaints()},
shared AS (SELECT *, count * 100.0::DOUBLE / sum(count) OVER () AS share_pct FROM groups),
summary AS (
  SELECT aspect, count, share_pct, issue,
         CASE WHEN share_pct >= 20 OR (aspect IN ({strings(analytics.URGENT_ASPECTS)})
                AND regexp_matches(lower(issue), {lit('|'.join(analytics.URGENT_ISSUE_TERMS))}))
              THEN 'HIGH' WHEN share_pct >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
         action, high_priority FROM shared)"""

PRODUCT = f"""{T},
{NEG},
{complaints('product,')},
shared AS (
  SELECT *, count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY product) AS share_pct FROM groups),
complaint AS (
  SELECT product, aspect, count, share_pct, issue,
         CASE WHEN share_pct >= 25 OR (count >= 3
                AND regexp_matches(lower(issue), {lit('|'.join(analytics.CRITICAL_ISSUE_TERMS))}))
              THEN 'HIGH' WHEN share_pct >= 12 OR count >= 2 THEN 'MEDIUM' ELSE 'LOW' END
           AS priority, action, high_priority FROM shared)"""


def kpis(base: str) -> str:
    shares = ", ".join(f"count(*) FILTER (sentiment = '{c}') AS {c}_count" for c in LABELS)
    pcts = ", ".join(f"{c}_count * 100.0::DOUBLE / total AS {c}_pct" for c in LABELS)
    return f"""k0 AS (
  SELECT product, count(*) AS total, {shares}, avg(rating) AS avg_rating,
         count(*) FILTER (verified_purchase) AS v, min(date_dt) AS first_date,
         max(date_dt) AS last_date FROM {base} GROUP BY product),
k AS (SELECT * EXCLUDE (v), {pcts}, v * 100.0::DOUBLE / total AS verified_pct FROM k0)"""


def distribution(base: str) -> str:
    """CTEs ``cd`` and ``rd``: class and rating distribution of ``base``."""
    classes = ", ".join(f"('{c}')" for c in LABELS)
    return f"""cd AS (
  SELECT c.sentiment, count({base}.sentiment) AS count,
         {share(f'count({base}.sentiment)', f'(SELECT count(sentiment) FROM {base})')} AS percentage
  FROM (VALUES {classes}) c(sentiment) LEFT JOIN {base} ON {base}.sentiment = c.sentiment GROUP BY 1),
rd AS (
  SELECT rating, count(*) AS count,
         count(*) * 100.0::DOUBLE / (SELECT count(rating) FROM {base}) AS percentage
  FROM {base} WHERE rating IS NOT NULL GROUP BY rating)"""


DISTRIBUTION_ENTRIES = """
SELECT 'class_count' AS section, sentiment AS name, CAST(count AS DOUBLE) AS value FROM cd
UNION ALL SELECT 'class_percentage', sentiment, round(percentage, 2) FROM cd
UNION ALL SELECT 'rating_count', CAST(rating AS VARCHAR), CAST(count AS DOUBLE) FROM rd
UNION ALL SELECT 'rating_percentage', CAST(rating AS VARCHAR), round(percentage, 2) FROM rd"""


def judged(where: str = "true") -> str:
    """CTEs from ``r`` to ``pc`` (per model and class) and ``m`` (metrics per model)."""
    classes = ", ".join(f"('{c}')" for c in LABELS)
    return f"""{R},
j AS (SELECT model_used AS model_name, {stars_label('rating')} AS actual, sentiment AS predicted
      FROM r WHERE {where}),
pc0 AS (
  SELECT model_name, c.label, count(*) FILTER (actual = label AND predicted = label) AS tp,
         count(*) FILTER (predicted = label) AS claimed, count(*) FILTER (actual = label) AS support
  FROM j CROSS JOIN (VALUES {classes}) c(label) WHERE actual IS NOT NULL GROUP BY ALL),
pc AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(claimed, 0), 0) AS precision,
         coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall,
         coalesce(2.0::DOUBLE * tp / nullif(claimed + support, 0), 0) AS f1 FROM pc0),
m AS (
  SELECT model_name, round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy,
         {', '.join(f"round(avg({x}) FILTER (claimed + support > 0), 6) AS macro_{x}, "
                    f"round(sum({x} * support) / sum(support), 6) AS weighted_{x}"
                    for x in ('precision', 'recall', 'f1'))}
  FROM pc GROUP BY model_name)"""


def quota(base: str) -> str:
    """CTE ``quota(sentiment, q)``: test rows per class of ``base``, largest remainder."""
    return f"""sizes AS (
  SELECT sentiment, count(*)::HUGEINT AS c, (SELECT count(*) FROM {base})::HUGEINT AS n
  FROM {base} GROUP BY sentiment),
dealt AS (
  SELECT *, n - CAST(ceil(round(n * 0.2, 6)) AS HUGEINT) AS n_train FROM sizes),
parts AS (SELECT *, c * n_train // n AS base_n, c * n_train % n AS rest FROM dealt),
quota AS (
  SELECT sentiment, c - base_n - CASE WHEN row_number() OVER (ORDER BY rest DESC, sentiment)
           <= n_train - sum(base_n) OVER () THEN 1 ELSE 0 END AS q FROM parts),
split AS MATERIALIZED (
  SELECT b.*, row_number() OVER (PARTITION BY b.sentiment ORDER BY {draw('review_id')}) <= q AS is_test
  FROM {base} b JOIN quota USING (sentiment))"""


def words_of(e: str) -> str:
    return f"list_filter(string_split({e}, ' '), lambda w: length(w) >= 2)"


def grams(tokens: str) -> str:
    return (f"list_concat({tokens}, list_transform(range(1, len({tokens})), "
            f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]))")


COEFS = f"""{PREPARED},
pw AS (SELECT sentiment, unnest(list_distinct({words_of('clean_text')})) AS term FROM p),
df AS (
  SELECT term, count(*) AS df, {', '.join(f"count(*) FILTER (sentiment = '{c}') AS {c}" for c in LABELS)}
  FROM pw GROUP BY term ORDER BY df DESC, term LIMIT 10000),
sz AS (SELECT count(*) AS n,
       {', '.join(f"count(*) FILTER (sentiment = '{c}') AS n_{c}" for c in LABELS)} FROM p),
coefs AS MATERIALIZED (
  {' UNION ALL '.join(f"SELECT '{c}' AS class, term, round(ln(({c} + 1)::DOUBLE / (n_{c} + 2)) - ln((df + 1)::DOUBLE / (n + 2)), 6) AS coef FROM df, sz" for c in LABELS)}),
diffs AS MATERIALIZED (
  SELECT term, round(max(coef) FILTER (class = 'positive') - max(coef) FILTER (class = 'negative'), 6)
           AS diff FROM coefs GROUP BY term)"""

KEYWORDS = f"""{COEFS},
kw AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY coef DESC, term) AS rank
                 FROM coefs) WHERE rank <= 10)"""

WORD = r"[\p{L}\p{N}_]+"
TOKEN = rf"{WORD}|[^\p{{L}}\p{{N}}_{WS}]|[{WS}]+"

TOKENS = f"""{COEFS},
tk0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS ts FROM documents),
tk1 AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS position FROM tk0),
tk AS (SELECT doc_id, CAST(position AS INTEGER) AS position, token, diff,
              CASE WHEN diff > 0.8 THEN 'positive' WHEN diff < -0.8 THEN 'negative' ELSE 'none' END
                AS band
       FROM tk1 LEFT JOIN diffs ON diffs.term = lower(token))"""

PLACES = f"""pl AS (
  SELECT 'place_' || conv_id AS place_id,
         CASE WHEN conv_id % 4 <> 3 THEN 'Place ' || conv_id ELSE 'Unknown Place' END AS name,
         text AS body, role, conv_id, turn,
         CASE WHEN turn <> 6 THEN CAST(1 + turn % 5 AS VARCHAR) END AS stars,
         CASE WHEN role = 'user' THEN 'author ' || conv_id END AS author FROM conversations),
un AS MATERIALIZED (
  SELECT {hashed('g_', 'place_id', f"coalesce(author, '{readers.ANONYMOUS_AUTHOR}')", trim('body'))}
           AS review_id, place_id, {trim('body')} AS text, '' AS title,
         coalesce(CAST(stars AS DOUBLE), 5.0::DOUBLE) AS rating, name AS product,
         '{readers.PLACE_CATEGORY}' AS category, '' AS price,
         CASE WHEN turn < 2 THEN 'a week ago' ELSE '2024-05-01T00:00:00Z' END AS date,
         0 AS helpful_votes, false AS verified_purchase, '{readers.PLACE_SOURCE}' AS source,
         coalesce(author, '{readers.ANONYMOUS_AUTHOR}') AS author_name,
         CASE WHEN role <> 'user' THEN 'https://maps.example/a' ELSE '' END AS author_uri,
         '' AS author_photo_uri, '' AS google_maps_uri
  FROM pl WHERE NOT {blank('body')})"""

LINES = f"""ln0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ln1 AS (SELECT doc_id, unnest(ls) AS text,
               CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no FROM ln0),
ln AS (SELECT *, {pick(LABELS, 'length(text) % 3')} AS sentiment,
              (length(text) % 100) / 100.0::DOUBLE AS confidence, {blank('text')} AS is_blank FROM ln1),
gate AS (SELECT doc_id, line_no, text, CASE WHEN is_blank THEN 'neutral' ELSE sentiment END
                AS sentiment, CASE WHEN NOT is_blank THEN confidence END AS confidence,
                NOT is_blank AS logged FROM ln)"""

STORED = f"""sr AS (
  SELECT o_orderkey AS review_id, o_orderpriority || ' ' || o_orderstatus AS text,
         CASE WHEN o_orderstatus <> 'P' THEN 'P' || (o_custkey % 50) END AS product FROM orders),
sp AS (
  SELECT l_orderkey AS review_id, {POLARITY} AS sentiment,
         round(l_discount * 10, 4) AS confidence, {pick(labels.MODELS, 'l_linenumber % 3')}
           AS model_used FROM lineitem)"""

STORED_METRICS = """sm AS (
  SELECT model_name, accuracy, macro_precision AS precision, macro_recall AS recall, macro_f1 AS f1,
         CASE WHEN model_name <> 'linearsvc' THEN macro_precision END AS macro_precision,
         CASE WHEN model_name <> 'linearsvc' THEN macro_recall END AS macro_recall,
         CASE WHEN model_name <> 'linearsvc' THEN macro_f1 END AS macro_f1,
         weighted_precision, weighted_recall, weighted_f1 FROM m)"""

EVENT_SENTIMENT = ("CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' "
                   "WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END")


def pct_text(e: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f%%', round({e}, {digits}))"


def thousands(e: str) -> str:
    return f"format('{{:,}}', {e})"


def _narrative() -> str:
    pos, neu, neg = (pct_text(f"{c}_pct") for c in ("positive", "neutral", "negative"))
    total, n_neg = thousands("total"), thousands("negative_count")
    phrase = (f"CASE WHEN s2 >= 15 THEN a1 || ' (' || {pct_text('s1')} || ') and ' || a2 || ' (' || "
              f"{pct_text('s2')} || ')' ELSE a1 || ', accounting for ' || {pct_text('s1')} || "
              f"' of negative reviews (primarily ' || i1 || ')' END")
    return f"""WITH {PRODUCT}, {kpis('t')},
ro AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY count DESC, aspect) AS rk
       FROM complaint),
tops AS (SELECT product, max(aspect) FILTER (rk = 1) AS a1, max(share_pct) FILTER (rk = 1) AS s1,
                max(issue) FILTER (rk = 1) AS i1, max(aspect) FILTER (rk = 2) AS a2,
                max(share_pct) FILTER (rk = 2) AS s2 FROM ro GROUP BY product),
ph AS (SELECT k.*, {phrase} AS phrase FROM k LEFT JOIN tops USING (product))
SELECT product, CASE WHEN negative_count = 0 THEN
  'Customer sentiment is exclusively favorable across ' || {total} || ' reviews (' || {pos}
  || ' positive, ' || {neu} || ' neutral) with zero negative complaints recorded in the dataset.'
WHEN positive_pct >= 70 THEN
  'Customer sentiment is predominantly positive (' || {pos} || '). Negative feedback (' || {neg}
  || ', ' || {n_neg} || ' reviews) is most concentrated around ' || phrase || '.'
WHEN negative_pct >= 30 THEN
  'Negative feedback represents a substantial share (' || {neg} || ', ' || {n_neg}
  || ' reviews) for this product. Friction is primarily concentrated in ' || phrase || '.'
ELSE
  'Customer feedback reflects a balanced distribution across ' || {total} || ' reviews (' || {pos}
  || ' positive, ' || {neu} || ' neutral, ' || {neg}
  || ' negative). Negative feedback is most concentrated in ' || phrase || '.' END AS narrative
FROM ph"""


INTEL = f"WITH {T}, {intelligence('t')}"
LABEL_CASE = " ".join(f"WHEN lower(raw) = '{a}' THEN '{b}'" for a, b in labels.SCORER_LABELS.items())
ROUTE = (f"CASE WHEN model_requested IN ({strings(labels.MODELS)}) THEN model_requested "
         f"WHEN lower(model_requested) = 'distilbert' THEN 'distilbert' "
         f"ELSE 'balanced_logistic_regression' END")
DISPLAY = " ".join(f"WHEN model_name = '{a}' THEN '{b}'" for a, b in labels.MODEL_NAMES.items())
COSINE = "list_cosine_similarity(embedding::DOUBLE[], centre)"

# The stored models: c0 to c8 are the coefficients of the classes, model by model.
STORED_MODELS = f"""{COEFS},
mt AS MATERIALIZED (
  SELECT term, round(ln((n + 1)::DOUBLE / (df + 1)) + 1, 6) AS idf, {", ".join(
    f"round(round(ln(({c} + 1)::DOUBLE / (n_{c} + 2)) - ln((df + 1)::DOUBLE / (n + 2)), 6) * {factor}::DOUBLE, 6)"
    f" AS c{3 * h + k}" for h, (_, factor, _) in enumerate(ad.STAND_INS) for k, c in enumerate(LABELS))}
  FROM df, sz)"""


def scored(base: str, doc: str, cleaned: str | None = None) -> str:
    """CTEs from table ``base`` to ``sa``: its rows with label l0 to l2 and confidence p0 to p2."""
    sums = ", ".join(f"sum(w * c{i}) AS s{i}" for i in range(9))
    own = {h: ", ".join(f"coalesce(s{3 * h + k} / norm, 0) + {b}::DOUBLE" for k, b in enumerate(bias))
           for h, (_, _, bias) in enumerate(ad.STAND_INS)}
    labels_ = ", ".join(
        f"CASE WHEN clean_text = '' THEN 'neutral' ELSE list_extract([{strings(LABELS)}], "
        f"list_position(m{h}, list_max(m{h}))) END AS l{h}" for h in range(3))
    shares = ", ".join(
        (f"CASE WHEN clean_text <> '' THEN round(1 / list_sum(list_transform(m{h}, lambda x: exp(x - list_max(m{h})))), 4) END"
         if name != "linearsvc" else "NULL::DOUBLE") + f" AS p{h}" for h, (name, _, _) in enumerate(ad.STAND_INS))
    return f"""sc AS MATERIALIZED (SELECT *{'' if cleaned else f", {clean('text')} AS clean_text"} FROM {base}),
sg AS (SELECT {doc}, term, count(*) AS tf FROM (
  SELECT {doc}, unnest({words_of('clean_text')}) AS term FROM (SELECT DISTINCT {doc}, clean_text FROM sc)) GROUP BY ALL),
sx AS (SELECT {doc}, tf * idf AS w, mt.* FROM sg JOIN mt USING (term)),
ss AS (SELECT {doc}, sqrt(sum(w * w)) AS norm, {sums} FROM sx GROUP BY {doc}),
sm AS (SELECT sc.*, {', '.join(f'[{v}] AS m{h}' for h, v in own.items())} FROM sc LEFT JOIN ss USING ({doc})),
sa AS MATERIALIZED (SELECT * EXCLUDE (m0, m1, m2), {labels_}, {shares} FROM sm)"""


BALANCED = "l1 AS sentiment, p1 AS confidence"
NUMBER = "CASE " + " ".join(f"WHEN model_used = '{name}' THEN {{}}{h}" for h, (name, _, _) in enumerate(ad.STAND_INS)) + " END"
LINEAR_ROUTE = f"CASE WHEN route = 'distilbert' THEN '{labels.DEFAULT_MODEL}' ELSE route END"
# from the judged rows j on
METRICS = judged()[judged().index("pc0 AS ("):]

ORACLE: dict[str, str] = {
    # ------------------------------------------------------------ sources
    "raw_json_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events "
                      "WHERE json_valid(props)",
    "source_row_count": "SELECT count(*) AS total_rows FROM events",
    "load_reviews": f"""
SELECT d.doc_id AS row_order, CASE WHEN lang <> 'fr' THEN source ELSE '' END AS text,
       CASE WHEN toxic = 1 THEN lang ELSE '' END AS title,
       CASE WHEN quality = 1 THEN 4.5::DOUBLE ELSE 5.0::DOUBLE END AS rating,
       coalesce(CAST(toxic AS INTEGER), 0) AS helpful_votes,
       coalesce(quality = 1, false) AS verified_purchase,
       coalesce(nullif(source, 'src8'), 'Unknown') AS product,
       coalesce({LABEL_CLASS}, 'neutral') AS sentiment,
       CASE WHEN toxic = 0 THEN '2020-02-29 12:00:01' END AS date_dt
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "raw_jsonl_roundtrip": """
SELECT 'd' || doc_id AS asin, list_extract(['5', '4.0', '3.0', 'abc', NULL, '2'], doc_id % 6 + 1) AS rating,
       text, CAST(list_extract([1600000000000, 1600000000000, 1600000000000, -1, 1, 0], doc_id % 6 + 1)
                  AS BIGINT) AS timestamp,
       CAST(list_extract([3, 3, 3, -1, -1, 7], doc_id % 6 + 1) AS INTEGER) AS helpful_vote,
       list_extract([true, true, false, true, NULL, false], doc_id % 6 + 1) AS verified_purchase
FROM documents WHERE doc_id % 10 <> 7""",
    "raw_line_counts": """
SELECT count(*) AS source_lines, count(*) FILTER (doc_id % 10 = 7) AS undecodable FROM documents""",
    "reviews_csv_roundtrip": """
SELECT CAST(doc_id AS VARCHAR) AS review_id, coalesce(text, '') AS text,
       list_extract([4.0::DOUBLE, 3.0, 5.0, 1.0], doc_id % 4 + 1) AS rating,
       CAST(list_extract([3, 3, 0, 0], doc_id % 4 + 1) AS INTEGER) AS helpful_votes,
       list_extract([true, true, false, true], doc_id % 4 + 1) AS verified_purchase,
       list_extract(['2020-02-29 12:00:01', '2020-02-29 12:00:01', '2020-02-29 00:00:00', NULL], doc_id % 4 + 1)
         AS date_dt FROM documents""",
    "place_payload_mixed_types": """
SELECT 'm' || conv_id || '_' || turn AS place_id, r.text, r.stars,
       CASE WHEN turn % 3 = 2 THEN 'Unknown Place' ELSE 'Place' END AS product,
       CASE WHEN turn % 3 < 2 THEN 4.5::DOUBLE END AS rating, CAST(7 AS INTEGER) AS user_rating_count
FROM conversations, unnest([{'text': 'plain ' || turn, 'stars': 5.0::DOUBLE},
                            {'text': 'original ' || turn, 'stars': 4.0::DOUBLE},
                            {'text': 'object ' || turn, 'stars': 3.0::DOUBLE}]) AS u(r)""",
    "dataset_summary": f"WITH {PROCESSED}, {distribution('e')} {DISTRIBUTION_ENTRIES}",
    "batch_csv_source": "SELECT CAST(quality AS VARCHAR) AS text FROM documents JOIN labels "
                        "USING (doc_id) WHERE quality IS NOT NULL",
    "batch_lines_source": f"WITH {LINES} SELECT doc_id, line_no, {trim('text')} AS text FROM ln "
                          "WHERE NOT is_blank",
    "product_audit_export": f"WITH {T} SELECT product, rating, sentiment, verified_purchase, title, "
                            "text FROM t",
    "catalogue_audit": f"WITH {T} SELECT product, count(*) AS rows_listed, count(*) AS rows_read, "
                       "count(*) FILTER (verified_purchase) AS verified, "
                       "CAST(sum(length(text)) AS BIGINT) AS text_length FROM t GROUP BY product",
    "place_payload_flatten": f"""WITH {PLACES}
SELECT place_id, name, '' AS maps_uri, CASE WHEN role <> 'system' THEN body END AS body,
       CASE WHEN role = 'system' THEN body END AS original, stars AS rating, author,
       '2024-05-01T00:00:00Z' AS publish_time FROM pl""",
    "place_search_flatten": """
SELECT * FROM (
  SELECT CAST(c_nationkey AS VARCHAR) AS query, CAST(c_custkey AS VARCHAR) AS place_id,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name ELSE 'Unknown Place' END AS name,
         CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS address,
         CASE WHEN c_acctbal > 1000 THEN 7 ELSE 0 END AS user_rating_count,
         CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_custkey AS VARCHAR))
              AS INTEGER) AS rank
  FROM customer) WHERE rank <= 10""",
    "payload_status_class": """
SELECT event_id, CAST(status AS INTEGER) AS status, status = 200 AS success,
       CASE status WHEN 403 THEN 'AUTHENTICATION_OR_PERMISSION_ERROR' WHEN 404 THEN 'INVALID_PLACE_ID'
            WHEN 429 THEN 'QUOTA_EXCEEDED' WHEN 500 THEN 'DETAILS_FETCH_FAILED' END AS details_error,
       CASE status WHEN 403 THEN 'AUTHENTICATION_OR_PERMISSION_ERROR' WHEN 404 THEN 'API_ERROR'
            WHEN 429 THEN 'QUOTA_EXCEEDED' WHEN 500 THEN 'API_ERROR' END AS search_error
FROM (SELECT event_id, list_extract([200, 403, 404, 429, 500], event_id % 5 + 1) AS status
      FROM events)""",
    "prediction_log": f"""WITH {LINES},
lg AS (SELECT doc_id || '_' || line_no AS review_id, sentiment, confidence FROM ln WHERE NOT is_blank)
SELECT {hashed('pred_', 'review_id', "'linearsvc'", "'2024-01-01 00:00:00.000000'")} AS prediction_id, review_id, sentiment,
       confidence, 'linearsvc' AS model_requested, 'linearsvc' AS model_used FROM lg""",
    "metrics_read": f"""WITH {judged()}, {STORED_METRICS}
SELECT * REPLACE (coalesce(macro_precision, precision) AS macro_precision,
                  coalesce(macro_recall, recall) AS macro_recall, coalesce(macro_f1, f1) AS macro_f1)
FROM sm""",
    "metrics_upsert": f"""WITH old AS (WITH {judged('verified_purchase')}
  SELECT model_name, accuracy, macro_f1 AS f1, NULL::DOUBLE AS macro_f1, NULL::DOUBLE AS weighted_f1
  FROM m),
new AS (WITH {judged('NOT verified_purchase')}
  SELECT model_name, accuracy, macro_f1 AS f1, macro_f1, weighted_f1 FROM m
  WHERE model_name <> 'logistic_regression')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE model_name NOT IN (SELECT model_name FROM new)""",
    # ------------------------------------------------------------ projections, filters
    "rating_to_sentiment": f"SELECT rating, count(*) AS rows, {stars_label('rating')} AS sentiment "
                           "FROM (SELECT l_quantity / 8 AS rating FROM lineitem) GROUP BY rating",
    "combined_text": f"WITH {RAW} SELECT row_order, combined FROM std WHERE combined <> ''",
    "legacy_normalise": "SELECT doc_id AS row_order, text || ' ' || coalesce(nullif(lang, 'en'), '') "
                        "AS text, source AS sentiment FROM documents",
    "preprocess_reviews": f"WITH {PREPARED} SELECT row_order, sentiment, clean_text FROM p",
    "filter_reviews": f"WITH {T} SELECT row_order, product, rating, sentiment FROM t "
                      "WHERE product IN ('src1', 'src2', 'src3', 'src8') AND rating IN (1, 2, 4) "
                      "AND sentiment IN ('negative', 'positive') AND verified_purchase",
    "search_reviews": f"WITH {T} SELECT row_order, product, title FROM t "
                      "WHERE regexp_matches(lower(text), 'refund|pump.?doesn') "
                      "OR regexp_matches(lower(title), 'refund|pump.?doesn')",
    "mismatch_flag": f"WITH {R} SELECT review_id, rating, sentiment, {mismatch()} AS is_mismatch FROM r",
    "feed_aspect_filter": f"{INTEL} SELECT row_order, product, rating FROM intel "
                          "WHERE list_contains(all_aspects, 'Delivery')",
    "stored_reviews": f"WITH {STORED} SELECT sr.review_id, text, product FROM sr "
                      "JOIN sp ON sr.review_id = sp.review_id WHERE sp.sentiment = 'positive' "
                      "AND product = 'P7' ORDER BY sr.review_id LIMIT 50 OFFSET 5",
    "batch_blank_gate": f"WITH {LINES} SELECT doc_id, line_no, sentiment, confidence, logged FROM gate",
    "batch_sentiment_counts": f"WITH {LINES} SELECT sentiment, count(*) AS count FROM gate GROUP BY 1",
    "place_reviews_unified": f"WITH {PLACES} SELECT * FROM un",
    "quality_checks": f"""WITH {RAW}
SELECT 'non_empty_clean_text' AS check_name, count(*) FILTER (clean_text = '') AS violations FROM std
UNION ALL SELECT 'label_domain', count(*) FILTER (sentiment IS NULL) FROM std
UNION ALL SELECT 'rating_range', count(*) FILTER (rating NOT BETWEEN 1 AND 5) FROM std
UNION ALL SELECT 'constant_source', 0 FROM std GROUP BY 1
UNION ALL SELECT 'unique_clean_text', count(*) - count(DISTINCT clean_text) FROM std
UNION ALL SELECT 'unique_review_id', count(*) - count(DISTINCT review_id) FROM std""",
    # ------------------------------------------------------------ joins
    "reviews_by_prediction": f"WITH {STORED} SELECT sr.*, sp.sentiment, sp.confidence, sp.model_used "
                             "FROM sr JOIN sp ON sr.review_id = sp.review_id "
                             "WHERE sp.sentiment = 'negative'",
    "split_leakage": f"WITH {PREPARED}, {quota('p')} SELECT count(*) AS overlap FROM ("
                     "SELECT clean_text FROM split WHERE is_test INTERSECT "
                     "SELECT clean_text FROM split WHERE NOT is_test)",
    # ------------------------------------------------------------ aggregates
    "class_distribution": f"WITH {R}, {distribution('r')} SELECT sentiment, count, "
                          "round(percentage, 6) AS percentage FROM cd",
    "rating_distribution": f"WITH {R}, {distribution('r')} SELECT rating, count, "
                           "round(percentage, 6) AS percentage FROM rd",
    "etl_funnel": f"""WITH {RAW}, {"tagged AS (SELECT *, CASE WHEN sentiment IS NULL THEN 1 WHEN combined = '' THEN 2 WHEN clean_text = '' THEN 3 ELSE 0 END AS why FROM std)"}
SELECT count(*) AS sampled_rows, count(*) FILTER (why = 1) AS invalid_rating,
       count(*) FILTER (why = 2) AS empty_text, count(*) FILTER (why = 3) AS empty_clean_text,
       count(DISTINCT clean_text) FILTER (why = 0) AS final_rows,
       count(*) FILTER (why = 0) - count(DISTINCT clean_text) FILTER (why = 0)
         AS duplicate_clean_text, count(*) AS raw_rows FROM tagged""",
    "etl_line_funnel": f"""WITH {RAW}, tagged AS (
  SELECT *, CASE WHEN sentiment IS NULL THEN 1 WHEN combined = '' THEN 2 WHEN clean_text = '' THEN 3 ELSE 0 END AS why
  FROM std WHERE row_order % 10 <> 7 AND row_order % 50 <> 3)
SELECT (SELECT count(*) FROM documents) AS raw_rows, (SELECT count(*) FROM documents) AS sampled_lines,
       (SELECT count(*) FROM documents WHERE doc_id % 10 = 7 OR doc_id % 50 = 3) AS undecodable,
       count(*) AS sampled_rows, count(*) FILTER (why = 1) AS invalid_rating,
       count(*) FILTER (why = 2) AS empty_text, count(*) FILTER (why = 3) AS empty_clean_text,
       count(DISTINCT clean_text) FILTER (why = 0) AS final_rows,
       count(*) FILTER (why = 0) - count(DISTINCT clean_text) FILTER (why = 0)
         AS duplicate_clean_text FROM tagged""",
    "store_totals": "SELECT 'reviews' AS \"table\", count(*) AS rows FROM orders UNION ALL "
                    "SELECT 'predictions', count(*) FROM lineitem",
    "prediction_distribution": f"WITH {STORED} SELECT sentiment, count(*) AS count FROM sp GROUP BY 1",
    "product_counts": f"WITH {STORED} SELECT coalesce(product, 'General') AS product, "
                      "count(*) AS review_count FROM sr GROUP BY 1",
    "product_catalog": f"WITH {R} SELECT product, count(*) AS review_count, product || ' (' || "
                       f"{thousands('count(*)')} || ' reviews)' AS label FROM r GROUP BY product",
    "sentiment_pulse": f"WITH {R} SELECT count(*) AS total, "
                       + ", ".join(f"count(*) FILTER (sentiment = '{c}') AS {c}_count, "
                                   f"round(count(*) FILTER (sentiment = '{c}') * 100.0::DOUBLE "
                                   f"/ count(*), 6) AS {c}_pct" for c in LABELS) + " FROM r",
    "place_pulse": f"""WITH {PLACES},
us AS (SELECT *, {pick(LABELS, 'length(text) % 3')} AS sentiment FROM un)
SELECT place_id, count(*) AS total_reviews, """ + ", ".join(
        f"count(*) FILTER (sentiment = '{c}') AS {c}_count, "
        f"round(count(*) FILTER (sentiment = '{c}') * 100.0::DOUBLE / count(*), 1) AS {c}_pct"
        for c in LABELS) + f""", count(*) FILTER ({mismatch()}) AS mismatch_count,
       round(count(*) FILTER ({mismatch()}) * 100.0::DOUBLE / count(*), 1) AS mismatch_pct
FROM us GROUP BY place_id""",
    "quarterly_trend": f"WITH {R} SELECT year(date_dt) || 'Q' || quarter(date_dt) AS quarter, "
                       "count(sentiment) AS total, count(*) FILTER (sentiment = 'positive') "
                       "AS positive, round(count(*) FILTER (sentiment = 'positive') "
                       "* 100.0::DOUBLE / count(sentiment), 1) AS pos_ratio FROM r "
                       "WHERE date_dt IS NOT NULL GROUP BY 1",
    "mismatch_summary": f"""WITH {R}, c AS (
  SELECT count(*) FILTER (rating >= 4 AND sentiment = 'negative') AS over_rated,
         count(*) FILTER (rating <= 2 AND sentiment = 'positive') AS under_rated, count(*) AS n FROM r)
SELECT over_rated, under_rated, over_rated + under_rated AS total_mismatches,
       round((over_rated + under_rated) * 100.0::DOUBLE / n, 6) AS mismatch_rate FROM c""",
    "complaint_summary": f"WITH {SUMMARY} SELECT * REPLACE (round(share_pct, 6) AS share_pct) FROM summary",
    "product_complaints": f"WITH {PRODUCT} SELECT * REPLACE (round(share_pct, 6) AS share_pct) "
                          "FROM complaint",
    "top_issue_per_aspect": f"WITH {SUMMARY} SELECT aspect, issue AS top_issue FROM summary",
    "high_priority_count": f"WITH {T}, {NEG} SELECT count(*) FILTER (priority = 'HIGH') "
                           "AS high_priority_count FROM intel",
    "product_kpis": f"""WITH {R}, {kpis('r')}
SELECT * REPLACE ({', '.join(f'round({c}_pct, 6) AS {c}_pct' for c in LABELS)},
  round(avg_rating, 6) AS avg_rating, round(verified_pct, 6) AS verified_pct,
  strftime(first_date, '%Y-%m-%d') AS first_date, strftime(last_date, '%Y-%m-%d') AS last_date)
FROM k""",
    "product_compare": f"""WITH {R}, {kpis('r')}
SELECT product, {', '.join(f'round({c}_pct, 6) AS {c}' for c in LABELS)}, total,
       CAST(list_position(['P7', 'P3', 'P11', 'P5'], product) AS INTEGER) AS position
FROM k WHERE product IN ('P7', 'P3', 'P11', 'P5')""",
    "aspect_share": f"""WITH {PRODUCT}, rk AS (
  SELECT product, aspect, round(share_pct, 1) AS share_pct,
         CAST(row_number() OVER (PARTITION BY product ORDER BY count DESC, aspect) AS INTEGER) AS rank
  FROM complaint)
SELECT *, rank = 1 AS is_dominant FROM rk WHERE rank <= 8""",
    "purchase_confidence": f"""WITH {R}, {kpis('r')},
s AS (SELECT product, greatest(0, least(100, positive_pct)) AS score FROM k),
b AS (SELECT *, round(100 - score, 1) AS avoid, round(greatest(0, least(score, 20)), 1) AS mixed,
             round(greatest(0, least(score - 20, 45)), 1) AS buy,
             round(greatest(0, score - 65), 1) AS toptier FROM s),
n AS (SELECT *, avoid + mixed + buy + toptier AS al FROM b)
SELECT product, round(score, 6) AS score, CASE WHEN score < 35 THEN 'AVOID' WHEN score < 55 THEN 'MIXED'
         WHEN score < 80 THEN 'BUY' ELSE 'TOP TIER' END AS tier,
       {', '.join(f'CASE WHEN al > 0 THEN round({x} / al * 100, 1) ELSE {x} END AS {x}'
                  for x in ('avoid', 'mixed', 'buy', 'toptier'))} FROM n""",
    "confusion_matrix": f"""WITH {judged()}, g AS (
  SELECT a.label AS actual, b.label AS predicted FROM (VALUES {', '.join(f"('{c}')" for c in LABELS)}) a(label),
         (VALUES {', '.join(f"('{c}')" for c in LABELS)}) b(label))
SELECT g.actual, g.predicted, count(j.model_name) AS count FROM g LEFT JOIN j
ON g.actual = j.actual AND g.predicted = j.predicted GROUP BY 1, 2""",
    "classification_metrics": f"WITH {judged()} SELECT * FROM m",
    "classification_report": f"WITH {judged()} SELECT model_name, label, round(precision, 6) AS precision, "
                             "round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc",
    "class_weights": f"WITH {L} SELECT sentiment, count(*) AS count, round((SELECT count(sentiment) "
                     "FROM l)::DOUBLE / ((SELECT count(DISTINCT sentiment) FROM l) * count(*)), 6) "
                     "AS weight FROM l WHERE sentiment IS NOT NULL GROUP BY sentiment",
    "model_comparison": f"""WITH {judged()}, {STORED_METRICS}
SELECT CASE {DISPLAY} ELSE model_name END AS model, {pct_text('accuracy * 100', 2)} AS accuracy,
       {pct_text('coalesce(macro_recall, recall) * 100', 2)} AS macro_recall,
       {pct_text('coalesce(macro_precision, precision) * 100', 2)} AS macro_precision,
       printf('%.4f', round(coalesce(macro_f1, f1), 4)) AS macro_f1,
       printf('%.4f', round(weighted_f1, 4)) AS weighted_f1,
       printf('%.4f ms/sample', round(accuracy / 1000, 4)) AS batch_latency FROM sm""",
    "dashboard_stats": f"""WITH ks AS MATERIALIZED (WITH {KEYWORDS} SELECT * FROM kw), {judged()},
{distribution('r')}
SELECT 'totals' AS section, 'reviews' AS name, CAST(count(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'totals', 'predictions', CAST(count(*) AS DOUBLE) FROM lineitem
UNION ALL SELECT 'accuracy', model_name, accuracy FROM m
UNION ALL SELECT 'macro_f1', model_name, macro_f1 FROM m
UNION ALL SELECT 'weighted_f1', model_name, weighted_f1 FROM m
UNION ALL SELECT 'keywords', class || ':' || term, CAST(rank AS DOUBLE) FROM ks
UNION ALL SELECT * FROM ({DISTRIBUTION_ENTRIES})""",
    "label_domain": f"WITH {L} SELECT DISTINCT sentiment FROM l WHERE sentiment IS NOT NULL",
    # ------------------------------------------------------------ windows
    "dedup_clean_text": f"""WITH c AS MATERIALIZED (
  SELECT doc_id AS row_order, {clean('text')} AS clean_text FROM documents)
SELECT min(row_order) AS row_order, clean_text FROM c WHERE clean_text <> '' GROUP BY clean_text""",
    "aspect_evidence": f"""WITH {T}, {NEG}, rk AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY product, primary_aspect ORDER BY row_order) AS INTEGER)
           AS rank FROM intel)
SELECT product, primary_aspect AS aspect, rank, row_order, {star_text('rating')} AS stars, issue,
       priority, replace(replace(title, '&', '&amp;'), '<', '&lt;') AS safe_title
FROM rk WHERE rank <= 6""",
    "stratified_split": f"WITH {T}, {quota('t')} SELECT review_id, sentiment, is_test FROM split",
    "stratified_sample": f"""WITH {R}, sizes AS (
  SELECT sentiment, greatest(1, CAST(round_even(200 * count(*)::DOUBLE / (SELECT count(*) FROM r), 0)
         AS BIGINT)) AS q FROM r GROUP BY sentiment),
rk AS (SELECT r.*, q, row_number() OVER (PARTITION BY r.sentiment ORDER BY {draw('review_id')}) AS nth
       FROM r JOIN sizes USING (sentiment))
SELECT review_id, sentiment, rating FROM rk WHERE nth <= q
ORDER BY {draw('review_id')}, review_id LIMIT 200""",
    "class_keywords": f"""WITH {KEYWORDS}
SELECT class, term, coef, CAST(rank AS INTEGER) AS rank, CAST(11 - rank AS INTEGER) AS position,
       1.0::DOUBLE AS score FROM kw""",
    "ranked_concerns": f"""WITH {SUMMARY}
SELECT * EXCLUDE (share_pct), round(share_pct, 6) AS share_pct, rank <= 3 AS is_next_step FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY count DESC, aspect) AS INTEGER) AS rank FROM summary)
WHERE rank <= 4""",
    # ------------------------------------------------------------ sorts, limits, samples
    "review_feed": f"""{INTEL}
SELECT review_id, rating, helpful_votes, {star_text('rating')} AS stars,
       CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS snippet,
       substr(date, 1, 10) AS day, issue, primary_aspect, priority, {mismatch()} AS is_mismatch
FROM intel ORDER BY helpful_votes DESC, review_id LIMIT 25""",
    "review_feed_recent": f"""{INTEL}
SELECT review_id, substr(date, 1, 10) AS day, primary_aspect FROM intel
WHERE list_contains(all_aspects, 'Packaging') ORDER BY date_dt DESC, review_id LIMIT 50""",
    "review_feed_total": f"""{INTEL}
SELECT least(count(*), 50) AS shown, count(*) AS total_rows FROM intel
WHERE list_contains(all_aspects, 'Delivery')""",
    "feed_mismatch_only": f"WITH {T} SELECT review_id, rating, sentiment FROM t WHERE {mismatch()}",
    "deep_page": f"WITH {R} SELECT review_id, product, rating FROM r ORDER BY review_id "
                 "LIMIT 50 OFFSET 1200",
    "paginate_reviews": f"WITH {R} SELECT review_id, product, rating FROM r ORDER BY review_id "
                        "LIMIT 50 OFFSET 100",
    "mismatch_samples": f"""{INTEL}, kd AS (
  SELECT *, CASE WHEN rating >= 4 THEN 'over_rated' ELSE 'under_rated' END AS kind FROM intel
  WHERE {mismatch()}),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY review_id) AS INTEGER) AS rank
       FROM kd)
SELECT kind, rank, review_id, rating, substr(text, 1, 280) || '…' AS excerpt, primary_aspect, issue,
       suggested_action FROM rk WHERE rank <= 4""",
    "bernoulli_sample": f"WITH {R} SELECT review_id, rating FROM r WHERE "
                        f"('0x' || substr({draw('review_id')}, 1, 8))::BIGINT < floor(0.3 * 4294967296)",
    "sample_cap": f"WITH {R} SELECT review_id, product FROM r ORDER BY {draw('review_id')}, review_id "
                  "LIMIT 500",
    "top_products": f"WITH {R} SELECT product, count(*) AS review_count, product || ' (' || "
                    f"{thousands('count(*)')} || ' reviews)' AS label FROM r GROUP BY product "
                    "ORDER BY review_count DESC, product LIMIT 10",
    "recent_predictions": "SELECT 'rev_' || event_id AS review_id, CASE WHEN length(x) > 70 "
                          "THEN substr(x, 1, 70) || '...' ELSE x END AS snippet FROM ("
                          "SELECT *, repeat(event_type || ' ', 12) AS x FROM events) "
                          "ORDER BY ts DESC, review_id LIMIT 8",
    # ------------------------------------------------------------ scalar functions
    "clean_text": f"SELECT doc_id, {clean('text')} AS clean_text FROM documents",
    "strip_html": f"SELECT page_id, {no_html('lower(html)')} AS plain FROM pages",
    "strip_urls": f"SELECT page_id, {no_urls('lower(html)')} AS plain FROM pages",
    "expand_contractions": f"WITH {T} SELECT row_order, {spelled('lower(text)')} AS spelled FROM t",
    "normalise_letters": f"SELECT doc_id, {letters('lower(text)')} AS letters FROM documents",
    "review_id_hash": f"""
SELECT conv_id, turn, {hashed('rev_', 'role', 'conv_id', 'turn', 'text')} AS review_id,
       {hashed('g_', "('place_' || conv_id)", 'role', 'text')} AS place_review_id FROM conversations""",
    "epoch_ms_to_utc": "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN '' "
                       "ELSE strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S') END "
                       "AS date FROM events",
    "aspect_tags": f"{INTEL} SELECT row_order, array_to_string(all_aspects, '|') AS all_aspects, "
                   "primary_aspect FROM intel",
    "issue_detect": f"{INTEL} SELECT row_order, issue FROM intel",
    "priority_rule": f"{INTEL} SELECT row_order, priority FROM intel",
    "suggested_action": f"{INTEL} SELECT row_order, suggested_action FROM intel",
    "review_intelligence": f"{INTEL} SELECT row_order, sentiment, rating, primary_aspect, "
                           "array_to_string(all_aspects, '|') AS all_aspects, issue, priority, "
                           "suggested_action FROM intel",
    "star_label": f"SELECT rating, count(*) AS rows, {star_text('rating')} AS stars FROM "
                  "(SELECT l_quantity / 8 - 0.5 AS rating FROM lineitem) GROUP BY rating",
    "review_snippet": """
SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS card,
       CASE WHEN length(text) > 70 THEN substr(text, 1, 70) || '...' ELSE text END AS history,
       substr(text, 1, 280) || '…' AS mismatch FROM documents""",
    "date_coverage": f"WITH {R} SELECT product, strftime(min(date_dt), '%b %Y') || ' – ' || "
                     "strftime(max(date_dt), '%b %Y') AS date_coverage FROM r GROUP BY product",
    "product_narrative": _narrative(),
    "explain_tokenise": f"""
SELECT doc_id, CAST(len(ts) AS INTEGER) AS n_tokens, array_to_string(ts, '¦') AS joined FROM (
  SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS ts FROM documents)""",
    "ngram_counts": f"""WITH w AS (SELECT {words_of(clean('text'))} AS ws FROM documents)
SELECT term, count(*) AS count FROM (SELECT unnest({grams('ws')}) AS term FROM w) GROUP BY term""",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), "
                   "'<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM pages",
    "token_count": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS INTEGER) "
                   "AS tokens FROM documents",
    "label_normalise": f"""
SELECT raw, count(*) AS rows, CASE {LABEL_CASE} ELSE lower(raw) END AS label FROM (
  SELECT {pick(ad.RAW_LABELS, 'l_linenumber - 1')} AS raw FROM lineitem) GROUP BY raw""",
    # ------------------------------------------------------------ learning and scoring
    "tfidf_table": f"""WITH w AS (SELECT doc_id, {words_of(clean('text'))} AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({grams('ws')}) AS term FROM w) GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM g GROUP BY term
      ORDER BY total DESC, term LIMIT 10000),
x AS (SELECT doc_id, term, tf, tf * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1)
             AS weight FROM g JOIN v USING (term))
SELECT doc_id, term, tf, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6)
         AS tfidf FROM x""",
    "model_routing": f"WITH {R} SELECT model_requested, count(*) AS rows, {ROUTE} AS model_used "
                     "FROM r GROUP BY model_requested",
    "explain_tokens": f"WITH {TOKENS} SELECT * FROM tk",
    "explain_top_words": f"""WITH {TOKENS},
uw AS (SELECT doc_id, lower(token) AS word, min(position) AS fu, max(diff) AS diff,
              CASE WHEN max(diff) > 0 THEN 'positive' ELSE 'negative' END AS kind
       FROM tk GROUP BY doc_id, lower(token) HAVING abs(max(diff)) > 0.5),
nd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY diff DESC, fu) AS up,
              row_number() OVER (PARTITION BY doc_id, kind ORDER BY diff ASC, fu DESC) AS down
       FROM uw),
ls AS (SELECT * FROM nd WHERE (kind = 'positive' AND up <= 5) OR (kind = 'negative' AND down <= 5))
SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY diff DESC, fu)
         AS INTEGER) AS rank, word, abs(diff) AS score FROM ls""",
    "cosine_topk": f"""WITH dims AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) d(i) GROUP BY ALL),
ce AS (SELECT label, list(x ORDER BY i) AS centre FROM dims GROUP BY label),
s AS (SELECT e.label, vec_id, {COSINE} AS sim FROM embeddings e JOIN ce USING (label))
SELECT label, vec_id, round(sim, 4) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s)
WHERE rank <= 10""",
    "etl_pipeline": f"WITH {PROCESSED} SELECT * FROM e",
    # ------------------------------------------------------------ streams
    "score_stored": f"""WITH {STORED_MODELS}, {T}, tt AS (SELECT review_id, text, rating FROM t), {scored('tt', 'review_id')}
SELECT *, {mismatch()} AS is_mismatch FROM (
  SELECT review_id, rating, clean_text, {BALANCED}, '{labels.DEFAULT_MODEL}' AS model_used FROM sa)""",
    "score_routed": f"""WITH {STORED_MODELS}, {T}, tt AS (
  SELECT review_id, text, {pick(ad.MODEL_REQUESTS, 'row_order % 7')} AS model_requested FROM t), {scored('tt', 'review_id')},
ro AS (SELECT *, {LINEAR_ROUTE} AS model_used FROM (SELECT *, {ROUTE} AS route FROM sa))
SELECT review_id, model_requested, model_used, {NUMBER.format('l', 'l', 'l')} AS sentiment,
       {NUMBER.format('p', 'p', 'p')} AS confidence FROM ro""",
    "evaluate_stored": f"""WITH {STORED_MODELS}, pt AS (SELECT review_id, clean_text, sentiment FROM p),
{scored('pt', 'review_id', 'clean_text')},
j AS ({' UNION ALL '.join(f"SELECT '{name}' AS model_name, sentiment AS actual, l{h} AS predicted FROM sa"
                          for h, (name, _, _) in enumerate(ad.STAND_INS))}),
{METRICS}
SELECT model_name, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1 FROM m""",
    "place_analysis_stored": f"""WITH {STORED_MODELS}, {PLACES}, {scored('un', 'review_id')}
SELECT *, {mismatch()} AS is_mismatch FROM (
  SELECT sa.* EXCLUDE (text, l0, l1, l2, p0, p1, p2), {BALANCED} FROM sa)""",
    "place_overview": f"""WITH {STORED_MODELS}, {PLACES}, {scored('un', 'review_id')},
us AS (SELECT place_id, rating, l1 AS sentiment FROM sa),
pu AS (SELECT place_id, count(*) AS total_reviews, {", ".join(
        f"count(*) FILTER (sentiment = '{c}') AS {c}_count, "
        f"round(count(*) FILTER (sentiment = '{c}') * 100.0::DOUBLE / count(*), 1) AS {c}_pct" for c in LABELS)},
       count(*) FILTER ({mismatch()}) AS mismatch_count,
       round(count(*) FILTER ({mismatch()}) * 100.0::DOUBLE / count(*), 1) AS mismatch_pct FROM us GROUP BY place_id)
SELECT pi.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in pipelines.PULSE)}
FROM (SELECT DISTINCT place_id, name, CASE WHEN conv_id % 2 = 0 THEN '1 Main St' ELSE '' END AS address,
             (3 + conv_id % 3 / 2)::DOUBLE AS overall_rating, conv_id::INTEGER AS user_rating_count, '' AS maps_uri
      FROM pl) pi LEFT JOIN pu USING (place_id)""",
    "stream_score": f"""WITH {STORED_MODELS}, {T}, {scored('t', 'review_id')},
st AS (SELECT * REPLACE (l1 AS sentiment) FROM sa), {intelligence('st')}
SELECT row_order, sentiment, p1 AS confidence, '{labels.DEFAULT_MODEL}' AS model_used, primary_aspect,
       array_to_string(all_aspects, '|') AS all_aspects, issue, priority, suggested_action FROM intel""",
    "stream_log_dedup": f"SELECT 'rev_' || event_id AS review_id, {EVENT_SENTIMENT} AS sentiment "
                        "FROM events",
    "stream_windowed_ratio": f"""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) AS total,
       count(*) FILTER (s = 'positive') AS positive,
       round(count(*) FILTER (s = 'positive') * 100.0::DOUBLE / count(*), 1) AS pos_ratio
FROM (SELECT ts, {EVENT_SENTIMENT} AS s FROM events) GROUP BY 1""",
}
