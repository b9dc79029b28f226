"""Queries on predictions and model answers: metrics, parsed outputs, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import BINS
from ..operators import meteor as MT
from ..operators import metrics as M
from ..operators import parse as Z
from ..operators import report as T
from .corpus import _PAIRS, _pairs
from .registry import query, table

_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')"


def _predictions(spark, sf_dir):
    """User turns as predictions of the assistant turns that follow."""
    pairs = _pairs(spark, sf_dir)
    return pairs.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("source").alias("prediction"), F.array("target").alias("references"))


_SIDES = f"""
{_PAIRS}, t AS (SELECT conv_id || '-' || turn AS id, {_TOKENS.format("source")} AS h, {_TOKENS.format("target")} AS r FROM pairs),
orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT id, n, unnest(list_transform(range(1, greatest(len(h) - n + 2, 1)), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS gram FROM t, orders),
rg AS (SELECT id, n, unnest(list_transform(range(1, greatest(len(r) - n + 2, 1)), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS gram FROM t, orders),
hc AS (SELECT id, n, gram, count(*) AS c FROM hg GROUP BY ALL), rc AS (SELECT id, n, gram, count(*) AS c FROM rg GROUP BY ALL)"""


@query(f"""
WITH {_SIDES}, s AS (SELECT n, sum(hc.c) AS total, sum(least(hc.c, coalesce(rc.c, 0))) AS match FROM hc LEFT JOIN rc USING (id, n, gram) GROUP BY n),
p AS (SELECT max(100.0::DOUBLE * match / total) FILTER (n = 1) AS p1, max(100.0::DOUBLE * match / total) FILTER (n = 2) AS p2, max(100.0::DOUBLE * match / total) FILTER (n = 3) AS p3, max(100.0::DOUBLE * match / total) FILTER (n = 4) AS p4,
  max(total) FILTER (n = 1) AS t1, max(total) FILTER (n = 2) AS t2, max(total) FILTER (n = 3) AS t3, max(total) FILTER (n = 4) AS t4 FROM s),
z AS (SELECT CASE WHEN p1 = 0 THEN 50.0::DOUBLE / t1 ELSE p1 END AS p1, CASE WHEN p2 = 0 THEN 100.0::DOUBLE / (2 ** ((p1 = 0)::INT + 1) * t2) ELSE p2 END AS p2,
  CASE WHEN p3 = 0 THEN 100.0::DOUBLE / (2 ** ((p1 = 0)::INT + (p2 = 0)::INT + 1) * t3) ELSE p3 END AS p3, CASE WHEN p4 = 0 THEN 100.0::DOUBLE / (2 ** ((p1 = 0)::INT + (p2 = 0)::INT + (p3 = 0)::INT + 1) * t4) ELSE p4 END AS p4 FROM p),
l AS (SELECT sum(len(h)) AS h, sum(len(r)) AS r FROM t)
SELECT round(CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 6) AS bleu, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
  round(CASE WHEN h >= r THEN 1 ELSE exp(1 - r / h) END, 6) AS brevity, h::BIGINT AS prediction_length, r::BIGINT AS reference_length FROM z, l
""")
def q_bleu(spark, sf_dir):
    b = M.bleu(_predictions(spark, sf_dir))
    return b.select(*(F.round(c, 6).alias(c) for c in ("bleu", "p1", "p2", "p3", "p4", "brevity")), "prediction_length", "reference_length")


_13A = "' ' || replace(replace(replace(replace(replace(replace(replace({0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
for _pattern, _out in (("([{{-~\\[-` -&(-+:-@/])", " \\1 "), ("([^0-9])([.,])", "\\1 \\2 "), ("([.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 ")):
    _13A = f"regexp_replace({_13A}, '{_pattern}', '{_out}', 'g')"


@query(f"""
WITH {_PAIRS}
SELECT conv_id || '-' || turn AS id, md5(array_to_string(list_filter(regexp_split_to_array({_13A.format("source")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), ' ')) AS tokens FROM pairs
""")
def q_sacrebleu_tokens(spark, sf_dir):
    return _predictions(spark, sf_dir).select("id", F.md5(F.array_join(M.tokens_13a(F.col("prediction")), " ")).alias("tokens"))


@query(f"""
WITH {_SIDES}, k AS (SELECT count(*) AS samples FROM t), often AS (SELECT n, gram, count(DISTINCT id) AS df FROM rc GROUP BY ALL),
a AS (SELECT id, n, gram, c * (ln(samples) - ln(coalesce(df, 1))) AS w FROM hc LEFT JOIN often USING (n, gram), k),
b AS (SELECT id, n, gram, c * (ln(samples) - ln(coalesce(df, 1))) AS v FROM rc LEFT JOIN often USING (n, gram), k),
na AS (SELECT id, n, sqrt(sum(w * w)) AS x FROM a GROUP BY ALL), nb AS (SELECT id, n, sqrt(sum(v * v)) AS y FROM b GROUP BY ALL),
d AS (SELECT id, n, sum(least(w, v) * v) AS dot FROM a JOIN b USING (id, n, gram) GROUP BY ALL),
s AS (SELECT id, sum(CASE WHEN x * y = 0 THEN 0 ELSE dot / (x * y) END) / 4 AS s FROM d JOIN na USING (id, n) JOIN nb USING (id, n) GROUP BY id)
SELECT id, round(10 * coalesce(s, 0) * exp(-((len(h) - len(r)) ** 2) / 72.0::DOUBLE), 6) AS cider FROM t LEFT JOIN s USING (id)
""")
def q_cider(spark, sf_dir):
    return M.cider(_predictions(spark, sf_dir)).select("id", F.round("cider", 6).alias("cider"))


@query(f"""
WITH {_SIDES}, hw AS (SELECT id, unnest(h) AS word, unnest(range(0, len(h))) AS i FROM t), rw AS (SELECT id, unnest(r) AS word, unnest(range(0, len(r))) AS j FROM t),
hk AS (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY i) AS k FROM hw), rk AS (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY j) AS k FROM rw),
m AS (SELECT id, i, j, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM hk JOIN rk USING (id, word, k) WINDOW w AS (PARTITION BY id ORDER BY i)),
c AS (SELECT id, count(*) AS m, sum(CASE WHEN i = pi + 1 AND j = pj + 1 THEN 0 ELSE 1 END) AS chunks FROM m GROUP BY id),
f AS (SELECT id, m, chunks, m / len(h) AS p, m / len(r) AS rec FROM t LEFT JOIN c USING (id))
SELECT id, round(coalesce(10 * p * rec / (rec + 9 * p) * (1 - 0.5 * (chunks / m) ** 3), 0), 6) AS meteor FROM f
""")
def q_meteor_exact(spark, sf_dir):
    return M.meteor_exact(_predictions(spark, sf_dir)).select("id", F.round("meteor", 6).alias("meteor"))


_STEM = "regexp_replace({0}, '^(.{{3,}}?)(?:" + MT.ENDINGS["en"] + ")$', '\\1')"


@query(f"""
WITH {_SIDES}, hw AS (SELECT id, unnest(h) AS word, unnest(range(0, len(h))) AS i FROM t), rw AS (SELECT id, unnest(r) AS word, unnest(range(0, len(r))) AS j FROM t),
hs AS (SELECT *, {_STEM.format("word")} AS stem FROM hw), rs AS (SELECT *, {_STEM.format("word")} AS stem FROM rw),
he AS (SELECT id, word, count(*) AS n FROM hs GROUP BY ALL), re AS (SELECT id, word, count(*) AS n FROM rs GROUP BY ALL),
hl AS (SELECT id, stem, count(*) AS n FROM hs GROUP BY ALL), rl AS (SELECT id, stem, count(*) AS n FROM rs GROUP BY ALL),
e AS (SELECT id, sum(least(he.n, re.n)) AS m FROM he JOIN re USING (id, word) GROUP BY id), c AS (SELECT id, sum(least(hl.n, rl.n)) AS m FROM hl JOIN rl USING (id, stem) GROUP BY id),
-- where each stem that both have stands once in either text, there is one alignment, whose chunks can be counted
several AS (SELECT id, max(greatest(hl.n, rl.n)) > 1 AS open FROM hl JOIN rl USING (id, stem) GROUP BY id),
pairs_met AS (SELECT id, i, j, lag(i) OVER w AS pi, lag(j) OVER w AS pj FROM hs JOIN rs USING (id, stem) WHERE id IN (SELECT id FROM several WHERE NOT open) WINDOW w AS (PARTITION BY id ORDER BY i)),
chunked AS (SELECT id, count(*) FILTER (WHERE pi IS NULL OR i <> pi + 1 OR j <> pj + 1) AS chunks FROM pairs_met GROUP BY id)
SELECT t.id, coalesce(e.m, 0)::BIGINT AS exact, (coalesce(c.m, 0) - coalesce(e.m, 0))::BIGINT AS stems, CASE WHEN c.m IS NULL THEN 0 WHEN NOT open THEN chunks END::BIGINT AS sole_chunks
FROM t LEFT JOIN e USING (id) LEFT JOIN c USING (id) LEFT JOIN several USING (id) LEFT JOIN chunked USING (id)
""")
def q_meteor_stems(spark, sf_dir):
    """Exact and stem matches of every pair, and the chunks where only one alignment has as many."""
    rows = _predictions(spark, sf_dir)
    found = MT.meteor(rows)
    stems = lambda c: F.transform(M.tokens(c), lambda w: MT.stem(w, "en"))
    both = rows.select("id", stems(F.col("prediction")).alias("h"), stems(F.col("references")[0]).alias("r"))
    both = both.withColumn("common", F.array_intersect("h", "r"))  # a column, so as not to be made for each word
    common = F.col("common")
    sole = both.select("id", ((F.size(F.filter("h", lambda w: F.array_contains(common, w))) == F.size(common)) & (F.size(F.filter("r", lambda w: F.array_contains(common, w))) == F.size(common))).alias("sole"))
    return found.join(sole, "id").select("id", "exact", "stems", F.when(F.col("sole"), F.col("chunks")).alias("sole_chunks"))


def _loc(expr: str) -> str:
    return f"'<loc_' || (({expr}) % {BINS})::INT || '>'"


_FOUR = " || ".join(_loc(e) for e in ("p_partkey", "p_partkey * 3", "p_size * 11", "p_partkey + p_size"))
_BACK = " || ".join(_loc(e) for e in ("p_size", "p_size * 2", "p_partkey * 7", "p_size * 5"))


def _answers(spark, sf_dir, sql: str):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(sql.replace("::INT", "")).alias("text"))


_BOXES = f"'<s>' || p_name || {_FOUR} || {_BACK} || ' ' || p_type || 'é' || {_FOUR} || '</s>'"


@query(f"""
WITH b AS (SELECT p_partkey, unnest([p_name, p_name, p_type]) AS cat_name, unnest([[p_partkey, p_partkey * 3, p_size * 11, p_partkey + p_size], [p_size, p_size * 2, p_partkey * 7, p_size * 5], [p_partkey, p_partkey * 3, p_size * 11, p_partkey + p_size]]) AS q FROM part)
SELECT p_partkey, cat_name, round((q[1] % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) AS x1, round((q[2] % {BINS} + 0.5::DOUBLE) * 0.48::DOUBLE, 4) AS y1, round((q[3] % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) AS x2, round((q[4] % {BINS} + 0.5::DOUBLE) * 0.48::DOUBLE, 4) AS y2 FROM b
""")
def q_parse_boxes(spark, sf_dir):
    rows = _answers(spark, sf_dir, _BOXES).select("p_partkey", F.explode(Z.described_boxes(F.col("text"), F.lit(640.0), F.lit(480.0))).alias("i"))
    return rows.select("p_partkey", "i.cat_name", *(F.round(F.get("i.bbox", F.lit(k)), 4).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


_GROUND = f"CASE p_size % 4 WHEN 0 THEN 'the image' WHEN 1 THEN 'it' ELSE p_name END || {_FOUR} || {_BACK} || p_type || {_BACK}"


@query(f"""
SELECT p_partkey, p_name AS cat_name, 2 AS n_boxes, round((p_partkey % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) AS x1 FROM part WHERE p_size % 4 >= 2
UNION ALL SELECT p_partkey, p_type, 1, round((p_size % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) FROM part
""")
def q_parse_grounding(spark, sf_dir):
    rows = _answers(spark, sf_dir, _GROUND).select("p_partkey", F.explode(Z.grounded_phrases(F.col("text"), F.lit(640.0), F.lit(480.0))).alias("i"))
    return rows.select("p_partkey", "i.cat_name", F.size("i.boxes").alias("n_boxes"), F.round(F.get(F.get("i.boxes", F.lit(0)), F.lit(0)), 4).alias("x1"))


_OCR = f"p_name || {_FOUR} || {_BACK} || p_brand || {_BACK} || {_FOUR}"


@query(f"""
WITH o AS (SELECT p_partkey, unnest([p_name, p_brand]) AS line, unnest([p_partkey, p_size]) AS a, unnest([p_size * 5, p_partkey + p_size]) AS h FROM part)
SELECT p_partkey, line, round((a % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) AS x1, round((h % {BINS} + 0.5::DOUBLE) * 0.48::DOUBLE, 4) AS y4 FROM o
""")
def q_parse_ocr(spark, sf_dir):
    rows = _answers(spark, sf_dir, _OCR).select("p_partkey", F.explode(Z.ocr_lines(F.col("text"), F.lit(640.0), F.lit(480.0))).alias("i"))
    return rows.select("p_partkey", F.col("i.text").alias("line"), F.round(F.get("i.quad_box", F.lit(0)), 4).alias("x1"), F.round(F.get("i.quad_box", F.lit(7)), 4).alias("y4"))


_POLYGON = f"p_name || '<poly>' || {_FOUR} || {_loc('p_size')} || '<sep>' || {_BACK} || '</poly>' || '<poly>' || {_BACK} || '</poly>'"


@query(f"""
SELECT p_partkey, 0 AS pos, p_name AS cat_name, 2 AS n_rings, 4 AS n_first, round((p_partkey % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) AS x1 FROM part
UNION ALL SELECT p_partkey, 1, p_name, 1, 4, round((p_size % {BINS} + 0.5::DOUBLE) * 0.64::DOUBLE, 4) FROM part
""")
def q_parse_polygons(spark, sf_dir):
    rows = _answers(spark, sf_dir, _POLYGON).select("p_partkey", F.posexplode(Z.described_polygons(F.col("text"), F.lit(640.0), F.lit(480.0))).alias("pos", "i"))
    first = F.get("i.polygons", F.lit(0))
    return rows.select("p_partkey", "pos", "i.cat_name", F.size("i.polygons").alias("n_rings"), F.size(first).alias("n_first"), F.round(F.get(first, F.lit(0)), 4).alias("x1"))


def _results(spark, sf_dir):
    """Metric rows of tasks named after event types."""
    e = table(spark, sf_dir, "events")
    metric = F.when(F.col("user_id") % 3 == 0, "SacreBLEU").when(F.col("user_id") % 3 == 1, "COMET").otherwise("CIDEr")
    return e.groupBy(F.concat(F.lit("multi_"), "event_type").alias("task"), metric.alias("metric")).agg(F.avg("value").alias("value"))


_REPORT = """
WITH r AS (
  SELECT event_type AS key, CASE user_id % 3 WHEN 0 THEN 'SacreBLEU' WHEN 1 THEN 'COMET' ELSE 'CIDEr' END AS metric, avg(value) AS value
  FROM events GROUP BY ALL
), w AS (SELECT key, coalesce(max(value) FILTER (metric = 'SacreBLEU'), -100) AS bleu, coalesce(max(value) FILTER (metric = 'METEOR'), -100) AS meteor, coalesce(max(value) FILTER (metric = 'COMET'), -100) AS comet FROM r WHERE key IN ('click', 'view', 'error') GROUP BY key)"""


@query(f"""{_REPORT}
SELECT key, round(bleu, 6) AS "SacreBLEU", round(comet, 6) AS "COMET", round(meteor, 6) AS "METEOR" FROM w UNION ALL SELECT 'mean', round(avg(bleu), 6), round(avg(comet), 6), round(avg(meteor), 6) FROM w
""")
def q_report_pivot(spark, sf_dir):
    metrics = ["SacreBLEU", "COMET", "METEOR"]  # no row has the last
    t = T.selected(_results(spark, sf_dir), "multi_", ["click", "view", "error"], metrics)
    both = t.union(T.means(t, metrics).select(F.lit("mean").alias("key"), *metrics))
    return both.select("key", *(F.round(m, 6).alias(m) for m in metrics))


@query("""
SELECT event_type AS task, round(avg(value), 6) AS "BLEU", NULL::DOUBLE AS "accuracy", NULL::BIGINT AS n FROM events GROUP BY event_type
UNION ALL SELECT label::VARCHAR, NULL, NULL, count(*) FROM embeddings GROUP BY label
UNION ALL SELECT source, NULL, round(avg(n_chars), 6), NULL FROM documents GROUP BY source
""")
def q_union_keys(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.round(F.avg("value"), 6).alias("BLEU"))
    b = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("task")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("task")).agg(F.round(F.avg("n_chars"), 6).alias("accuracy"))
    return T.union_of_keys([a, b, c]).select("task", "BLEU", "accuracy", "n")
