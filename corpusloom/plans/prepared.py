"""Queries on smaller steps: loaders, evaluation annotations, codecs, lookups, answer shapes and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import prompts as P
from ..functions import text as X
from ..functions import vectors as V
from ..functions.boxes import dequantised_all, quantised_all
from ..operators import annotate as A
from ..operators import bake as B
from ..operators import config as C
from ..operators import parse as Z
from ..operators import vocabulary as O
from ..operators.drive import caption_call
from ..operators.ledger import Ledger
from ..sources import readers as S
from ..storage import new_path
from .corpus import _PAIRS, _pairs
from .evaluation import _BACK, _FOUR
from .registry import SENTENCES, query, table


@query("""
WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o_custkey, priority FROM orders JOIN last USING (o_custkey)
""")
def q_last_description(spark, sf_dir):
    """Each order with its customer's last priority; a customer without one would be an error."""
    orders = table(spark, sf_dir, "orders")
    last = B.last_wins(orders, "o_custkey", F.col("o_orderkey"), "o_orderpriority").withColumnRenamed("o_orderpriority", "priority")
    return B.looked_up(orders.select("o_orderkey", "o_custkey"), last, "o_custkey").select("o_orderkey", "o_custkey", "priority")


_STYLE_SQL = "CASE WHEN n_chars < 500 THEN '<CAPTION>' WHEN n_chars < 2000 THEN '<DETAILED_CAPTION>' ELSE '<MORE_DETAILED_CAPTION>' END"


@query(f"""
WITH k AS (SELECT *, CASE WHEN length(doc_id::VARCHAR) >= 9 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 9, '0') END AS key FROM documents)
SELECT lang || '_caption' AS target, key AS __key__, 'caption' AS type, lang, '<LANG_' || upper(lang) || '>' || {_STYLE_SQL} AS prompt, md5(text) AS output FROM k WHERE lang IN ('en', 'de', 'es')
UNION ALL SELECT 'es_translation', key, 'translation', 'es', '<LANG_ES><TRANSLATE>' || source, md5(text) FROM k WHERE doc_id % 3 = 0
UNION ALL SELECT 'zh_translation', key, 'translation', 'zh', '<LANG_ZH><TRANSLATE>' || lang, md5(source) FROM k WHERE doc_id % 3 = 1
""")
def q_eval_annotations(spark, sf_dir):
    """Wide rows of captions and translations, most of them null, as typed annotations by target."""
    docs = table(spark, sf_dir, "documents")
    style = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "detailed").otherwise("more_detailed")
    wide = docs.select(F.col("doc_id").alias("key"), *(F.when(F.col("lang") == x, F.col("text")).alias(f"caption_{x}") for x in ("en", "de", "es", "zh")), *(style.alias(f"caption_{x}_style") for x in ("en", "de", "es", "zh")),
                       F.when(F.col("doc_id") % 3 == 0, F.array("source", "text")).alias("translation_en_es"), F.when(F.col("doc_id") % 3 == 1, F.array("lang", "source")).alias("translation_en_zh"))
    return A.annotate_eval(wide).withColumn("output", F.md5("output"))


@query("""
SELECT doc_id, doc_id % 4 = 0 AS broken, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 4 = 1 THEN 0 ELSE 2 END END AS n,
  CASE WHEN doc_id % 4 > 1 THEN lang END AS lang, CASE WHEN doc_id % 4 > 1 THEN md5(text) END AS output FROM documents
""")
def q_annotations_codec(spark, sf_dir):
    """Annotations as a shard member's bytes and back, some of them cut off; the first of each sample."""
    one = lambda out: A.annotation("caption", F.col("lang"), A.caption_prompt(F.col("lang"), F.lit("short")), out)
    data = F.when(F.col("doc_id") % 4 == 1, F.array().cast(f"array<{A.ANNOTATION}>")).otherwise(F.array(one(F.col("text")), one(F.col("source"))))
    rows = table(spark, sf_dir, "documents").withColumn("data", A.encoded(data))
    rows = rows.withColumn("data", F.when(F.col("doc_id") % 4 == 0, F.expr("substring(data, 1, length(data) - 5)")).otherwise(F.col("data")))
    back = rows.withColumn("back", A.decoded(F.col("data")))
    first = A.first_annotation(F.col("back"))
    return back.select("doc_id", F.col("back").isNull().alias("broken"), F.when(F.col("back").isNotNull(), F.size("back")).alias("n"), first["lang"].alias("lang"), F.md5(first["output"]).alias("output"))


_CAPITAL = "upper(s[1]) || lower(s[2:])"


@query(f"""
WITH {_PAIRS}, t AS (SELECT conv_id, turn, source, target, {SENTENCES.format("source")} AS ss FROM pairs WHERE length(source) > 25 AND (conv_id + turn) % 3 = 1)
SELECT conv_id, turn, md5('<LANG_DE><TRANSLATE>' || array_to_string(list_transform(ss, lambda s: {_CAPITAL}), ' ')) AS prompt, md5(target) AS output FROM t
""")
def q_full_translation(spark, sf_dir):
    """Training rows with none, one or two pairs of captions: the whole translation of those with exactly one."""
    none = F.lit(None).cast("array<array<string>>")
    pair = F.array("source", "target")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("target").alias("whole"), F.concat_ws("-", "conv_id", "turn").alias("__key__"), F.when(kind == 1, F.array(pair)).when(kind == 2, F.array(pair, pair)).alias("caption_en_de"), *(none.alias(f"translation_en_{x}") for x in A.TRAIN_LANGS))
    made = A.annotate_train(rows).join(rows.select("__key__", "conv_id", "turn", "whole"), "__key__")
    full = F.get(F.filter("data", lambda a: (a["type"] == "translation") & (a["output"] == F.col("whole"))), F.lit(0))
    return made.select("conv_id", "turn", F.md5(full["prompt"]).alias("prompt"), F.md5(full["output"]).alias("output"))


@query("""
SELECT p_partkey, ['description_with_bboxes', 'pure_text', 'polygons', 'bboxes', 'ocr'][(p_partkey % 5 + 1)::INT] AS parser,
  CASE (p_partkey % 5)::INT WHEN 1 THEN p_name || ' <eos>' END AS text,
  CASE (p_partkey % 5)::INT WHEN 0 THEN [lower(p_name)] WHEN 2 THEN [p_name] WHEN 3 THEN [p_name, p_name] WHEN 4 THEN [p_name] END AS labels,
  CASE (p_partkey % 5)::INT WHEN 0 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS n_boxes, CASE (p_partkey % 5)::INT WHEN 2 THEN 1 WHEN 3 THEN 0 END AS n_rings,
  CASE (p_partkey % 5)::INT WHEN 0 THEN lower(p_name) || ' 1' ELSE ' 0' END AS object FROM part
""")
def q_answer_shapes(spark, sf_dir):
    """Answers to five tasks, each by its parser, in parallel arrays."""
    task = F.element_at(F.array(*map(F.lit, ("<OD>", "<CAPTION>", "<OPEN_VOCABULARY_DETECTION>", "<OPEN_VOCABULARY_DETECTION>", "<OCR_WITH_REGION>"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    kind = (F.col("p_partkey") % 5).cast("int")
    text = F.when(kind == 0, F.expr(f"p_name || {_FOUR}".replace("::INT", ""))).when(kind == 1, F.concat(F.lit("<s>"), "p_name", F.lit(" <eos></s>"))).when(kind == 2, F.expr(f"p_name || '<poly>' || {_FOUR} || '</poly>'".replace("::INT", ""))).when(kind == 3, F.expr(f"p_name || {_FOUR} || {_BACK}".replace("::INT", ""))).otherwise(F.expr(f"p_name || {_FOUR} || {_BACK}".replace("::INT", "")))
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), task.alias("task"), text.alias("text"), F.lit(640.0).alias("w"), F.lit(480.0).alias("h"))
    found = Z.answers(rows.withColumn("parser", Z.parser_of(F.col("task"))), "task", "text", "w", "h")
    named = F.when(F.col("kind").isin(2, 3), F.when(F.col("kind") == 2, "polygons").otherwise("bboxes")).otherwise(F.col("parser"))
    pure = Z.pure_text(F.col("text"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    things = Z.objects(F.when(F.col("kind") == 0, F.col("text")).otherwise(""), F.col("w"), F.col("h"))
    thing = F.concat_ws(" ", F.coalesce(F.get(things, F.lit(0))["cat_name"], F.lit("")), F.size(things))
    return found.select("p_partkey", named.alias("parser"), F.when(F.col("kind") == 1, pure).alias("text"), "answer.labels", F.coalesce(size("answer.quad_boxes"), size("answer.bboxes")).alias("n_boxes"), size("answer.polygons").alias("n_rings"), thing.alias("object"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_no, '  ' || c_name || chr(9) AS text FROM customer")
def q_plain_lines(spark, sf_dir):
    """A line file as it is, but for the lines' ends."""
    path = new_path(spark, "lines")
    rows = table(spark, sf_dir, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey")
    rows.select(F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("value")).write.text(path)
    return S.read_lines(spark, path, stripped=False)


def _line_file(rows, order, text, path, **options):
    rows.repartitionByRange(2, order).sortWithinPartitions(order).select(text.alias("value")).write.options(**options).text(path)


@query("""
WITH n AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_no FROM supplier)
SELECT row_no, 'coco/' || CASE WHEN s_nationkey % 2 = 0 THEN 'train2014' ELSE 'val2014' END || '/' || CASE WHEN s_nationkey % 2 = 0 THEN 'train2014_' ELSE 'test_' END || s_suppkey || '.jpg' AS image, [s_name] AS source, [s_name || ' ' || s_nationkey] AS target FROM n
""")
def q_parallel_lines(spark, sf_dir):
    """Images, sentences and translations, each a line file, in the folders of the parallel caption set."""
    root, split = new_path(spark, "multi30k"), "test_2017_mscoco"
    rows = table(spark, sf_dir, "supplier")
    name = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "train2014_").otherwise("test_"), "s_suppkey", F.lit(".jpg#3"))
    _line_file(rows, "s_suppkey", name, f"{root}/data/task1/image_splits/{split}.txt")
    _line_file(rows, "s_suppkey", F.col("s_name"), f"{root}/data/task1/raw/{split}.en.gz", compression="gzip")
    _line_file(rows, "s_suppkey", F.concat_ws(" ", "s_name", "s_nationkey"), f"{root}/data/task1/raw/{split}.de.gz", compression="gzip")
    return S.read_multi30k(spark, root, split, "de")


@query("SELECT doc_id::VARCHAR AS key, [source, 'n' || doc_id % 5] AS source, [md5(text)] AS target FROM documents WHERE lang <> 'zz'")
def q_multilingual_lines(spark, sf_dir):
    """JSON lines with a struct a language."""
    path = new_path(spark, "multilingual")
    docs = table(spark, sf_dir, "documents")
    english = F.struct(F.array(F.col("source"), F.concat(F.lit("n"), F.col("doc_id") % 5)).alias("caption"))
    docs.select(F.col("doc_id").cast("string").alias("image/key"), english.alias("en"), F.struct(F.array(F.md5("text")).alias("caption")).alias("quz"), F.struct(F.array("lang").alias("caption")).alias("th")).write.json(path)
    return S.read_multilingual(spark, path, "quz")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_no, c_custkey || '.jpg' AS image, ' ' || c_name AS source, c_mktsegment AS correct, lower(c_mktsegment) AS incorrect FROM customer")
def q_ambiguity_lines(spark, sf_dir):
    """Four line files whose lines belong together."""
    root = new_path(spark, "commute")
    rows = table(spark, sf_dir, "customer")
    for name, text in (("img.order", F.concat("c_custkey", F.lit(".jpg"))), ("src.de", F.concat(F.lit(" "), "c_name")), ("correct.de", F.col("c_mktsegment")), ("incorrect.de", F.lower("c_mktsegment"))):
        _line_file(rows, "c_custkey", text, f"{root}/{name}")
    return S.read_ambiguity(spark, root, "de")


@query("""
SELECT page_id, url LIKE 'http%' AS is_url, trim(replace('a photo of ' || chr(10) || 'page ' || page_id || chr(10), chr(10), ' ')[12:]) AS caption, printf('%.3f', page_id / 8.0) AS size,
  CASE WHEN page_id % 2 = 0 THEN ' p' || page_id ELSE 'p' || page_id END AS piece, 'c' || page_id || ' ### (' || url || ')' AS context,
  CASE WHEN page_id % 2 = 0 THEN 'Das Bild zeigt' ELSE 'La photo montre' END || ' x' AS said, ' x' AS rest,
  'Describe this image in one short sentence' || CASE WHEN page_id % 2 = 0 THEN ' in German' ELSE ' in French' END || '. Only answer with the caption.' AS asked FROM pages
""")
def q_text_columns(spark, sf_dir):
    """Small text columns over one table."""
    n, lang = F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "de").otherwise("fr")
    said = F.concat(P.lookup(P.DECODER_PREFIX, F.col("lang")), F.lit(" x"))
    rows = table(spark, sf_dir, "pages").withColumn("lang", lang).withColumn("said", said)
    return rows.select(
        "page_id",
        X.is_url(F.col("url")).alias("is_url"),
        X.caption_only(F.concat(F.lit("a photo of \npage "), n, F.lit("\n"))).alias("caption"),
        F.replace(X.size_text(F.col("page_id") / 8), F.lit(","), F.lit("")).alias("size"),
        X.plain_piece(F.concat(F.when(F.col("page_id") % 2 == 0, "▁p").otherwise("p"), n)).alias("piece"),
        P.context_source(F.concat(F.lit("c"), n), F.col("url")).alias("context"),
        "said",
        P.without_prefix(F.col("said"), F.col("lang")).alias("rest"),
        P.instruction(F.col("lang")).alias("asked"),
    )


_WORD = "[^ \\t\\n\\x0B\\f\\r]+"


@query(f"SELECT len(w)::INT AS n_old, count(*) AS tokens FROM (SELECT regexp_extract_all(text, '{_WORD}') AS w FROM documents) GROUP BY 1")
def q_matched_lengths(spark, sf_dir):
    """How many documents have so many tokens, as for matched vocabularies."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    return O.by_length(table(spark, sf_dir, "documents").select(words.alias("old_ids")))


@query("""
WITH s AS (SELECT source AS task, lang, sum(length(text))::DOUBLE AS p, sum(length(source))::DOUBLE AS o, count(*) AS n FROM documents GROUP BY ALL)
SELECT task, lang, round(p / n, 6) AS avg_prompt, round(o / n, 6) AS avg_output FROM s
""")
def q_average_lengths(spark, sf_dir):
    """Average lengths from long statistics."""
    by = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("task"), "lang").agg(F.sum(F.char_length("text")).alias("total_prompt_count"), F.sum(F.char_length("source")).alias("total_output_count"), F.count("*").alias("sample_count"))
    long = by.unpivot(["task", "lang"], ["total_prompt_count", "total_output_count", "sample_count"], "measure", "value")
    return A.average_lengths(long).select("task", "lang", F.round("avg_prompt", 6).alias("avg_prompt"), F.round("avg_output", 6).alias("avg_output"))


@query("""
WITH w AS (SELECT doc_id, string_split(source || ' ' || lang || ' ' || n_chars, ' ') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS piece, generate_subscripts(w, 1) AS i FROM w)
SELECT doc_id, i - 1 AS pos, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start,
  (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS stop FROM e
""")
def q_token_spans(spark, sf_dir):
    """Where each piece of a decoded text begins and ends."""
    w = F.split(F.concat_ws(" ", "source", "lang", F.col("n_chars").cast("string")), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).withColumn("s", R.spans(F.col("w")))
    return rows.select("doc_id", F.posexplode(F.arrays_zip("w", "s")).alias("pos", "z")).select("doc_id", "pos", F.col("z.w").alias("piece"), F.col("z.s.start").alias("start"), F.col("z.s.end").alias("stop"))


@query("""
WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS l, (vec_id % 40)::INT AS p FROM embeddings)
SELECT vec_id, round(exp(list_sum(l[1:64 - p]) / (64 - p)), 6) AS padded, round(exp(list_sum(l[p + 1:]) / (64 - p)), 6) AS after_prompt FROM l
""")
def q_perplexity_variants(spark, sf_dir):
    """Perplexity of a padded sequence, and of what follows a prompt."""
    p = (F.col("vec_id") % 40).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("l"))
    mask = F.concat(F.array_repeat(F.lit(1.0), F.lit(64) - F.col("p")), F.array_repeat(F.lit(0.0), F.col("p")))
    return rows.select("vec_id", F.round(V.perplexity(F.col("l"), mask), 6).alias("padded"), F.round(V.perplexity_after(F.col("l"), F.col("p")), 6).alias("after_prompt"))


@query(f"""
WITH {_PAIRS} SELECT lang, count(*) AS n, (SELECT count(DISTINCT (conv_id, lang)) FROM pairs) AS asked, 0 AS asked_again, count(DISTINCT lang || ': ' || conv_id) AS answers FROM pairs GROUP BY lang
""")
def q_resumed_calls(spark, sf_dir):
    """Every pair's image captioned through a ledger: equal requests are asked once, a second run asks nothing."""
    rows = _pairs(spark, sf_dir).select("lang", F.col("conv_id").cast("string").alias("image"))
    ledger, call = Ledger(spark), caption_call("echo")
    first, again = ledger.ask(rows, call), ledger.ask(rows, call)
    got = ledger.answered(rows, call)
    return got.groupBy("lang").agg(F.count("*").alias("n"), F.lit(first).cast("long").alias("asked"), F.lit(again).alias("asked_again"), F.count_distinct("output").alias("answers"))


_BASE = '{"model": {"width": 64, "rate": 0.5, "name": "base"}, "k": 0, "tags": ["a"]}'


@query(f"""
WITH o AS (SELECT event_id, user_id, event_type, (props ->> 'k')::BIGINT AS k FROM events),
m AS (
  SELECT event_id, json_merge_patch('{_BASE}', json_object('k', k), CASE WHEN user_id % 3 = 0 THEN json_object('model', json_object('width', user_id, 'name', event_type)) ELSE json('{{}}') END) AS c, user_id FROM o
)
SELECT event_id, (c ->> '$.k')::BIGINT AS k, (c ->> '$.model.width')::BIGINT AS width, (c ->> '$.model.rate')::DOUBLE AS rate, c ->> '$.model.name' AS name, json_array_length(c -> '$.tags')::INT AS tags,
  CASE WHEN user_id % 7 = 0 THEN '$.tags: text for array' ELSE '' END AS conflicts FROM m
""")
def q_config_merge(spark, sf_dir):
    """An event's settings: defaults, its properties, and overrides by user, some of a wrong kind."""
    user = F.when(F.col("user_id") % 3 == 0, F.to_json(F.struct(F.struct(F.col("user_id").alias("width"), F.col("event_type").alias("name")).alias("model")))).otherwise("{}")
    wrong = F.when(F.col("user_id") % 7 == 0, '{"tags": "b"}').otherwise("{}")
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.lit(_BASE)).alias("base"), F.parse_json("props").alias("one"), F.parse_json(user).alias("two"), F.parse_json(wrong).alias("three"))
    got = C.with_overrides(rows, "base", ["one", "two", "three"], strict=False)
    at = lambda path, kind: C.setting(F.col("config"), path, kind)
    return got.select("event_id", at("$.k", "bigint").alias("k"), at("$.model.width", "bigint").alias("width"), at("$.model.rate", "double").alias("rate"), at("$.model.name", "string").alias("name"), F.size(at("$.tags", "array<string>")).alias("tags"), F.array_join("config_conflicts", "; ").alias("conflicts"))


_FRAMES = "list_transform(range(4), lambda f: list_transform(range(4), lambda p: list_transform(range(4), lambda d: embedding[(f * 16 + p * 4 + d + 1)::INT]::DOUBLE)))"


@query(f"""
WITH f AS (SELECT vec_id, {_FRAMES} AS f FROM embeddings),
v AS (SELECT vec_id, f.i AS i, p.j AS j, d.k AS k, f[(f.i + 1)::INT][(p.j + 1)::INT][(d.k + 1)::INT] AS x FROM f, range(4) f(i), range(4) p(j), range(4) d(k))
SELECT vec_id, 0 AS part, i AS row, k AS place, round(avg(x), 6) AS x FROM v GROUP BY vec_id, i, k
UNION ALL SELECT vec_id, 1, j, k, round(avg(x), 6) FROM v GROUP BY vec_id, j, k UNION ALL SELECT vec_id, 2, j, k, round(x, 6) FROM v WHERE i = 3
""")
def q_feature_pooling(spark, sf_dir):
    """Vectors as four frames of four positions: means of frames, of positions, and the last frame."""
    v = lambda f, p: F.slice("embedding", f * 16 + p * 4 + 1, 4).cast("array<double>")
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda f: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: v(f, p)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.pooled_features(frames, ("spatial", "temporal", "last")).alias("r"))
    rows = rows.select("vec_id", F.posexplode("r").alias("at", "v")).select("vec_id", "at", F.posexplode("v").alias("place", "x"))
    return rows.select("vec_id", F.floor(F.col("at") / 4).cast("int").alias("part"), (F.col("at") % 4).cast("long").alias("row"), F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v, vec_id % 50 AS p FROM embeddings),
e AS (SELECT vec_id, v, p, k.i AS i FROM v, range(8) k(i)),
s AS (SELECT *, exp(v[(i + 1)::INT] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS share, p / pow(10000.0::DOUBLE, (i % 4) / 4.0::DOUBLE) AS angle FROM e)
SELECT vec_id, i AS place, round(share, 6) AS share, round(CASE WHEN i < 4 THEN v[(i + 1)::INT] * cos(angle) - v[(i + 5)::INT] * sin(angle) ELSE v[(i + 1)::INT] * cos(angle) + v[(i - 3)::INT] * sin(angle) END, 6) AS turned FROM s
""")
def q_softmax_rotary(spark, sf_dir):
    """Shares of exponentials, and rotary positions, of eight components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip(V.softmax(F.col("v")).alias("s"), V.rotated(F.col("v"), F.col("vec_id") % 50).alias("t"))).alias("place", "z"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.round("z.s", 6).alias("share"), F.round("z.t", 6).alias("turned"))


@query("""
SELECT l_orderkey, l_linenumber, l_orderkey % 97 // 7 AS tile_row, l_partkey % 89 // 7 AS tile_column, l_orderkey % 97 AS row, l_partkey % 89 AS col FROM lineitem
""")
def q_untile(spark, sf_dir):
    """Places of a grid in tiles of seven and back."""
    y, x = F.col("l_orderkey") % 97, F.col("l_partkey") % 89
    t = O.tile(y, x, 7)
    back = O.untile(t["row"], t["column"], y % 7, x % 7, 7)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t["row"].alias("tile_row"), t["column"].alias("tile_column"), back["row"].alias("row"), back["column"].alias("col"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, [l_quantity * 15, l_extendedprice / 200, l_discount * 9000, l_tax * 5000] AS v FROM lineitem),
b AS (SELECT *, list_transform(v, lambda x, i: least(greatest(floor(x / (CASE WHEN i % 2 = 1 THEN 640.0::DOUBLE ELSE 480.0::DOUBLE END / 1000.0::DOUBLE)), 0), 999)::INT) AS b FROM p)
SELECT l_orderkey, l_linenumber, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2, round((b[3] + 0.5::DOUBLE) * 0.64::DOUBLE, 4) AS x, round((b[4] + 0.5::DOUBLE) * 0.48::DOUBLE, 4) AS y FROM b
""")
def q_point_bins(spark, sf_dir):
    """Points as location bins and back."""
    size = F.lit(640.0), F.lit(480.0)
    points = F.array(F.col("l_quantity") * 15, F.col("l_extendedprice") / 200, F.col("l_discount") * 9000, F.col("l_tax") * 5000)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", quantised_all(points, *size).alias("b")).withColumn("d", dequantised_all(F.col("b"), *size))
    return rows.select("l_orderkey", "l_linenumber", *(F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), F.round(F.get("d", F.lit(2)), 4).alias("x"), F.round(F.get("d", F.lit(3)), 4).alias("y"))
