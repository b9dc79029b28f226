"""Queries on building a corpus: annotations, enrichment, baking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as X
from ..operators import annotate as A
from ..operators import bake as B
from ..operators import enrich as E
from ..operators.order import batched, from_batch, numbered, sharded
from .registry import SENTENCES, query, table

_DOC_SENTENCES = SENTENCES.format("text")
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


@query(f"""
WITH s AS (SELECT lang, text, {_DOC_SENTENCES} AS ss FROM documents WHERE length(text) > 25),
a AS (
  SELECT lang, '<LANG_' || upper(lang) || '><CAPTION>' AS prompt, ss[1] AS output FROM s WHERE len(ss) > 0
  UNION ALL SELECT lang, '<LANG_' || upper(lang) || '><DETAILED_CAPTION>', text FROM s WHERE len(ss) = 2
  UNION ALL SELECT lang, '<LANG_' || upper(lang) || '><MORE_DETAILED_CAPTION>', text FROM s WHERE len(ss) >= 3
)
SELECT 'caption' AS type, lang, count(*) AS n, sum(length(prompt))::BIGINT AS total_prompt, max(length(prompt)) AS max_prompt, avg(length(prompt)) AS avg_prompt,
  sum(length(output))::BIGINT AS total_output, max(length(output)) AS max_output, avg(length(output)) AS avg_output
FROM a GROUP BY lang
""")
def q_annotate_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return A.token_statistics(A.caption_annotations(docs, "doc_id", "lang", "text"))


@query("SELECT doc_id, CASE WHEN length(doc_id::VARCHAR) >= 9 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 9, '0') END AS key FROM documents")
def q_key_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.padded_key(F.col("doc_id")).alias("key"))


@query(f"""
SELECT doc_id, len({_DOC_SENTENCES}) AS n_sentences,
  md5(array_to_string(list_transform({_DOC_SENTENCES}, lambda s: CASE WHEN s[1] = 'ß' THEN 'SS' ELSE upper(s[1]) END || lower(s[2:])), ' ')) AS joined
FROM documents
""")
def q_capitalize_join(spark, sf_dir):
    s = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(X.join(F.transform(s, X.capitalize))).alias("joined"))


@query(f"""
WITH s AS (SELECT doc_id, lang, {_DOC_SENTENCES} AS ss FROM documents),
m AS (SELECT *, 'The target language is ' || CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' END || '.' AS said FROM s)
SELECT doc_id, said || ' ' || CASE WHEN len(ss) >= 3 THEN 'Describe with a paragraph what is shown in the image.' WHEN len(ss) = 2 THEN 'Describe in detail what is shown in the image.' ELSE 'What does the image describe?' END AS caption_prompt,
  said || ' Translate the following text: ' || ss[1] AS translation_prompt
FROM m WHERE len(ss) > 0
""")
def q_prompt_expand(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("ss", X.sentences(F.col("text"))).where(F.size("ss") > 0)
    style = F.when(F.size("ss") >= 3, "more_detailed").when(F.size("ss") == 2, "detailed").otherwise("short")
    return rows.select(
        "doc_id",
        P.expand_prompt(P.caption_prompt(F.col("lang"), style)).alias("caption_prompt"),
        P.expand_prompt(P.translation_prompt(F.col("lang"), F.get("ss", F.lit(0)))).alias("translation_prompt"),
    )


@query(f"""
SELECT doc_id, md5({_STRIP.format("replace(text, chr(10), '')")}) AS dropped, md5({_STRIP.format("regexp_replace(text, chr(10) || '+', ' ', 'g')")}) AS flattened,
  CASE WHEN text[1] = 'ß' THEN 'SS' ELSE upper(text[1]) END AS first_char, length(text) AS chars
FROM documents
""")
def q_newline_clean(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(X.drop_newlines(t)).alias("dropped"),
        F.md5(X.flatten_newlines(t)).alias("flattened"),
        F.substring(X.upper_first(t), F.lit(1), F.char_length(F.upper(F.substring(t, 1, 1)))).alias("first_char"),
        F.char_length(t).cast("long").alias("chars"),
    )


def _pairs(spark, sf_dir):
    """User turns with the assistant turn that follows, as parallel text in five languages."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    langs = F.array(*map(F.lit, A.TRAIN_LANGS))
    return user.join(reply, ["conv_id", "turn"]).withColumn("lang", F.get(langs, F.pmod("conv_id", F.lit(5)).cast("int")))


_PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS source, a.text AS target, ['de', 'fr', 'es', 'zh', 'ru'][(u.conv_id % 5 + 1)::INT] AS lang
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
)"""


@query(f"""
WITH {_PAIRS}, s AS (SELECT *, len({SENTENCES.format("source")}) AS n_source, len({SENTENCES.format("target")}) AS n_target FROM pairs WHERE length(source) > 25)
SELECT conv_id, turn, 'translation' AS type, lang, md5('<LANG_' || upper(lang) || '><TRANSLATE>' || source) AS prompt, md5(target) AS output, n_source = n_target AND n_target > 1 AS mixable FROM s
""")
def q_translation_pairs(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where(A.long_enough(F.col("source")))
    a, n = A.annotation("translation", F.col("lang"), P.translation_prompt(F.col("lang"), F.col("source")), F.col("target")), F.size(X.sentences(F.col("target")))
    rows = rows.withColumn("a", a).withColumn("mixable", (F.size(X.sentences(F.col("source"))) == n) & (n > 1))
    return rows.select("conv_id", "turn", "a.type", "a.lang", F.md5("a.prompt").alias("prompt"), F.md5("a.output").alias("output"), "mixable")


@query(f"""
WITH {_PAIRS}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM pairs WHERE length(source) > 25
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY md5('0-' || conv_id || '-' || i)) AS o FROM kept WHERE n > 1
)
SELECT conv_id, any_value(lang) AS lang, md5(string_agg(source, ' ' ORDER BY o)) AS source, md5(string_agg(target, ' ' ORDER BY o)) AS target
FROM ranked WHERE o <= 2 + (conv_id * 7919) % (n - 1) GROUP BY conv_id
""")
def q_pseudo_paragraph(spark, sf_dir):
    rows = _pairs(spark, sf_dir).where(A.long_enough(F.col("source")))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("turn", "source", "target"))), lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target")))
    got = rows.groupBy("conv_id").agg(F.min("lang").alias("lang"), pairs.alias("pairs")).withColumn("p", A.paragraph(F.col("pairs"), F.col("conv_id")))
    return got.where("p is not null").select("conv_id", "lang", F.md5("p.source").alias("source"), F.md5("p.target").alias("target"))


@query("""
SELECT lang || '_caption' AS target, lpad(d.doc_id::VARCHAR, 9, '0') AS key, 'caption' AS type,
  '<LANG_' || upper(lang) || CASE WHEN toxic = 1 THEN '><CAPTION>' WHEN quality = 0 THEN '><DETAILED_CAPTION>' ELSE '><MORE_DETAILED_CAPTION>' END AS prompt, md5(text) AS output
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL
""")
def q_eval_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    style = F.when(F.col("toxic") == 1, "short").when(F.col("quality") == 0, "detailed").otherwise("more_detailed")
    return rows.select(F.concat("lang", F.lit("_caption")).alias("target"), X.padded_key(F.col("doc_id")).alias("key"), F.lit("caption").alias("type"), P.caption_prompt(F.col("lang"), style).alias("prompt"), F.md5("text").alias("output"))


@query("""
SELECT page_id, split_part(url, '.', 1) AS key, concat_ws('_', string_split(url, '/')[-2], string_split(url, '/')[-1]) AS image,
  split_part(url, '#', 1) AS bare, contains(url, '.jpg') AS is_jpg, CASE WHEN contains(url, 'train2014') THEN 'train2014' ELSE 'val2014' END AS folder
FROM pages
""")
def q_image_key_parse(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", B.image_key(u).alias("key"), B.url_image(u).alias("image"), B.without_fragment(u).alias("bare"), B.is_jpg(u).alias("is_jpg"), B.coco_folder(u).alias("folder"))


@query("""
SELECT source, count(*) FILTER (l.doc_id IS NOT NULL) AS present, count(*) FILTER (l.doc_id IS NULL) AS missing
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source
""")
def q_present_missing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    both = B.present(docs, labels, "doc_id").withColumn("there", F.lit(1)).union(B.missing(docs, labels, "doc_id").withColumn("there", F.lit(0)))
    return both.groupBy("source").agg(F.count_if(F.col("there") == 1).alias("present"), F.count_if(F.col("there") == 0).alias("missing"))


@query("""
WITH one AS (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1)
SELECT source, count(*) AS total, count(o.doc_id) AS baked, count(*) - count(o.doc_id) AS skipped, sum(coalesce(quality, 0))::BIGINT AS good
FROM documents d LEFT JOIN one o ON d.doc_id = o.doc_id GROUP BY source
""")
def q_bake_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    baked = B.first_match(docs, labels, "doc_id", ["quality", "toxic"]).groupBy("source").agg(F.count("*").alias("baked"), F.sum("quality").alias("good"))
    total = docs.groupBy("source").agg(F.count("*").alias("total"))
    n = F.coalesce("baked", F.lit(0))
    return total.join(baked, "source", "left").select("source", "total", n.alias("baked"), (F.col("total") - n).alias("skipped"), F.coalesce("good", F.lit(0)).cast("long").alias("good"))


@query("SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE lang = 'en' AND length(text) > 0 AND length(source) > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q_split_membership(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1")
    rows = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.length("text") > 0) & (F.length("source") > 0))
    return B.present(rows, ids, "doc_id").select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE benchmark.text = documents.text)")
def q_ignore_list(spark, sf_dir):
    return B.ignoring(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "text").select("doc_id", "n_chars")


@query("""
WITH last AS (SELECT conv_id, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, c.turn, md5(c.text) AS question, md5(reply) AS reply FROM conversations c JOIN last ON last.conv_id = c.conv_id WHERE role = 'user'
""")
def q_last_wins_lookup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    last = B.last_wins(turns.where("role = 'assistant'").withColumnRenamed("text", "reply"), "conv_id", F.col("turn"), "reply")
    return turns.where("role = 'user'").join(last, "conv_id").select("conv_id", "turn", F.md5("text").alias("question"), F.md5("reply").alias("reply"))


@query("""
WITH c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_no, conv_id, turn, text FROM conversations WHERE role = 'user'),
b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_no, item_id, text FROM benchmark)
SELECT row_no, conv_id, turn, item_id, md5(c.text) AS source, md5(b.text) AS reference FROM c JOIN b USING (row_no)
""")
def q_positional_zip(spark, sf_dir):
    left = numbered(table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("source")), "conv_id", "turn")
    right = numbered(table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("reference")), "item_id")
    return B.zipped(left, right)


@query(f"""
WITH s AS (SELECT conv_id, turn, {_DOC_SENTENCES} AS ss FROM conversations WHERE role = 'assistant'),
slots AS (SELECT conv_id, turn, unnest(ss[1:5]) AS caption, unnest(range(0, least(len(ss), 5))) AS slot FROM s)
SELECT lang, code, slot::INT AS slot, count(*) AS n, sum(length(caption))::BIGINT AS chars
FROM slots, (VALUES ('de', 'deu_Latn'), ('fr', 'fra_Latn'), ('es', 'spa_Latn'), ('zh', 'zho_Hans'), ('ru', 'rus_Cyrl')) l(lang, code) GROUP BY ALL
""")
def q_lang_fanout(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.sentences(F.col("text")).alias("captions"))
    return E.fan_out(rows, "captions").groupBy("lang", "code", "slot").agg(F.count("*").alias("n"), F.sum(F.char_length("caption")).cast("long").alias("chars"))


_DECODED = "CASE doc_id % 4 WHEN 0 THEN text || ' ### (' || source || ')' WHEN 1 THEN '(' || text WHEN 2 THEN 'aaa #' || text ELSE text END"


@query(f"""
WITH d AS (SELECT doc_id, text, {_DECODED} AS decoded FROM documents),
c AS (SELECT *, regexp_extract(decoded, '^[^(#]*') AS cut, {_STRIP.format("regexp_extract(decoded, '^[^#]*')")} AS strict FROM d),
f AS (SELECT *, length(cut) = length(decoded) OR length(cut) = 0 AS failed, length(strict) >= length(decoded) OR length(strict) = 0 OR len(list_distinct(string_split(strict, ''))) <= 5 AS failed_strict FROM c)
SELECT doc_id, failed, failed_strict, md5({_STRIP.format("CASE WHEN failed THEN text ELSE cut END")}) AS final, (avg(failed::INT) OVER ())::DOUBLE AS retry_ratio FROM f
""")
def q_translation_retry(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("decoded", F.expr(_DECODED))
    failed = X.translation_failed(F.col("decoded"))
    ratio = E.retry_ratio(d, failed)
    rows = d.select("doc_id", failed.alias("failed"), X.translation_failed_strict(F.col("decoded")).alias("failed_strict"), F.md5(X.retried(F.col("decoded"), F.col("text"))).alias("final"))
    return rows.crossJoin(F.broadcast(ratio))  # one row


_AS_ZH = "CASE lang WHEN 'fr' THEN 'zh' ELSE lang END"


@query(f"""
WITH t AS (SELECT doc_id, {_AS_ZH} AS lang, CASE WHEN doc_id % 5 = 0 THEN text || '。' ELSE text END AS text FROM documents),
s AS (SELECT *, CASE WHEN text = '' OR right(text, 1) IN ('.', '!', '?', '。', '！', '？') THEN text ELSE text || '.' END AS stopped FROM t)
SELECT doc_id, md5(CASE WHEN lang = 'zh' AND right(stopped, 1) = '.' THEN stopped[:-2] || '。' ELSE stopped END) AS fixed FROM s
""")
def q_punct_fix(spark, sf_dir):
    return _ended(spark, sf_dir, False)


@query(f"""
WITH t AS (SELECT doc_id, {_AS_ZH} AS lang, CASE WHEN doc_id % 5 = 0 THEN text || '。' ELSE text END AS text FROM documents WHERE text <> ''),
s AS (SELECT *, CASE WHEN right(text, 1) IN ('.', '!', '?') THEN text ELSE text || '.' END AS stopped FROM t)
SELECT doc_id, md5(CASE WHEN lang = 'zh' AND right(stopped, 1) = '.' THEN stopped[:-2] || '。' ELSE stopped END) AS fixed FROM s
""")
def q_punct_fix_compat(spark, sf_dir):
    return _ended(spark, sf_dir, True)


def _ended(spark, sf_dir, compat):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_AS_ZH).alias("lang"), F.expr("CASE WHEN doc_id % 5 = 0 THEN text || '。' ELSE text END").alias("text"))
    rows = rows.where("text <> ''") if compat else rows
    return rows.select("doc_id", F.md5(X.end_sentence(F.col("text"), F.col("lang"), compat)).alias("fixed"))


_DIGITS = "零一二三四五六七八九"


@query(f"""
SELECT event_id, translate(event_id::VARCHAR, '0123456789', '{_DIGITS}') || ' a ' || translate(event_id::VARCHAR, '0123456789', '{_DIGITS}') || ' 2' AS joined FROM events
""")
def q_cjk_space(spark, sf_dir):
    """Numbers in Chinese digits, written apart and joined again; other words stay apart."""
    apart = F.trim(F.regexp_replace(F.translate(F.col("event_id").cast("string"), "0123456789", _DIGITS), "(.)", "$1 "))
    return table(spark, sf_dir, "events").select("event_id", X.join_cjk(F.concat_ws(" ", apart, F.lit("a"), apart, F.lit("2"))).alias("joined"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""
WITH t AS (SELECT doc_id, lower(translate(text, {_sql_text(X.PUNCTUATION)}, '')) AS bare FROM documents)
SELECT doc_id, md5(bare) AS bare, len(list_filter(regexp_split_to_array(bare, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_tokens FROM t
""")
def q_metric_normalize(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.without_punctuation(t)).alias("bare"), F.size(X.metric_tokens(t)).cast("long").alias("n_tokens"))


@query()
def q_metric_nfkc(spark, sf_dir):
    """Tokens of the compatibility normal form, which DuckDB lacks."""
    t = X.metric_tokens(X.nfkc(F.col("text")), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(X.join(t)).alias("tokens"))


@query("""
WITH a AS (
  SELECT doc_id AS image, 0 AS src, doc_id AS row_no, lang, 'caption' AS type, text AS output FROM documents
  UNION ALL SELECT conv_id, 1, turn, 'en', 'translation', text FROM conversations WHERE role = 'assistant'
)
SELECT image, (row_number() OVER (PARTITION BY image ORDER BY src, row_no) - 1)::INT AS pos, type, lang, md5(output) AS output FROM a
""")
def q_group_by_image(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.lit(0).alias("src"), F.col("doc_id").alias("row_no"), F.lit("caption").alias("type"), "lang", F.col("text").alias("output"))
    conv = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("image"), F.lit(1).alias("src"), F.col("turn").alias("row_no"), F.lit("translation").alias("type"), F.lit("en").alias("lang"), F.col("text").alias("output"))
    out = B.grouped(docs.union(conv), "image", ["src", "row_no"], ["type", "lang", "output"])
    return out.select("image", F.posexplode("data").alias("pos", "a")).select("image", "pos", "a.type", "a.lang", F.md5("a.output").alias("output"))


@query("""
WITH u AS (
  SELECT lang, text, 'caption' AS type, 'short' AS style FROM documents
  UNION ALL SELECT lang, text, 'caption', 'detailed' FROM documents
  UNION ALL SELECT 'en', text, 'caption', 'more_detailed' FROM conversations
  UNION ALL SELECT lang, text, 'translation', NULL FROM documents
)
SELECT type, style, lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM u GROUP BY ALL
""")
def q_union_sources(spark, sf_dir):
    docs, conv = table(spark, sf_dir, "documents").select("lang", "text"), table(spark, sf_dir, "conversations").select(F.lit("en").alias("lang"), "text")
    u = B.tagged_union([(docs, "caption", "short"), (docs, "caption", "detailed"), (conv, "caption", "more_detailed"), (docs, "translation", None)])
    return u.groupBy("type", "style", "lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@query("""
WITH a AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN 'translation' ELSE 'caption' END AS type FROM documents)
SELECT doc_id, source, lang, type FROM a QUALIFY type = 'translation' OR row_number() OVER (PARTITION BY source, type, lang ORDER BY md5(doc_id::VARCHAR)) = 1
""")
def q_one_caption_per_lang(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 3 == 0, "translation").otherwise("caption").alias("type"))
    return B.one_caption_per_lang(a, "source", F.md5(F.col("doc_id").cast("string")))


@query("""
SELECT doc_id, lpad((row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1)::VARCHAR, 6, '0') AS key, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1) // 5000 AS shard FROM documents
""")
def q_shard_assign(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("o"))
    return sharded(numbered(rows, "o"), 5000).select("doc_id", "key", "shard")


@query("SELECT event_id, (props ->> 'k')::BIGINT AS k, json_object('k', (props ->> 'k')::BIGINT)::VARCHAR AS again FROM events")
def q_json_roundtrip(spark, sf_dir):
    p = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), F.to_json(p).alias("again"))


@query("""
WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id FROM documents)
SELECT doc_id, row_no, row_no // 64 AS batch FROM n WHERE row_no // 64 > 2
""")
def q_resume_offset(spark, sf_dir):
    rows = batched(numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 64)
    return from_batch(rows, 2).select("doc_id", "row_no", "batch")


_WORDS = "[^ \\t\\n\\x0B\\f\\r]+"


def _word_lengths(c):
    return F.transform(F.regexp_extract_all(c, F.lit(_WORDS), F.lit(0)), F.char_length)


_SAID = "CASE {0} " + " ".join(f"WHEN '{k[6:8]}' THEN '{v}'" for k, v in P.MODIFIERS.items()) + " END"
_ASKED = "CASE style " + " ".join(f"WHEN '{k}' THEN '{P.TASKS[t]}'" for k, t in P.STYLES.items()) + " END"
_RECORD = "md5(prompt) AS prompt, len(regexp_extract_all(prompt, '" + _WORDS + "'))::INT AS n_prompt, md5(output) AS output, (coalesce(list_sum(list_transform(regexp_extract_all(output, '" + _WORDS + "'), lambda w: length(w))), 0))::BIGINT AS ids"


def _record(df, *keys):
    total = F.aggregate("output_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(*keys, "type", "lang", F.md5("prompt").alias("prompt"), F.size("prompt_ids").alias("n_prompt"), F.md5("output").alias("output"), total.alias("ids"))


@query(f"""
WITH {_PAIRS}, r AS (
  SELECT doc_id::VARCHAR AS img_path, upper(lang) AS lang, text AS source, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS target, 'caption' AS type,
    CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'detailed' ELSE 'more_detailed' END AS style FROM documents
  UNION ALL SELECT conv_id || '-' || turn, lang, source, target, 'translation', NULL FROM pairs
), b AS (
  SELECT img_path, type, lower(lang) AS lang, {_SAID.format("upper(lang)")} || ' ' || CASE WHEN type = 'caption' THEN {_ASKED} ELSE 'Translate the following text: ' || source END AS prompt,
    CASE WHEN type = 'translation' THEN target WHEN length(target) > 0 AND lang <> 'en' THEN target ELSE source END AS output FROM r
)
SELECT img_path, type, lang, {_RECORD} FROM b
""")
def q_bake_records(spark, sf_dir):
    """Training records of captions and translations, with expanded prompts; words' lengths stand for ids."""
    docs, pairs = table(spark, sf_dir, "documents"), _pairs(spark, sf_dir)
    style = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "detailed").otherwise("more_detailed")
    captions = docs.select(F.col("doc_id").cast("string").alias("img_path"), F.upper("lang").alias("lang"), F.col("text").alias("source"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("target"), F.lit("caption").alias("type"), style.alias("style"))
    texts = pairs.select(F.concat_ws("-", "conv_id", "turn").alias("img_path"), "lang", "source", "target", F.lit("translation").alias("type"), F.lit(None).cast("string").alias("style"))
    return _record(B.baked(captions.unionByName(texts), _word_lengths), "img_path")


@query(f"""
WITH s AS (SELECT doc_id, lang, text, {_DOC_SENTENCES} AS ss FROM documents WHERE length(text) > 25),
a AS (
  SELECT doc_id, lang, 'CAPTION' AS task, ss[1] AS output FROM s WHERE len(ss) > 0
  UNION ALL SELECT doc_id, lang, 'DETAILED_CAPTION', text FROM s WHERE len(ss) = 2
  UNION ALL SELECT doc_id, lang, 'MORE_DETAILED_CAPTION', text FROM s WHERE len(ss) >= 3
), b AS (
  SELECT doc_id, 'caption' AS type, lang, '<LANG_' || upper(lang) || '><' || task || '>' AS raw, output,
    {_SAID.format("upper(lang)")} || ' ' || CASE task {" ".join(f"WHEN '{t[1:-1]}' THEN '{P.TASKS[t]}'" for t in P.STYLES.values())} END AS prompt FROM a
)
SELECT doc_id, type, lang, md5(raw) AS raw_prompt, {_RECORD.replace("md5(prompt) AS prompt, ", "")} FROM b
""")
def q_bake_annotations(spark, sf_dir):
    """Annotations with ids of their expanded prompts, which themselves stay as they are."""
    rows = A.caption_annotations(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    return _record(B.baked_annotations(rows, _word_lengths), "doc_id").withColumnRenamed("prompt", "raw_prompt")
