"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(folds: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == remainder, F.lit(False))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest_vectors

    rows = _table(spark, sf_dir, "embeddings")
    return nearest_vectors(rows, rows.where("vec_id % 50 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


#: A conversation whose texts look like the template.
TRAP = r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back, text_content

    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(trap)
    back = read_back(format_conversations(turns.select("conv_id", "turn", "role", text_content(F.col("text")).alias("content"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languages import identify_language, train

    docs = _table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes

    mixed = mix_sizes(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_binary

    return token_binary(_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_quality(docs, train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", _fold(3, 1).alias("held_out"), "score", "predicted")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress_vectors

    found = compress_vectors(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_negatives

    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = mine_negatives(rows, rows.where("vec_id % 50 = 0"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP1_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND len(p.v) = len(q.v) AND p.vec_id <> q.vec_id
  WHERE list_cosine_similarity(p.v, q.v) >= 0.93
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '### ', '\2'), '<|', '\3'), ': ', '\4'))
    + length(replace(replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '### ', '\2'), '<|', '\3')) + 14 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM items p JOIN items q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN low ON a = doc_id
"""


_ASSIGNED = """
d{r} AS (
  SELECT v.n, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM parts v JOIN c{r} c ON c.part = v.part AND c.pos = v.pos GROUP BY 1, 2, 3
), a{r} AS (SELECT n, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY 1, 2)"""
_MOVED = """
m{r} AS (SELECT v.part, a.entry, v.pos, floor(sum(v.x) / count(*)::DOUBLE)::BIGINT AS x FROM parts v JOIN a{p} a ON a.n = v.n AND a.part = v.part GROUP BY 1, 2, 3),
c{r} AS (SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{p} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)"""

OP12_SQL = f"""
WITH good AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (SELECT n, len(v) // 4 AS size, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM good),
parts AS (SELECT n, i // size AS part, i % size AS pos, x FROM flat),
c0 AS (SELECT part, n - 1 AS entry, pos, x FROM parts WHERE n <= 256),
{",".join(_ASSIGNED.format(r=r) + "," + _MOVED.format(r=r + 1, p=r) for r in range(4))},
{_ASSIGNED.format(r=4)},
coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c4) AS codebooks_sha256
FROM good JOIN coded USING (n)
"""

OP13_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_nearest, op3_packing, op4_chat, op5_minhash, op6_language, op7_mixing, op8_licenses, op9_toxicity, op10_token_files, op11_quality, op12_vector_codes, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op4_chat": OP4_SQL, "op5_minhash": OP5_SQL, "op12_vector_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL}
