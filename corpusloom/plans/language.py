"""Queries on what is learned from the corpus's own language: sentence boundaries and subword pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import punkt as K
from ..operators import subword as U
from .registry import query, table

_SPACE = "[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]*"
_EDGES = K.EDGES.replace("'", "''")
_BINOMIAL = "(CASE WHEN {k} <= 0 THEN 0.0 WHEN {p} <= 0 THEN -1e9::DOUBLE * {k} / {k} ELSE {k} * ln({p}) END + CASE WHEN {n} - {k} <= 0 THEN 0.0 WHEN 1 - {p} <= 0 THEN -1e9::DOUBLE ELSE ({n} - {k}) * ln(1 - {p}) END)"


def _binomial(k: str, n: str, p: str) -> str:
    return _BINOMIAL.format(k=f"({k})", n=f"({n})", p=f"({p})")


def _association(c1: str, c2: str, both: str, n: str) -> str:
    p, p1, p2 = f"{c2} / {n}", f"{both} / {c1}", f"coalesce(({c2} - {both}) / nullif({n} - {c1}, 0), 0)"
    ratio = f"2 * ({_binomial(both, c1, p1)} + {_binomial(f'{c2} - {both}', f'{n} - {c1}', p2)} - {_binomial(both, c1, p)} - {_binomial(f'{c2} - {both}', f'{n} - {c1}', p)})"
    return f"CASE WHEN {p1} > {p} THEN {ratio} ELSE 0.0 END"


_TOKENS = f"""
cut AS (SELECT doc_id, lang, regexp_extract_all(text, '{_SPACE}') AS w FROM documents),
raw AS (SELECT doc_id, lang, unnest(w) AS piece, generate_subscripts(w, 1) AS i FROM cut),
bare AS (SELECT *, regexp_replace(piece, '[ \\t\\n\\x0B\\f\\r]+$', '') AS p FROM raw),
cored AS (SELECT *, regexp_replace(p, '{_EDGES}', '', 'g') AS core FROM bare),
typed AS (
  SELECT *, CASE WHEN regexp_matches(lower(regexp_replace(core, '[.!?]+$', '')), '{K.NUMBER}') THEN '#' ELSE lower(regexp_replace(core, '[.!?]+$', '')) END AS type,
    regexp_matches(core, '\\.$') AND NOT regexp_matches(core, '\\.\\.$') AS point,
    CASE WHEN regexp_matches(p, '[,;:]["'')\\]}}»”’,;:]*$') THEN ',' WHEN regexp_matches(core, '[!?]$') THEN '!' WHEN regexp_matches(core, '\\.\\.$') THEN '..' WHEN regexp_matches(core, '\\.$') THEN '.' ELSE '' END AS fin,
    CASE WHEN regexp_matches(core, '^\\p{{Lu}}') THEN 'upper' WHEN regexp_matches(core, '^\\p{{Ll}}') THEN 'lower' ELSE 'none' END AS kase
  FROM cored
), t AS (
  SELECT *, coalesce(lag(fin) OVER w, 'start') AS before, CASE WHEN lag(point) OVER w THEN lag(type) OVER w END AS after, lead(type) OVER w AS next, lead(kase) OVER w AS next_case
  FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), by_type AS (SELECT lang, type, count(*) AS n, count(*) FILTER (WHERE point) AS pointed FROM t GROUP BY lang, type),
total AS (SELECT lang, sum(n)::DOUBLE AS tokens, sum(pointed)::DOUBLE AS points FROM by_type GROUP BY lang),
measured AS (
  SELECT b.*, length(type) - length(replace(type, '.', '')) AS inside, length(replace(type, '.', ''))::DOUBLE AS letters,
    2 * ({_binomial("pointed::DOUBLE", "n::DOUBLE", "0.99::DOUBLE")} - {_binomial("pointed::DOUBLE", "n::DOUBLE", "points / tokens")}) AS ratio
  FROM by_type b JOIN total USING (lang) WHERE pointed > 0
), types AS (
  SELECT lang, type, n, pointed, CASE WHEN regexp_matches(type, '\\p{{L}}') THEN ratio * exp(-letters) * (inside + 1) * pow(letters, -(n - pointed)::DOUBLE) ELSE 0.0 END AS score FROM measured
)"""


@query(f"WITH {_TOKENS} SELECT lang, type, n, pointed::BIGINT AS pointed, round(score, 6) + 0.0 AS score, score >= 0.3 AS abbreviation FROM types")
def q_punkt_types(spark, sf_dir):
    """What is counted and scored of each type seen with a point, by language."""
    found = K.types(K.contexts(table(spark, sf_dir, "documents"), group="lang"))
    return found.select(F.col("group").alias("lang"), "type", "n", "pointed", (F.round("score", 6) + 0.0).alias("score"), "abbreviation")


@query(f"""
WITH {_TOKENS}, abbr AS (SELECT lang, type AS a_type FROM types WHERE score >= 0.3),
placed AS (
  SELECT t.*, CASE WHEN before = '..' OR (before = '.' AND (a_type IS NOT NULL OR regexp_matches(after, '^\\p{{L}}$') OR after = '#')) THEN 'open'
    WHEN before IN ('start', '!') OR (before = '.' AND a_type IS NULL) THEN 'first' ELSE 'inside' END AS place
  FROM t LEFT JOIN abbr a ON a.lang = t.lang AND a.a_type = t.after
), spelling AS (
  SELECT lang, type, count(*)::DOUBLE AS n, count(*) FILTER (WHERE kase = 'lower') AS low, count(*) FILTER (WHERE kase = 'lower' AND place = 'first') AS low_first,
    count(*) FILTER (WHERE kase = 'upper') AS up, count(*) FILTER (WHERE kase = 'upper' AND place = 'inside') AS up_inside,
    (count(*) FILTER (WHERE place = 'first' AND before <> 'start'))::DOUBLE AS after_break FROM placed GROUP BY lang, type
), sums AS (SELECT lang, sum(n) AS tokens, sum(after_break) AS breaks FROM spelling GROUP BY lang),
starters AS (
  SELECT s.lang, type FROM spelling s JOIN sums USING (lang) WHERE regexp_matches(type, '^\\p{{L}}') AND after_break > 0
    AND {_association("breaks", "n", "after_break", "tokens")} >= 30
), pairs AS (
  SELECT lang, after, type, count(*)::DOUBLE AS together FROM placed WHERE before = '.' AND place = 'open' AND regexp_matches(type, '^\\p{{L}}') GROUP BY ALL
), collocations AS (
  SELECT p.lang, p.after, p.type FROM pairs p JOIN spelling a ON a.lang = p.lang AND a.type = p.after JOIN spelling b ON b.lang = p.lang AND b.type = p.type JOIN sums s ON s.lang = p.lang
  WHERE {_association("a.n", "b.n", "together", "tokens")} >= 7.88
), decided AS (
  SELECT t.doc_id, t.i, t.piece, t.next IS NOT NULL AND CASE
    WHEN fin = '!' THEN true WHEN fin NOT IN ('.', '..') THEN false
    WHEN NOT (fin = '..' OR a.a_type IS NOT NULL OR regexp_matches(t.type, '^\\p{{L}}$') OR t.type = '#') THEN true
    WHEN c.lang IS NOT NULL THEN false
    WHEN (a.a_type IS NOT NULL OR fin = '..') AND NOT regexp_matches(t.type, '^\\p{{L}}$') THEN
      CASE WHEN next_case = 'upper' AND s.low > 0 AND s.up_inside = 0 THEN true WHEN next_case = 'lower' AND (s.up > 0 OR s.low_first = 0) THEN false
        ELSE next_case = 'upper' AND b.lang IS NOT NULL END
    WHEN next_case = 'lower' AND (s.up > 0 OR s.low_first = 0) THEN false
    WHEN next_case = 'upper' AND s.low > 0 AND s.up_inside = 0 AND regexp_matches(t.type, '^\\p{{L}}$') THEN true
    WHEN regexp_matches(t.type, '^\\p{{L}}$') AND next_case = 'upper' AND s.low = 0 THEN false
    ELSE a.a_type IS NULL END AS ends
  FROM t LEFT JOIN abbr a ON a.lang = t.lang AND a.a_type = t.type AND t.fin = '.' LEFT JOIN spelling s ON s.lang = t.lang AND s.type = t.next
    LEFT JOIN collocations c ON c.lang = t.lang AND c.after = t.type AND c.type = t.next LEFT JOIN starters b ON b.lang = t.lang AND b.type = t.next
), numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM decided),
sentences AS (SELECT doc_id, s, trim(string_agg(piece, '' ORDER BY i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM numbered GROUP BY doc_id, s)
SELECT d.doc_id, count(sentence) AS n_sentences, md5(coalesce(string_agg(sentence, '|' ORDER BY s), '')) AS sentences FROM documents d LEFT JOIN sentences x ON x.doc_id = d.doc_id GROUP BY d.doc_id
""")
def q_punkt_sentences(spark, sf_dir):
    """Sentences of every document, by what its language's texts teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = K.learned(docs, group="lang")
    found = K.split_sentences(docs, model, "doc_id", group="lang")
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|")).alias("sentences"))


def _vocabulary(name):
    """Where a public vocabulary's file is; a path of the cluster's own does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def q_subword_statistics(spark, sf_dir):
    """Subword tokens of prompts and outputs by language; a vocabulary's merges have no SQL."""
    path = _vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = A.caption_annotations(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    return A.token_statistics(rows, lambda c: F.size(U.token_ids(c, path)))


@query()
def q_vocabulary_match(spark, sf_dir):
    """The pieces of one vocabulary that stand in the documents, how often, and what they are in another's ids."""
    new, old = _vocabulary("piece_bpe_32k.model"), _vocabulary("byte_bpe_50k.json")
    used = U.used_pieces(table(spark, sf_dir, "documents").select("text"), new)
    match = U.vocabulary_match(spark, new, old, {1: [50256], 2: [50256]})  # as many rows as the vocabulary
    return used.join(F.broadcast(match), used["id"] == match["new_id"]).select("new_id", "n", "old_ids")
