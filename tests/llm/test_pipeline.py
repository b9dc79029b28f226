import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.llm import languages, toxicity
from corpusloom.llm.queries import oracle_sql, queries

from .test_dedup import plain_duplicates

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(name, same):
    same(queries()[name], oracle_sql()[name])


def test_one_query_an_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries())
    assert numbers == list(range(1, 14))


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(90_000, None, "en", "src0", 0), (90_001, "12 34", "en", "src0", 5), (90_002, "", None, None, 0)]
    return spark.read.parquet(f"{SMALL}/documents.parquet").union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_language_stage(spark, docs):
    out = P.language_id(spark, docs, SMALL)
    assert out.columns == COLUMNS
    assert set(ids(docs)) - set(ids(out)) == {90_000, 90_001, 90_002}
    assert languages.UNKNOWN not in {r.lang for r in out.collect()}


def test_toxicity_stage(spark, docs):
    out = P.toxic(spark, docs, SMALL)
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    distance = toxicity.Distance(model.toxic, model.ordinary)
    plain = {r.doc_id for r in docs.collect() if model.scores(toxicity.features(distance.lengths(toxicity.windows(r.text)), model.known)[None])[0] < 0.5}
    assert out.columns == COLUMNS and set(ids(out)) == plain


def test_dedup_stage(spark, docs):
    twice = docs.union(docs.where("doc_id = 3"))
    out = P.near_dedup(spark, twice, SMALL)
    kept = [int(d) for d, _, _, k in plain_duplicates([(r.doc_id, r.text) for r in docs.collect()]) if k]
    assert out.columns == COLUMNS and ids(out) == sorted(kept)


def test_junk_is_rejected(spark, docs):
    junk = spark.createDataFrame([(91_000, "xqzv kjwq zzxk qqpw vvbx kwjz hgfx qzxw", None, "src0", 1), (91_001, "Это русский текст о погоде", None, "src0", 1)], docs.schema)
    out = P.language_id(spark, docs.union(junk), SMALL)
    assert set(ids(docs.union(junk))) - set(ids(out)) == {90_000, 90_001, 90_002, 91_000, 91_001}


def test_rows_that_share_a_doc_id(spark):
    """Different texts survive, near copies of kept texts don't, equal rows are one, clashing names are kept."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, 0), (1, "quite another text here that is alone in the table", 0), (1, "a third text with the very same number as two others", 0), (2, long + " end", 0), (3, "x y z", 0), (3, "x y z", 0), (None, "x y z", 0), (None, None, 0), (4, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int")
    out = P.near_dedup(spark, df, SMALL)
    assert out.columns == df.columns
    got = sorted(map(str, ((r.doc_id, r.text) for r in out.collect())))
    assert got == sorted(map(str, [(1, rows[0][1]), (1, rows[1][1]), (1, rows[2][1]), (3, "x y z"), (None, "x y z"), (None, None), (4, None)]))
    assert P.near_dedup(spark, df.limit(0), SMALL).count() == 0


def test_mixing_stage(spark, docs):
    from corpusloom.llm.mixing import mix_sources

    copies = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    out = P.mixing(spark, docs, SMALL)
    assert out.columns == COLUMNS and ids(out) == sorted(d for d, n in copies.items() for _ in range(n))


def test_whole_pipeline(spark):
    pieces = P.run(spark, SMALL)
    assert [n for n, _ in P.STAGES] == ["language ID", "toxicity", "MinHash near-dedup", "mixing", "packing"]
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert by.where("n <> end or n > 2048").count() == 0 and pieces.count() > 0
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert pieces.join(start, "doc_id", "left_anti").count() == 0


def test_run_over_an_empty_table(spark, tmp_path):
    place = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    assert P.run(spark, place).count() == 0


def test_columns_that_clash_pass_all_stages(spark, docs):
    """Names that the operators use themselves keep their values through every stage but the last."""
    names = ["score", "predicted", "fit", "langs", "copies", "copy", "component_id", "kept", "key", "node", "size", "target", "__rest", "__id", "__h", "__row"]
    more = docs.where("doc_id is not null").select("*", *(F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names))
    now = more
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == more.columns, name
    rows = now.collect()
    assert rows and all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    assert P.STAGES[-1][1](spark, now, SMALL).count() > 0
