import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics as M
from corpusloom.operators import observed as O

PAIRS = [("the cat sat on the mat", ["the cat sat on a mat"]), ("a b c d e", ["a b c d e"]), ("x", ["y z"]), (None, ["q"]), ("no", None), ("red green blue white", ["red green blue white sky", "red"])]


def test_counts_come_with_the_pass(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "bb"), (None, None)], "id long, text string")
    kept, seen = O.kept_rows(df, {"no_text": F.col("text").isNull(), "no_id": F.col("id").isNull(), "empty": F.col("text") == ""}, [F.max("id").alias("greatest")])
    assert sorted(r.id for r in kept.collect()) == [1, 4] and kept.columns == ["id", "text"]
    assert seen.get == {"total": 5, "kept": 2, "skipped_no_text": 2, "skipped_no_id": 0, "skipped_empty": 1, "greatest": 4}


def test_counts_of_nothing(spark):
    kept, seen = O.kept_rows(spark.createDataFrame([], "id long"), {})
    assert kept.count() == 0 and seen.get["total"] == 0 and seen.get["kept"] == 0


def test_listener_over_three_batches(spark, tmp_path):
    place = f"file://{tmp_path}"
    for i in range(3):
        spark.createDataFrame(PAIRS[2 * i : 2 * i + 2], "prediction string, references array<string>").coalesce(1).write.mode("append").parquet(f"{place}/in")
    scores, broken = {}, []
    listener = O.listening(spark, O.Progress({"bleu": lambda no, f: scores.setdefault(no, O.bleu_value(spark, f)), "rows": lambda no, f: broken.append(1 / 0)}))
    try:
        stream = spark.readStream.schema("prediction string, references array<string>").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        stream = stream.observe("rows", *O.skip_counts(O.skips({"nothing": F.col("prediction").isNull() | F.col("references").isNull()}), ["nothing"]))
        got = []
        q = O.scored_stream(stream, "bleu").writeStream.foreachBatch(lambda b, no: got.append((no, b.count()))).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        figures = listener.wait("bleu", 3)
        listener.wait("rows", 3)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(figures) == [0, 1, 2] and sorted(scores) == [0, 1, 2]
    assert listener.totals("rows") == {"total": 6, "kept": 4, "skipped_nothing": 2} and len(listener.errors) == 3
    whole = M.bleu(spark.createDataFrame(PAIRS, "prediction string, references array<string>")).first().bleu
    assert O.bleu_value(spark, O.added(list(figures.values()))) == pytest.approx(whole)
    # each batch's score is that of its rows alone
    each = sorted(M.bleu(spark.createDataFrame(PAIRS[2 * i : 2 * i + 2], "prediction string, references array<string>")).first().bleu for i in range(3))
    assert sorted(scores.values()) == pytest.approx(each)
