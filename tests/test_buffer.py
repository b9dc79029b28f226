import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import buffer as B

SCHEMA = "worker int, n long, text string"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, B.STORE)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, place, out, **how):
    """One run over the files there now; the batches' outputs, each with its number."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    got = B.shuffle_buffer(stream, "worker", F.col("n"), **how)

    def write(batch, no):
        batch.withColumn("batch", F.lit(no)).write.mode("overwrite").parquet(f"{place}/out/batch={no}")

    q = got.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def rows_of(spark, place):
    return [tuple(r) for r in spark.read.parquet(f"{place}/out").select("worker", "n", "text").collect()]


def test_nothing_is_lost_or_repeated_over_restarts(spark, store, tmp_path):
    place, bound = f"file://{tmp_path}", 20
    made = [(i % 3, i, None if i % 7 == 0 else f"t{i % 5}") for i in range(300)] + [(0, 5, "t0")] * 2
    for k in range(3):
        put(spark, f"{place}/in", made[k * 100 : (k + 1) * 100 + (2 if k == 2 else 0)])
        run(spark, place, None, bound=bound, seed=4, last=F.col("n") < 0)
        out = rows_of(spark, place)
        came = Counter(r[0] for r in made[: (k + 1) * 100 + (2 if k == 2 else 0)])
        # one out for each in, once full
        assert Counter(r[0] for r in out) == {w: max(0, c - bound) for w, c in came.items() if c > bound}
    assert not Counter(rows_of(spark, place)) - Counter(made)
    put(spark, f"{place}/in", [(w, -1, None) for w in range(3)])
    run(spark, place, None, bound=bound, seed=4, last=F.col("n") < 0)
    out = Counter(rows_of(spark, place))
    assert out - Counter({(w, -1, None): 1 for w in range(3)}) == Counter(made)


def test_order_is_random_and_bounded(spark, store, tmp_path):
    place = f"file://{tmp_path}"
    put(spark, f"{place}/in", [(1, i, "x") for i in range(400)])
    put(spark, f"{place}/in", [(1, None, None)])  # a mark alone
    stream = spark.readStream.schema(SCHEMA).parquet(f"{place}/in")
    rows = []
    q = B.shuffle_buffer(stream, "worker", F.coalesce("n", F.lit(1 << 40)), bound=50, last=F.col("n").isNull()).writeStream.foreachBatch(lambda b, i: rows.extend(r.n for r in b.collect())).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(rows) == list(range(400)) and rows != sorted(rows)
    # a record can't leave before the buffer is full of those before it
    assert all(n <= at + 50 for at, n in enumerate(rows))
    assert sum(abs(n - at) for at, n in enumerate(rows)) / 400 > 10


def test_idle_workers_are_emptied(spark, store, tmp_path):
    place = f"file://{tmp_path}"
    put(spark, f"{place}/in", [(i % 2, i, "x") for i in range(30)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{place}/in")
    rows = []
    q = B.shuffle_buffer(stream, "worker", F.col("n"), bound=100, idle_ms=500).writeStream.foreachBatch(lambda b, i: rows.extend(r.n for r in b.collect())).option("checkpointLocation", f"{place}/state").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while len(rows) < 30 and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted(rows) == list(range(30))


def test_the_query_s_batches_are_bounded(spark, monkeypatch):
    """Events of many files pass in as many micro-batches as their number asks for, and none is lost."""
    from corpusloom.plans import flows

    from .conftest import DATA

    events = spark.read.parquet(f"{DATA}/events.parquet")
    n = events.count()
    monkeypatch.setattr(flows, "EVENTS_A_FILE", -(-n // 6))
    monkeypatch.setattr(flows, "FILES_AT_ONCE", 2)
    paths = {}
    whole = flows.new_path
    monkeypatch.setattr(flows, "new_path", lambda spark, tag: paths.setdefault(tag, whole(spark, tag)))
    held = {r.worker: (r.n, r.ids, r.different) for r in flows.q_shuffle_buffer(spark, DATA).collect()}
    plain = events.groupBy((F.col("user_id") % 8).alias("worker")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).collect()
    assert held == {r.worker: (r.n, r.ids, r.n) for r in plain}
    assert len(spark.read.parquet(paths["events"]).inputFiles()) == 7
    offsets = spark.read.text(f"{paths['buffer-state']}/offsets").inputFiles()
    assert len(offsets) == 4
