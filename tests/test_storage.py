from corpusloom.storage import clear, drop, shared_dir, written


def test_tables_come_and_go(spark):
    a, b = written(spark.range(5), "One table!"), written(spark.range(3), "b")
    assert (a.count(), b.count()) == (5, 3)
    assert a.written_path.startswith(shared_dir(spark)) and "one-table" not in a.written_path.split("/")[-2]
    drop(a)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = lambda p: fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs.Path(p))
    assert not there(a.written_path) and there(b.written_path)
    clear(spark)
    assert not there(b.written_path)
