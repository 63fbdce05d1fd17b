from pyspark.sql import functions as F

from sparrowdex.streaming import incremental


def test_watched_files(spark):
    now = spark.createDataFrame([("src/Foo.java", "old")], "uri string, content string")
    rows = [("src/Foo.java", "Changed", 1), ("src/Bar.java", "Created", 2), ("src/Foo.java", "Deleted", 3), ("else/Other.java", "Created", 4), ("src/n.txt", "Created", 5), ("src/package-info.java", "Created", 6)]
    events = spark.createDataFrame(rows, "uri string, change_type string, seq int")
    here = incremental.applicable(events, ["src", "src/nested"])
    assert {(r.uri, r.resource_path) for r in here.collect()} == {("src/Foo.java", "Foo.java"), ("src/Bar.java", "Bar.java")}
    out = incremental.apply_events(now, here.drop("root", "resource_path"), ["seq"], lambda e: e.select("uri", F.col("seq").cast("string").alias("content")))
    assert [tuple(r) for r in out.collect()] == [("src/Bar.java", "2")]


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "uri string, version int, text string")
    now = incremental.latest_versions(v, "uri", "version", "text")
    assert {(r.uri, r.version, r.text) for r in now.collect()} == {("a", 3, "z"), ("b", 1, "q")}
    assert {(r.uri, r.version) for r in incremental.still_current(v.select("uri", "version"), now, "uri", "version").collect()} == {("a", 3), ("b", 1)}


def test_event_stream(spark, tmp_path):
    spark.createDataFrame([("a", "Changed", 1), ("a", "Deleted", 2), ("b", "Created", 3)], "uri string, change_type string, seq int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uri string, change_type string, seq int").parquet(str(tmp_path / "in"))
    seen, told = [], []

    def broken(_):
        raise RuntimeError("a listener's own failure")

    q = incremental.event_stream(stream, lambda b: seen.extend(map(tuple, b.orderBy("uri").collect())), str(tmp_path / "cp"), ["seq"], listeners=(broken, told.append))
    q.awaitTermination(120)
    assert [(u, c) for u, c, _ in seen] == [("a", "Deleted"), ("b", "Created")] and told == [0]


def test_document_store(spark, tmp_path):
    schema = "uri string, kind string, version long, text string, seq long"
    spark.createDataFrame([("a", "open", 1, "x", 1), ("a", "change", None, "y", 2), ("b", "open", 5, "q", 3), ("b", "close", None, None, 4)], schema).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    out = incremental.document_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("docs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("docs").collect()} == {("a", 2, "y"), ("b", None, None)}


def test_windowed_refreshes(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id) AS ts FROM range(100)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.windowed_refreshes(stream, width="20 seconds").writeStream.format("memory").queryName("refreshes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert all(r.events == 20 for r in spark.table("refreshes").collect()) and spark.table("refreshes").count() >= 4
