from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fathomry.streaming import changes

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, p, op, T0 + timedelta(milliseconds=ms)) for i, p, op, ms in rows], changes.EVENTS)


def test_debounce(spark):
    e = events(spark, [(1, "a", "change", 0), (2, "a", "change", 400), (3, "a", "change", 1500), (4, "b", "delete", 100)])
    got = sorted((r.path, r.n) for r in changes.debounced(e).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_merge_stream(spark, tmp_path):
    src, out = str(tmp_path / "events"), str(tmp_path / "out")
    base = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "path string, body string")
    base.write.parquet(f"{out}/0")
    state = {"n": 0}

    def save(df, number):
        if number + 1 > state["n"]:
            df.write.mode("overwrite").parquet(f"{out}/{number + 1}")
            state["n"] = number + 1

    def run():
        q = changes.merge_stream(
            changes.event_stream(spark, src), lambda: spark.read.parquet(f"{out}/{state['n']}"), lambda keys: keys.withColumn("body", F.lit("new")), save, str(tmp_path / "check")
        )
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{out}/{state['n']}").collect())

    events(spark, [(1, "a", "delete", 0), (2, "a", "change", 10), (3, "b", "change", 5), (4, "b", "delete", 9), (5, "d", "change", 1)]).write.parquet(src)
    assert run() == [("a", "new"), ("c", "old"), ("d", "new")]
    events(spark, [(6, "c", "delete", 50)]).write.mode("append").parquet(src)
    assert run() == [("a", "new"), ("d", "new")]
    assert run() == [("a", "new"), ("d", "new")]


def test_streamed_sessions_close_with_the_watermark(spark, tmp_path):
    src = str(tmp_path / "events")
    events(spark, [(1, "a", "change", 0), (2, "a", "change", 300), (3, "z", "change", 3_600_000)]).coalesce(1).write.parquet(src)
    s = changes.debounced(changes.event_stream(spark, src, late="1 second"))
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [(r.path, r.n) for r in spark.table("sessions").collect()] == [("a", 2)]


def test_windows(spark):
    e = events(spark, [(1, "a", "change", 0), (2, "b", "change", 1500), (3, "c", "delete", 1600)])
    assert sorted((r.op, r.n) for r in changes.windowed_counts(e, "1 second").collect()) == [("change", 1), ("change", 1), ("delete", 1)]
    assert sum(r.n for r in changes.windowed_counts(e, "2 seconds", "1 second").collect()) == 6
