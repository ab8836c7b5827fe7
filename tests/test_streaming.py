"""Event-time windows on a stream of files against the same windows on the table."""

from pyspark.sql import functions as F

from tamarind.streaming import windows

SF = "/root/testdata/sf0.001"


def streamed(spark, folder, make, name, mode="complete"):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    return events, sorted(tuple(r) for r in spark.table(name).collect())


def test_slots(spark, tmp_path):
    def make(df):
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        return windows.slots(df, ms, ms + F.col("event_id") % 5 * 3000, 5000, ["event_type"])

    events, got = streamed(spark, tmp_path, make, "slots")
    assert got == sorted(tuple(r) for r in make(events).collect())


def test_idle_sessions(spark, tmp_path):
    def make(df):
        return windows.idle_sessions(df, "ts", "6 hours", ["user_id"], "100 days")

    events, got = streamed(spark, tmp_path, make, "sessions")
    assert got == sorted(tuple(r) for r in make(events).collect())


def test_once(spark, tmp_path):
    events, got = streamed(spark, tmp_path, lambda df: windows.once(df.unionByName(df), "ts", ["event_id"], "1000 days").select("event_id"), "once", "append")
    assert got == sorted(tuple(r) for r in events.select("event_id").collect())


def test_moving(spark, tmp_path):
    def make(df):
        return windows.moving(df, "ts", "6 hours", "1 hour", ["event_type"], F.col("event_id"), "100 days")

    events, got = streamed(spark, tmp_path, make, "moving")
    assert got == sorted(tuple(r) for r in make(events).collect())
