"""Published messages, subscriptions and partitions, derived from the driver's tables by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW_MS = 1704200000000
#: (client, tenant, filter, qos, no_local)
SUBSCRIPTIONS = [
    (1, "t0", "dev/3/view", 1, False), (2, "t0", "dev/+/view", 0, False), (3, "t0", "#", 2, True), (4, "t1", "dev/#", 1, False), (5, "t1", "+/+/click", 2, False), (6, "t1", "$sys/#", 1, False), (7, "t2", "+/#", 0, False),
    (8, "t2", "dev/5/", 1, False), (9, "t2", "dev/5/+", 2, False), (9, "t2", "dev/5/#", 1, False), (10, "t0", "$share/g/dev/+/click", 1, False), (11, "t0", "$share/g/dev/+/click", 2, False), (12, "t1", "$oshare/h/dev/1/#", 1, False), (13, "t1", "$oshare/h/dev/1/#", 0, False), (14, "t2", "$sys/+", 1, True),
]
#: Half-open ranges of order keys; null is open.
RANGES = [(0, None, 1000), (1, 1000, 4096), (2, 4096, 9000), (3, 9000, None)]

MESSAGES_SQL = """m as (
  select event_id, user_id as publisher, 't' || (user_id % 3) as tenant,
    case when event_id % 17 = 0 then '$sys/' || event_type when event_id % 19 = 0 then 'dev/' || (user_id % 10) || '/' else 'dev/' || (user_id % 10) || '/' || event_type end as topic,
    event_id % 3 as pub_qos, epoch_us(ts) // 1000 * 65536 + event_id % 65536 as hlc, epoch_us(ts) // 1000 as ms, 60 + event_id % 7200 as expiry,
    event_id % 5 = 0 as retain, case when event_id % 23 = 0 then '' else props end as payload from events)"""
SUBSCRIPTIONS_SQL = "s(client, tenant, filter, qos, no_local) as (values " + ", ".join(f"({c}, '{t}', '{f}', {q}, {str(n).lower()})" for c, t, f, q, n in SUBSCRIPTIONS) + ")"
RANGES_SQL = "p(range_id, lo, hi) as (values " + ", ".join(f"({i}, {'null' if a is None else a}, {'null' if b is None else b})" for i, a, b in RANGES) + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with each row's place in it: _file and _row; files sort by their names as stored, and not as Spark writes them in a path (a blank as %20)."""
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return read(spark, sf_dir, name).select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))


DEALT = 250_000  # rows of a task


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in as many tasks as keep each one's memory the same at every size; for tables, whose rows are counted in their footers."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // DEALT)), *keys)


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A literal table, planned inside the JVM."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    made = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds, strict=True))) for row in data))
    return spark.range(1).select(F.inline(made))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    topic = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("$sys/"), "event_type")).when(F.col("event_id") % 19 == 0, F.concat(F.lit("dev/"), (F.col("user_id") % 10).cast("string"), F.lit("/"))).otherwise(F.concat_ws("/", F.lit("dev"), (F.col("user_id") % 10).cast("string"), "event_type"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", F.col("user_id").alias("publisher"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"), topic.alias("topic"), (F.col("event_id") % 3).alias("pub_qos"),
        (F.shiftleft(ms, 16) + F.col("event_id") % 65536).alias("hlc"), ms.alias("ms"), (60 + F.col("event_id") % 7200).alias("expiry"), (F.col("event_id") % 5 == 0).alias("retain"),
        F.when(F.col("event_id") % 23 == 0, "").otherwise(F.col("props")).alias("payload"),
    )


def subscriptions(spark: SparkSession) -> DataFrame:
    return rows(spark, SUBSCRIPTIONS, "client long, tenant string, filter string, qos long, no_local boolean")


def ranges(spark: SparkSession) -> DataFrame:
    return rows(spark, RANGES, "range_id long, lo long, hi long")
