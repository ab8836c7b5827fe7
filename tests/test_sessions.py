"""Sessions on a stream of two batches reply as on the table; and the replay's rare cases."""

from pyspark.sql import functions as F

from tamarind import session_queries
from tamarind.operators import queues, ranges, sessions
from tamarind.sources.messages import rows

SF = "/root/testdata/sf0.001"


def test_stream(spark, tmp_path):
    requests = session_queries._requests(spark, SF)
    half = requests.agg(F.median("id")).first()[0]
    want = sorted(tuple(r) for r in sessions.replies(requests, 3).collect())
    for k, part in enumerate((requests.where(F.col("id") < half), requests.where(F.col("id") >= half))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = sessions.streamed_replies(spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in"), 3)
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(180), k
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want


def test_replay():
    day = 86_400_000
    asked = [
        (1, 7, "sub", "a", 1, 0, 0, False), (2, 7, "attach", None, None, 0, 0, False), (3, 7, "attach", None, None, 0, 60, False), (4, 7, "sub", "a", 1, 0, 0, False), (5, 7, "sub", "a", 1, 0, 0, False),
        (6, 7, "sub", "a", 0, 0, 0, False), (7, 7, "sub", "b", 0, 0, 0, False), (8, 7, "sub", "a", 0, 0, 0, False), (9, 7, "detach", None, None, 0, 60, True), (10, 7, "detach", None, None, 0, 60, False),
        (11, 7, "expire", None, None, 60_000, 0, False), (12, 7, "attach", None, None, 60_001, 5, False), (13, 7, "unsub", "a", None, day, 0, False), (14, 7, "delete", None, None, day, 0, False),
    ]
    session, made = sessions.replay(None, iter(asked), 2)
    assert [m[3] for m in made] == ["NO_INBOX", "TRANSIENT", "CREATED", "OK", "EXISTS", "OK", "OK", "EXCEED_LIMIT", "CONFLICT", "OK", "KEPT", "CREATED", "NO_SUB", "OK"]
    assert session is None and made[11][4] == 12


def test_hot_queue(spark):
    """One queue with most rows, ties in the first column, and an empty table."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(2).alias("q"), F.call_function("div", F.col("id"), F.lit(7)).alias("stamp"), "id")
    made = queues.numbered(df, ["q"], ["stamp", "id"])
    for q in (1, 2):
        got = [r.seq for r in made.where(F.col("q") == q).orderBy("stamp", "id").collect()]
        assert got == list(range(len(got)))
    assert queues.numbered(df.where("1 = 0"), ["q"], ["stamp", "id"]).count() == 0


def test_route_bounds(spark):
    """Open, touching and empty ranges; keys at the bounds."""
    r = rows(spark, [(1, None, -5), (2, -5, 10), (3, 10, 10), (4, 10, None)], "range_id int, lo long, hi long")
    keys = rows(spark, [(k,) for k in (-100, -6, -5, 9, 10, 5000)], "k long")
    assert sorted((x.k, x.range_id) for x in ranges.route(keys, r, "k").collect()) == [(-100, 1), (-6, 1), (-5, 2), (9, 2), (10, 4), (5000, 4)]
    assert ranges.route(keys.where("1 = 0"), r, "k").count() == 0
