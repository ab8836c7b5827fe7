"""Ties, missing values and sizes that the small tables don't have."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tamarind import catalog
from tamarind.operators import ranges, sessions
from tamarind.sources import messages as src

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, sf, name, *tables):
    duck = duckdb.connect(config={"threads": 1})
    for t in tables:
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(sf))
    made = duck.execute(catalog.SQL[name])
    names = [d[0] for d in made.description]
    at = [names.index(c) for c in df.columns]
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got and got == sorted(repr(tuple(r[i] for i in at)) for r in made.fetchall())


@pytest.mark.parametrize("name", ["C1_counter_add", "A19_counter"])
def test_equal_versions(spark, tmp_path, name):
    """Of equal highest versions the first row counts, and a null value is none; rows lie in many row groups."""
    n = 4000
    made = {"l_orderkey": [i % 10 for i in range(n)], "l_suppkey": [i % 7 for i in range(n)], "l_linenumber": pa.array([i % 5 for i in range(n)], pa.int32()), "l_quantity": [None if i < 400 or i % 7 == 6 and i % 5 != 3 else float(i) for i in range(n)]}
    pq.write_table(pa.table(made), tmp_path / "lineitem.parquet", row_group_size=300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        same_as_sql(spark, tmp_path, name, "lineitem")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["C1_counter_add", "A19_counter"])
def test_equal_versions_of_files(spark, tmp_path, name):
    """Files sort by their names as stored: a blank comes before all else, a plus is no blank."""
    (tmp_path / "lineitem.parquet").mkdir()
    for i, file in enumerate(["a b", "a!b", "a%b", "a+b", "ab", "é"]):
        rows = {"l_orderkey": [5] * 7, "l_suppkey": [min(k, i) for k in range(7)], "l_linenumber": pa.array([1] * 7, pa.int32()), "l_quantity": [float(10 * i + k) for k in range(7)]}
        pq.write_table(pa.table(rows), tmp_path / "lineitem.parquet" / f"{file}.parquet")
    same_as_sql(spark, tmp_path, name, "lineitem")


def most_rows_of_a_task(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_split_set_tasks(spark, monkeypatch):
    """Tasks grow in number with the table, not in size; a set without a name is a set."""
    monkeypatch.setattr(src, "DEALT", 100, raising=False)
    made = catalog.QUERIES["U6_split_set"](spark, SF)
    assert most_rows_of_a_task(made) <= 100 and made.count() > 1000
    sets = src.rows(spark, [(1, None, 5), (1, 5, None), (2, None, 5), (2, 6, None), (3, None, None), (4, 5, None), (5, None, 5), (5, 5, 5), (5, 5, None), (None, None, 7), (None, 7, None)], "k long, lo long, hi long")
    assert {r.k: r.valid for r in ranges.valid_split_set(sets, ["k"]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, None: True}


@pytest.mark.parametrize("name", ["U5_merge_ranges", "U4_subtract_ranges", "U3_common_ranges"])
def test_range_tasks(spark, monkeypatch, name):
    """A supplier's ranges are one task's rows, and tasks hold few suppliers at every size."""
    monkeypatch.setattr(src, "DEALT", 200, raising=False)
    made = catalog.QUERIES[name](spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert made.rdd.getNumPartitions() == -(-rows // 200)


@pytest.mark.parametrize("name", ["W11_by_deadline", "P15_has_expired", "I11_expire", "P33_sender_alias"])
def test_session_tasks(spark, monkeypatch, name):
    """A task folds many sessions one after the other, over borders of batches, and tasks grow in number with the table."""
    monkeypatch.setattr(src, "DEALT", 50, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same_as_sql(spark, SF, name, "events")
        if name == "I11_expire":
            rows = spark.read.parquet(f"{SF}/events.parquet").count()
            assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() == -(-rows // 50)
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" not in plan  # a frame for each session
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_session_without_times(spark):
    """Requests without a time or an expiry are replayed too; they let no session end."""
    asked = [(1, 7, "attach", None, None, None, None, False), (2, 7, "detach", None, None, 5, None, False), (3, 7, "expire", None, None, 90_000, 0, False), (4, None, "attach", None, None, 0, 60, False)]
    made = sessions.replies(src.rows(spark, asked, "id long, inbox long, op string, filter string, qos long, ms long, expiry long, stale boolean"), 3)
    assert sorted((r.id, r.inbox, r.code, r.detached) for r in made.collect()) == [(1, 7, "CREATED", None), (2, 7, "OK", 5), (3, 7, "KEPT", 5), (4, None, "CREATED", None)]
