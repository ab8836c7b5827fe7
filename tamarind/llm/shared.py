"""Tables, settings and small column helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_PARTS, HOT_ROWS = 1000, 1000  # a key is hot that holds one in so many rows, and so many rows

_OWN: dict[str, str] = {}
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode alone, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tamarind-")
    return _OWN[app]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage durably."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a settled table that no later plan reads."""
    path = getattr(df, "_settled_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, id_: str, node: str, *columns: str) -> tuple[DataFrame, DataFrame | None]:
    """(node, *columns) with a number of each row, unique and not null; and (node, id_) that leads back to the ids.

    Integer ids that are unique and not null number their rows themselves, and
    nothing leads back.  All other rows are written with a number first.
    """
    if isinstance(df.schema[id_].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if df.groupBy(F.col(id_).alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null").isEmpty():
            return df.select(F.col(id_).cast("long").alias(node), *columns), None
    made = settle(df.select(F.monotonically_increasing_id().alias(node), F.col(id_).alias("_id"), *columns), "numbered")
    return made.select(node, *columns), made.select(node, F.col("_id").alias(id_))


def least_ids(found: DataFrame, back: DataFrame | None, node: str, component: str, id_: str, out: str) -> DataFrame:
    """``found`` (node, component, more) with the ids of nodes, and as ``out`` the least id of each component, null only where none of its rows has one."""
    if back is None:
        return found.select(F.col(node).alias(id_), F.col(component).alias(out), *(c for c in found.columns if c not in (node, component)))
    named = settle(found.join(back, node), "named")
    least = named.groupBy(component).agg(F.min(id_).alias(out), F.count("*").alias("_n"))
    return join_counted(named, least, component, "_n").drop(node, component, "_n")


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str) -> DataFrame:
    """Equi-join with ``right``, which has one row a key and says in ``n`` how many rows of ``left`` have it.

    Keys that hold a thousandth of these rows or more are a thousand at most:
    they are broadcast, so no task gets all rows of a hot key.  All others are shuffled.
    """
    right = settle(right, "keys")
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = (F.col(n) >= HOT_ROWS) & (F.col(n) * HOT_PARTS >= total)
    many = right.where(hot)
    if many.isEmpty():
        return left.join(right, key)
    return left.join(F.broadcast(many), key).unionByName(left.join(F.broadcast(many.select(key)), key, "left_anti").join(right.where(~hot), key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; unlike lower(), it leaves all other letters alone."""
    return F.translate(c, UPPER, LOWERED)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts, to size a shuffle by."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
