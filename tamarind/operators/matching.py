"""Topic and filter joins, retained messages, and publish fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import topics as T

def match_theta(topics: DataFrame, filters: DataFrame) -> DataFrame:
    """Reference form: every topic against every filter of its tenant."""
    return topics.join(filters, (topics["tenant"] == filters["tenant"]) & T.matches(F.col("topic"), T.plain_filter(F.col("filter")))).drop(filters["tenant"])


def match_topics(topics: DataFrame, filters: DataFrame) -> DataFrame:
    """Hash equi-join: a topic is masked with each shape of filter that fits its depth, and looked up by what it then reads.

    There are far fewer shapes than filters.  Shapes meet topics by number of
    levels, those that end in ``#`` at each number from theirs to the deepest topic's.
    """
    filters = filters.withColumn("_plain", T.plain_filter(F.col("filter")))
    # one masked row a topic and shape that fits; topics repeat in messages, so only distinct ones are masked
    names = topics.select("tenant", "topic").distinct().withColumn("_at", F.size(T.levels(F.col("topic"))))
    deepest = names.agg(F.coalesce(F.max("_at"), F.lit(0))).first()[0]
    shapes = filters.select("tenant", T.shape(F.col("_plain")).alias("shape")).distinct()
    shapes = shapes.withColumns({"many": T.is_multi_wildcard(F.col("shape")), "depth": F.size(T.levels(F.col("shape")))})
    below = F.when(F.col("depth") - 1 <= deepest, F.sequence(F.col("depth") - 1, F.greatest(F.col("depth") - 1, F.lit(deepest))))  # none for a shape that is deeper than all topics
    shapes = shapes.select("tenant", "shape", F.explode(F.when(F.col("many"), below).otherwise(F.array("depth"))).alias("_at"))
    tried = names.join(shapes, ["tenant", "_at"]).select("tenant", "topic", T.masked(F.col("topic"), F.col("shape")).alias("_plain")).where("_plain is not null")
    found = tried.join(filters, ["tenant", "_plain"]).drop("_plain")
    return topics.join(found, ["tenant", "topic"])


def retained(messages: DataFrame) -> DataFrame:
    """Last retained message per tenant and topic; an empty payload clears."""
    last = messages.where("retain").groupBy("tenant", "topic").agg(F.max_by(F.struct("payload", "hlc", "expiry", "pub_qos", "event_id"), F.struct("hlc", "event_id")).alias("m"))
    return last.select("tenant", "topic", "m.*").where(F.length("payload") > 0)


def alive(table: DataFrame, now_ms: int) -> DataFrame:
    return table.where(T.expire_at(F.col("hlc"), F.col("expiry")) > now_ms)


def expired(table: DataFrame, now_ms: int, override: int | None = None) -> DataFrame:
    """What garbage collection removes; an override replaces each message's own expiry."""
    return table.where(T.expire_at(F.col("hlc"), F.lit(override) if override is not None else F.col("expiry")) <= now_ms)


def match_retained(table: DataFrame, filters: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Live retained messages of each filter, the first ``limit`` by topic."""
    found = match_topics(alive(table, now_ms), filters.select("tenant", "filter").distinct())
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("tenant", "filter").orderBy("topic"))).where(F.col("rank") <= limit)


def deliveries(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """One row a message and receiver: normal subscriptions all, one member of each share group.

    An unordered group spreads messages over its members, an ordered one keeps a
    publisher with a member.  The effective quality is the lower one.
    """
    routed = match_topics(messages, subs).withColumns({"kind": T.share_kind(F.col("filter")), "eff_qos": F.least("pub_qos", "qos")})
    routed = routed.where(~(F.col("no_local") & (F.col("publisher") == F.col("client"))))
    normal = routed.where("kind = 'normal'")
    key = F.when(F.col("kind") == "ordered", F.col("publisher")).otherwise(F.col("event_id"))
    pick = F.row_number().over(Window.partitionBy("event_id", "filter").orderBy(F.pmod(key * 31 + F.col("client") * 17, F.lit(101)), "client"))
    return normal.unionByName(routed.where("kind <> 'normal'").withColumn("_n", pick).where("_n = 1").drop("_n"))
