"""The topic language against a plain matcher over levels, and column functions on odd values."""

import itertools

import pytest
from pyspark.sql import functions as F

from tamarind.functions import topics as T
from tamarind.operators import matching
from tamarind.sources.messages import rows

LEVELS = ["", "home", "kitchen", "Küche", "$meta"]
TOPICS = sorted({"/".join(x) for n in (1, 2, 3) for x in itertools.product(LEVELS, repeat=n)} - {""} | {"/".join(["deep"] * 70), "/".join(["deep"] * 69 + ["end"])})
FILTERS = ["#", "+", "+/+", "+/#", "home", "home/#", "home/+", "home/+/kitchen", "+/kitchen/#", "$meta/#", "$meta/+", "/#", "/+", "//", "+//+", "Küche/+/#", "deep/#", "deep/deep/+/#", "/".join(["deep"] * 69 + ["+"]), "/".join(["deep"] * 80 + ["#"]), "none/#", ""]


def plain_match(topic, filter_):
    """One level after the other; ``#`` takes all that is left, none included."""
    t, f = topic.split("/"), filter_.split("/")
    if topic.startswith("$") and f[0] in ("+", "#"):
        return False
    while f:
        if f[0] == "#":
            return True
        if not t or f[0] not in ("+", t[0]):
            return False
        t, f = t[1:], f[1:]
    return not t


@pytest.mark.parametrize("join", [matching.match_theta, matching.match_topics])
def test_matches(spark, join):
    topics = rows(spark, [("one", t) for t in TOPICS], "tenant string, topic string")
    filters = rows(spark, [("one", f) for f in FILTERS] + [("other", "#")], "tenant string, filter string")
    want = {(f, t) for f in FILTERS for t in TOPICS if plain_match(t, f)}
    assert {(r.filter, r.topic) for r in join(topics, filters).collect()} == want


def test_functions(spark):
    b = lambda h: F.unhex(F.lit(h))
    one = spark.range(1).select(
        T.levels(F.lit("a//b/")).alias("levels"), T.levels(F.lit("")).alias("none"), T.unescaped(T.escaped(F.lit("x/y//"))).alias("again"),
        F.hex(T.upper_bound(b("61FF"))).alias("carry"), T.upper_bound(b("FFFF")).alias("open"), T.upper_bound(b("")).alias("empty"),
        T.from_bytes(T.to_bytes(F.lit(-5).cast("long"))).alias("minus"), T.valid_payload(b("C328")).alias("bad"), T.valid_payload(F.lit("é").cast("binary")).alias("good"),
        T.well_formed(F.lit("a\x07")).alias("bell"), T.well_formed(F.lit("a\x07"), True).alias("sane"), T.expire_at(F.lit(0).cast("long"), F.lit(T.NEVER)).alias("never"),
    ).first()
    assert one.levels == ["a", "", "b", ""] and one.none == [""] and one.again == "x/y//"
    assert one.carry == "62" and one.open is None and one.empty is None and one.minus == -5
    assert not one.bad and one.good and one.bell and not one.sane and one.never == T.NEVER * 1000
