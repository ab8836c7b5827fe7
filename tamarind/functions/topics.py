"""Column functions for topics, filters and hybrid timestamps; all stay inside Spark's JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the topic language.
SEPARATOR, ONE, MANY, SYSTEM = "/", "+", "#", "$"
SHARED, ORDERED = "$share/", "$oshare/"
NEVER = 0xFFFFFFFF  # an expiry that is given as never; its seconds are added like any others


def levels(topic: Column) -> Column:
    """Levels between separators, empty ones kept."""
    return F.split(topic, SEPARATOR, -1)


def is_multi_wildcard(f: Column) -> Column:
    return F.endswith(f, F.lit(MANY))


def is_wildcard(f: Column) -> Column:
    return F.contains(f, F.lit(ONE)) | is_multi_wildcard(f)


def share_kind(f: Column) -> Column:
    return F.when(F.startswith(f, F.lit(SHARED)), "unordered").when(F.startswith(f, F.lit(ORDERED)), "ordered").otherwise("normal")


def share_group(f: Column) -> Column:
    return F.when(share_kind(f) != "normal", F.element_at(levels(f), 2))


def plain_filter(f: Column) -> Column:
    """The filter without a share prefix."""
    parts = levels(f)
    return F.when(share_kind(f) != "normal", F.array_join(F.slice(parts, F.lit(3), F.size(parts)), SEPARATOR)).otherwise(f)


def literal_prefix(f: Column) -> Column:
    """Leading levels without a wildcard."""
    parts = levels(f)
    first = F.array_min(F.filter(F.transform(parts, lambda x, i: F.when(x.isin(ONE, MANY), i)), lambda i: i.isNotNull()))
    return F.slice(parts, F.lit(1), F.coalesce(first, F.size(parts)))


def valid_topic(t: Column, level: int = 40, most: int = 16, length: int = 255) -> Column:
    parts = levels(t)
    sized = (F.length(t) > 0) & (F.length(t) <= length) & (F.size(parts) <= most) & F.forall(parts, lambda x: F.length(x) <= level)
    return sized & ~F.rlike(t, F.lit(r"[+#\x00]")) & ~F.startswith(t, F.lit(SHARED)) & ~F.startswith(t, F.lit(ORDERED))


def valid_filter(f: Column, level: int = 40, most: int = 16, length: int = 255) -> Column:
    body = plain_filter(f)
    parts = levels(body)
    n = F.size(parts)
    shared = share_kind(f) != "normal"
    good = F.forall(F.transform(parts, lambda x, i: (F.length(x) <= level) & (~F.contains(x, F.lit(ONE)) | (x == ONE)) & (~F.contains(x, F.lit(MANY)) | ((x == MANY) & (i == n - 1)))), lambda ok: ok)
    name = (F.length(share_group(f)) > 0) & ~F.rlike(share_group(f), F.lit("[+#]")) & (F.size(levels(f)) > 2)
    return (F.length(body) > 0) & (F.length(body) <= length) & (n <= most) & good & ~F.contains(f, F.lit("\0")) & (~shared | F.coalesce(name, F.lit(False)))


def shape(f: Column) -> Column:
    """The filter with each literal level replaced by ``=``."""
    return F.array_join(F.transform(levels(f), lambda x: F.when(x.isin(ONE, MANY), x).otherwise("=")), SEPARATOR)


def matches(topic: Column, f: Column) -> Column:
    """``+`` is one level; a last ``#`` is the parent and all below; neither matches a first level with ``$``."""
    t, g = levels(topic), levels(f)
    n = F.size(g)
    many = F.element_at(g, -1) == MANY
    length = F.when(many, F.size(t) >= n - 1).otherwise(F.size(t) == n)
    same = F.forall(F.transform(g, lambda x, i: (x == MANY) | ((x == ONE) & (i < F.size(t))) | F.coalesce(x == F.get(t, i), F.lit(False))), lambda ok: ok)
    system = F.startswith(topic, F.lit(SYSTEM)) & F.element_at(g, 1).isin(ONE, MANY)
    return length & same & ~system


def masked(topic: Column, shape_: Column) -> Column:
    """What a filter of that shape must read to match the topic; null if none can."""
    t, g = levels(topic), levels(shape_)
    n = F.size(g)
    many = F.element_at(g, -1) == MANY
    fits = F.when(many, F.size(t) >= n - 1).otherwise(F.size(t) == n) & ~(F.startswith(topic, F.lit(SYSTEM)) & F.element_at(g, 1).isin(ONE, MANY))
    return F.when(fits, F.array_join(F.transform(g, lambda x, i: F.when(x == "=", F.get(t, i)).otherwise(x)), SEPARATOR))


def physical_ms(hlc: Column) -> Column:
    return F.shiftright(hlc, 16)


def expire_at(hlc: Column, seconds: Column) -> Column:
    return physical_ms(hlc) + seconds.cast("long") * 1000


def left_seconds(hlc: Column, seconds: Column, now_ms: Column) -> Column:
    """Seconds left on delivery, whole ones; below 0 is expired."""
    return seconds - F.call_function("div", now_ms - physical_ms(hlc), F.lit(1000))


def tenant_levels(tenant: Column, topic: Column) -> Column:
    return F.concat(F.array(tenant), levels(topic))


def escaped(topic: Column) -> Column:
    return F.replace(topic, F.lit(SEPARATOR), F.lit("\0"))


def unescaped(topic: Column) -> Column:
    return F.replace(topic, F.lit("\0"), F.lit(SEPARATOR))


UNACCEPTABLE = r"[\p{Cc}\p{Cn}]"  # control and unassigned characters


def well_formed(text: Column, sane: bool = False) -> Column:
    """At most 65535 UTF-16 units, no NUL, no character beyond the basic plane, and with ``sane`` no control or non-character."""
    ok = (F.length(text) <= 65535) & ~F.contains(text, F.lit("\0")) & ~F.rlike(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return ok & ~F.rlike(text, F.lit(UNACCEPTABLE)) if sane else ok


def valid_payload(payload: Column) -> Column:
    """Bytes that are UTF-8 without control or non-characters."""
    text = payload.cast("string")
    return F.is_valid_utf8(text) & ~F.contains(text, F.lit("\0")) & ~F.rlike(F.make_valid_utf8(text), F.lit(UNACCEPTABLE))


def level_hash(level: Column) -> Column:
    """The low byte of the 32-bit FNV-1a hash over the level's characters."""
    chars = F.filter(F.split(level, "", -1), lambda c: c != "")
    return F.aggregate(chars, F.lit(0xC5), lambda h, c: (h.bitwiseXOR(F.ascii(c).bitwiseAND(F.lit(255))) * 0x93).bitwiseAND(F.lit(255)))


def bucket(text: Column, buckets: int = 256) -> Column:
    """Bucket of a name by the polynomial string hash with multiplier 31, folded once."""
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(buckets - 1))


def to_bytes(n: Column) -> Column:
    """A long as eight bytes, big end first."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def from_bytes(b: Column) -> Column:
    return F.conv(F.hex(b), 16, -10).cast("long")


def upper_bound(key: Column) -> Column:
    """The least bytes above all that begin with ``key``; null, an open end, if there are none."""
    kept = F.regexp_extract(F.hex(key), "^((?:..)*?)(?:FF)*$", 1)
    last = F.conv(F.right(kept, F.lit(2)), 16, 10).cast("int") + 1
    return F.when(F.length(kept) > 0, F.unhex(F.concat(F.left(kept, F.length(kept) - 2), F.lpad(F.hex(last), 2, "0"))))


def receiver_id(inbox: Column, incarnation: Column) -> Column:
    return F.concat_ws("_", inbox.cast("string"), F.lower(F.lpad(F.hex(incarnation), 16, "0")))


def parsed_receiver(receiver: Column) -> tuple[Column, Column]:
    """Inbox and incarnation of a receiver id; the inbox may hold the separator itself."""
    cut = F.length(receiver) - 16
    return F.substring(receiver, F.lit(1), cut - 1), F.conv(F.right(receiver, F.lit(16)), 16, -10).cast("long")
