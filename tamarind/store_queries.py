"""Queries over keys, ranges, load, replicated values, settings and column functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import topics as T
from .operators import matching, queues, ranges, replicated, sessions
from .queries import DOTS, RETAINED, M, P, _dots, _written
from .registry import query
from .sources import messages as src
from .sources.messages import read, rows
from .streaming import windows


# column functions


@query(f"with {M} select event_id, tenant || '|' || array_to_string(string_split(topic, '/'), '|') as path, len(string_split(topic, '/')) + 1 as n from m")
def P2_tenant_levels(spark, sf):
    parts = T.tenant_levels(F.col("tenant"), F.col("topic"))
    return src.messages(spark, sf).select("event_id", F.array_join(parts, "|").alias("path"), F.size(parts).cast("long").alias("n"))


@query(f"with {M} select event_id, hex(encode(replace(topic, '/', chr(0)))) as escaped, topic as again from m")
def P3_escape(spark, sf):
    made = T.escaped(F.col("topic"))
    return src.messages(spark, sf).select("event_id", F.hex(made.cast("binary")).alias("escaped"), T.unescaped(made).alias("again"))


@query(f"with {M} select event_id, '<' || replace(topic, '/', '>.<') || '>' as joined from m")
def P9_join(spark, sf):
    return src.messages(spark, sf).select("event_id", F.array_join(F.transform(T.levels(F.col("topic")), lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ".").alias("joined"))


TEXTS = "x as (select event_id, case event_id % 6 when 0 then '' when 1 then event_type when 2 then event_type || chr(0) when 3 then chr(7) || event_type when 4 then repeat('ab', 40000) else event_type || chr(128512) end as text from events)"


def _texts(spark, sf):
    kind = F.col("event_id") % 6
    text = F.when(kind == 0, "").when(kind == 1, F.col("event_type")).when(kind == 2, F.concat("event_type", F.lit("\0"))).when(kind == 3, F.concat(F.lit("\a"), "event_type")).when(kind == 4, F.repeat(F.lit("ab"), 40000))
    return read(spark, sf, "events").select("event_id", text.otherwise(F.concat("event_type", F.lit("\U0001f600"))).alias("text"))


@query(f"with {TEXTS} select event_id, event_id % 6 in (0, 1, 3) as plain, event_id % 6 in (0, 1) as sane from x")
def P10_well_formed(spark, sf):
    return _texts(spark, sf).select("event_id", T.well_formed(F.col("text")).alias("plain"), T.well_formed(F.col("text"), True).alias("sane"))


@query("select event_id, event_id % 4 = 0 as valid from events")
def P11_valid_payload(spark, sf):
    kind = F.col("event_id") % 4
    payload = F.when(kind == 0, F.col("event_type").cast("binary")).when(kind == 1, F.unhex(F.lit("C328"))).when(kind == 2, F.unhex(F.lit("6101"))).otherwise(F.unhex(F.lit("6100")))
    return read(spark, sf, "events").select("event_id", T.valid_payload(payload).alias("valid"))


@query(f"with {M}, n as (select *, case when event_id % 5 = 0 then 4294967295 else expiry end as secs from m) select event_id, ms + secs * 1000 as due from n")
def P13_expire_at(spark, sf):
    secs = F.when(F.col("event_id") % 5 == 0, F.lit(T.NEVER)).otherwise(F.col("expiry"))
    return src.messages(spark, sf).select("event_id", T.expire_at(F.col("hlc"), secs).alias("due"))


@query(f"with {M} select event_id, greatest(0, expiry - (ms + event_id % 9 * 1000000 - ms) // 1000) as seconds from m")
def P14_left_seconds(spark, sf):
    now = F.col("ms") + F.col("event_id") % 9 * 1000000
    return src.messages(spark, sf).select("event_id", F.greatest(F.lit(0), T.left_seconds(F.col("hlc"), F.col("expiry"), now)).alias("seconds"))


@query("select s_suppkey, cast(list_reduce(list_prepend(197, [ord(c) for c in string_split(s_name, '') if c <> '']), lambda h, c: (xor(h, c) * 147) & 255) as bigint) as h from supplier")
def P19_level_hash(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", T.level_hash(F.col("s_name")).cast("long").alias("h"))


@query("with h as (select c_custkey, list_reduce(list_prepend(0::bigint, [ord(c)::bigint for c in string_split(c_name, '') if c <> '']), lambda h, c: (h * 31 + c) & 4294967295) as h from customer) select c_custkey, cast(xor(h, h >> 16) & 255 as bigint) as bucket from h")
def P20_bucket(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", T.bucket(F.col("c_name")).cast("long").alias("bucket"))


@query("select o_orderkey, printf('%016X', o_orderkey) as bytes, o_orderkey as again from orders")
def P21_bytes(spark, sf):
    made = T.to_bytes(F.col("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", F.hex(made).alias("bytes"), T.from_bytes(made).alias("again"))


@query(f"with {M} select event_id, cast(length(topic) + length(payload) as bigint) as n_bytes from m")
def P22_message_size(spark, sf):
    return src.messages(spark, sf).select("event_id", (F.octet_length("topic") + F.octet_length("payload")).cast("long").alias("n_bytes"))


@query("select p_partkey, hex(encode(left(p_type, length(p_type) - 1) || chr(ord(right(p_type, 1)) + 1))) as upto from part")
def P23_upper_bound(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.hex(T.upper_bound(F.col("p_type").cast("binary"))).alias("upto"))


ASKED = [(10, 500, 1000), (11, 999, 4097), (12, None, None), (13, 9000, 9001), (14, None, 1000), (15, 4096, None)]
ASKED_SQL = "b(b, lo2, hi2) as (values " + ", ".join(f"({i}, {'null' if x is None else x}::bigint, {'null' if y is None else y}::bigint)" for i, x, y in ASKED) + ")"


def _asked(spark):
    return rows(spark, ASKED, "b int, lo2 long, hi2 long")


@query(f"with {P}, {ASKED_SQL} select range_id, o_orderkey, o_orderkey >= coalesce(lo, 0) and o_orderkey < coalesce(hi, 2 ** 62) as inside from p, orders")
def P24_inside(spark, sf):
    keys = read(spark, sf, "orders").select("o_orderkey")
    four = F.array(*(F.struct(F.lit(i).alias("range_id"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for i, lo, hi in src.RANGES))
    return keys.select("o_orderkey", F.inline(four)).select("range_id", "o_orderkey", ranges.inside(F.col("o_orderkey"), F.col("lo"), F.col("hi")).alias("inside"))


@query(f"with {P}, {ASKED_SQL}, c as (select range_id, b, case when lo is null then lo2 when lo2 is null then lo else greatest(lo, lo2) end as start, case when hi is null then hi2 when hi2 is null then hi else least(hi, hi2) end as stop, lo, hi, lo2, hi2 from p, b) select range_id, b, start, stop from c where coalesce(start, -1) < coalesce(stop, 2 ** 62)")
def P25_intersect(spark, sf):
    met = ranges.overlapping(src.ranges(spark), _asked(spark))
    start, stop = ranges.intersection(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))
    return met.select(F.col("range_id").cast("int").alias("range_id"), "b", start.alias("start"), stop.alias("stop"))


@query(f"with {P}, q as (select a.range_id as a, b.range_id as b, a.lo, b.hi from p a join p b on a.hi = b.lo) select a, b, lo, hi from q")
def U6_combine(spark, sf):
    a, b = (src.ranges(spark).select(F.col("range_id").cast("int").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}")) for n in "ab")
    met = a.join(b, F.col("hi_a") == F.col("lo_b")).where(ranges.can_combine(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")))
    lo, hi = ranges.combined(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))
    return met.select("a", "b", lo.alias("lo"), hi.alias("hi"))


@query("select l_orderkey, list(l_linenumber order by l_linenumber) = range(1, max(l_linenumber) + 1) and l_orderkey % 3 <> 0 as valid from lineitem group by l_orderkey")
def U6_split_set(spark, sf):
    """Sets of ranges made of an order's lines: whole tilings, but every third set overlaps itself."""
    line = src.dealt(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").withColumn("n", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")))
    lo, hi = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") * 10), F.when(F.col("l_linenumber") < F.col("n"), F.col("l_linenumber") * 10 + 10)
    made = line.select("l_orderkey", lo.alias("lo"), F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 1), F.lit(5)).otherwise(hi).alias("hi"))
    return ranges.valid_split_set(made, ["l_orderkey"])


@query(f"with {P} select o_orderkey, range_id, coalesce(o_orderkey > lo, true) and coalesce(o_orderkey < hi, true) as splittable from orders, p where o_orderkey >= coalesce(lo, 0) and o_orderkey < coalesce(hi, 2 ** 62)")
def P25_splittable(spark, sf):
    owned = ranges.route(read(spark, sf, "orders").select("o_orderkey"), src.ranges(spark), "o_orderkey")
    return owned.select("o_orderkey", F.col("range_id").cast("int").alias("range_id"), ranges.splittable(F.col("lo"), F.col("hi"), F.col("o_orderkey")).alias("splittable"))


@query("""with a as (select distinct l_suppkey as k, unnest(range(l_orderkey, l_orderkey + l_linenumber * 20 + 1)) as x from lineitem), b as (select distinct l_suppkey as k, unnest(range(l_orderkey, l_orderkey + l_linenumber * 5 + 1)) as x from lineitem where l_linenumber % 3 = 0),
d as (select * from a intersect select * from b), i as (select *, x - row_number() over (partition by k order by x) as g from d) select k as l_suppkey, min(x) as lo, max(x) as hi from i group by k, g""")
def U3_common_ranges(spark, sf):
    line = src.dealt(read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey")
    span = lambda df, n: df.select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber") * n).alias("hi"))
    return ranges.common_ranges(span(line, 20), span(line.where("l_linenumber % 3 = 0"), 5), ["l_suppkey"])


@query(f"with {M} select event_id, publisher || '_' || printf('%016x', hlc) as receiver, cast(publisher as varchar) as inbox, hlc as incarnation from m")
def P32_receiver_id(spark, sf):
    made = src.messages(spark, sf).withColumn("receiver", T.receiver_id(F.col("publisher"), F.col("hlc")))
    inbox, incarnation = T.parsed_receiver(F.col("receiver"))
    return made.select("event_id", "receiver", inbox.alias("inbox"), incarnation.alias("incarnation"))


@query(f"""with {P} select range_id, '{{"id":' || range_id || case when lo is null then '' else ',"lo":' || lo end || case when hi is null then '' else ',"hi":' || hi end || '}}' as json from p""")
def P31_json(spark, sf):
    return src.ranges(spark).select(F.col("range_id").cast("int").alias("range_id"), F.to_json(F.struct(F.col("range_id").alias("id"), "lo", "hi")).alias("json"))


SETTINGS = [("t0", "levels", 3), ("t1", "levels", -5), ("t1", "inbox", 200), ("t2", "retained", 30)]
DEFAULTS = [("levels", 16), ("inbox", 1000), ("retained", 10)]
SET_SQL = "st(tenant, name, value) as (values " + ", ".join(f"('{t}', '{n}', {v})" for t, n, v in SETTINGS) + "), df(name, preset) as (values " + ", ".join(f"('{n}', {v})" for n, v in DEFAULTS) + ")"


def _settings(spark, tenants):
    wanted = tenants.select("tenant", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("preset")) for n, v in DEFAULTS))).alias("d")).select("tenant", "d.*")
    given = rows(spark, SETTINGS, "tenant string, name string, given int")
    return wanted.join(given, ["tenant", "name"], "left").select("tenant", "name", F.when(F.col("given") > 0, F.col("given")).otherwise(F.col("preset")).alias("value"))


@query(f"with {M}, {SET_SQL} select t.tenant, df.name, case when st.value > 0 then st.value else preset end as value from (select distinct tenant from m) t cross join df left join st on st.tenant = t.tenant and st.name = df.name")
def P30_setting(spark, sf):
    return _settings(spark, src.messages(spark, sf).select("tenant").distinct())


@query(f"with {M}, {SET_SQL}, e as (select t.tenant, case when st.value > 0 then st.value else preset end as value from (select distinct tenant from m) t cross join df left join st on st.tenant = t.tenant and st.name = df.name where df.name = 'levels') select event_id, len(string_split(topic, '/')) <= value as allowed from m join e on e.tenant = m.tenant")
def X2_setting_applied(spark, sf):
    m = src.messages(spark, sf)
    most = _settings(spark, m.select("tenant").distinct()).where("name = 'levels'").select("tenant", "value")
    return m.join(most, "tenant").select("event_id", (F.size(T.levels(F.col("topic"))) <= F.col("value")).alias("allowed"))


QUOTAS = [("t0", "topics", 10), ("t0", "space", 100000), ("t1", "topics", 100000), ("t2", "space", 1)]


@query(RETAINED + ", qu(tenant, resource, most) as (values " + ", ".join(f"('{t}', '{r}', {n})" for t, r, n in QUOTAS) + "), us as (select tenant, 'topics' as resource, count(*) as used from t group by tenant union all select tenant, 'space', cast(sum(length(topic) + length(payload)) as bigint) from t group by tenant) select us.tenant, us.resource, used, coalesce(used < most, true) as has from us left join qu on qu.tenant = us.tenant and qu.resource = us.resource")
def X3_resources(spark, sf):
    sums = matching.retained(src.messages(spark, sf)).groupBy("tenant").agg(F.count("*").alias("topics"), F.sum(F.length("topic") + F.length("payload")).alias("space"))
    used = sums.select("tenant", F.explode(F.create_map(F.lit("topics"), "topics", F.lit("space"), "space")).alias("resource", "used"))
    quota = rows(spark, QUOTAS, "tenant string, resource string, most int")
    return used.join(quota, ["tenant", "resource"], "left").select("tenant", "resource", "used", F.coalesce(F.col("used") < F.col("most"), F.lit(True)).alias("has"))


@query(f"with {M} select tenant, case when publisher % 10 = 3 then publisher % 4 end as node, count(*) as n from m group by all")
def X5_redirected(spark, sf):
    node = F.when(F.col("publisher") % 10 == 3, F.col("publisher") % 4)  # null: stays where it is
    return src.messages(spark, sf).groupBy("tenant", node.alias("node")).agg(F.count("*").alias("n"))


# keys


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50 and l_linenumber = 1)")
def S1_lookup(spark, sf):
    asked = read(spark, sf, "lineitem").where("l_quantity = 50 and l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(asked, "o_orderkey", "left_semi")


@query("select l_orderkey + 1 as k, l_orderkey + 1 in (select o_orderkey from orders) as there from lineitem where l_linenumber = 1")
def S2_exists(spark, sf):
    asked = read(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") + 1).alias("k"))
    there = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("there"))
    return asked.join(there, "k", "left").select("k", F.coalesce("there", F.lit(False)).alias("there"))


@query("select l_orderkey, l_suppkey from lineitem where l_linenumber = 1")
def S6_first_of_group(spark, sf):
    return read(spark, sf, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")


@query("select o_orderstatus, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders group by o_orderstatus")
def S7_load_stats(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("select n_name, count(*) as stores, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as ids from supplier join nation on n_nationkey = s_nationkey group by n_name")
def S14_catalog(spark, sf):
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.count("*").alias("stores"), F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query("select o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as previous from orders")
def K1_put_previous(spark, sf):
    return queues.owners(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice", F.col("kicked").alias("previous"))


@query("select c_custkey, c_acctbal as bal from customer union all select distinct o_custkey + 100000, cast(0 as double) from orders where o_custkey + 100000 not in (select c_custkey from customer)")
def K2_insert(spark, sf):
    old = read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("bal"))
    new = read(spark, sf, "orders").select((F.col("o_custkey") + 100000).alias("c_custkey"), F.lit(0.0).alias("bal")).distinct()
    return old.unionByName(new.join(old.select("c_custkey"), "c_custkey", "left_anti"))


@query("select c_custkey, c_acctbal as previous from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def K3_delete_previous(spark, sf):
    gone = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return read(spark, sf, "customer").join(gone, "c_custkey").select("c_custkey", F.col("c_acctbal").alias("previous"))


@query("select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from lineitem x where x.l_orderkey = l.l_orderkey and x.l_returnflag = 'R')")
def K5_atomic_batches(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return line.join(line.where("l_returnflag = 'R'").select("l_orderkey").distinct(), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query(f"with {M} select tenant, count(*) as publishes, cast(sum(length(payload)) as bigint) as n_bytes, max(length(payload)) as largest, count(*) filter (retain) as retained from m group by tenant")
def K9_meter(spark, sf):
    return src.messages(spark, sf).groupBy("tenant").agg(F.count("*").alias("publishes"), F.sum(F.length("payload")).alias("n_bytes"), F.max(F.length("payload")).cast("long").alias("largest"), F.count_if("retain").alias("retained"))


@query(f"with {M}, l as (select *, row_number() over (partition by tenant, topic order by hlc desc, event_id desc) as r from m where retain) select tenant, topic, case when payload = '' then 'CLEARED' else 'RETAINED' end as result, event_id from l where r = 1")
def K10_record_retained(spark, sf):
    last = src.messages(spark, sf).where("retain").groupBy("tenant", "topic").agg(F.max_by(F.struct("payload", "event_id"), F.struct("hlc", "event_id")).alias("m"))
    return last.select("tenant", "topic", F.when(F.col("m.payload") == "", "CLEARED").otherwise("RETAINED").alias("result"), "m.event_id")


# load


@query("select l_suppkey, slot, cast(ceil(sum(ios) / count(*)) as bigint) as density, cast(sum(nanos) as bigint) // greatest(cast(sum(ios) as bigint), 1) as io_latency, cast(sum(nanos) as bigint) // count(*) as latency from (select l_suppkey, l_orderkey // 1000 as slot, cast(l_linenumber as bigint) as ios, cast(l_quantity as bigint) * 1000 as nanos from lineitem) group by l_suppkey, slot")
def A11_load_window(spark, sf):
    line = read(spark, sf, "lineitem").select("l_suppkey", F.call_function("div", F.col("l_orderkey"), F.lit(1000)).alias("slot"), F.col("l_linenumber").cast("long").alias("ios"), (F.col("l_quantity").cast("long") * 1000).alias("nanos"))
    n, ios, nanos = F.count("*"), F.sum("ios"), F.sum("nanos")
    return line.groupBy("l_suppkey", "slot").agg(F.ceil(ios / n).alias("density"), F.call_function("div", nanos, F.greatest(ios, F.lit(1))).alias("io_latency"), F.call_function("div", nanos, n).alias("latency"))


@query("with n as (select s_nationkey as store, count(*) as leaders from supplier group by 1) select store, leaders, leaders = (select max(leaders) from n) as most, leaders = (select min(leaders) from n) as least from n")
def A13_leaders(spark, sf):
    n = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("store")).agg(F.count("*").alias("leaders"))
    ends = n.agg(F.max("leaders").alias("hi"), F.min("leaders").alias("lo")).first()
    return n.select("store", "leaders", (F.col("leaders") == (ends[0] or 0)).alias("most"), (F.col("leaders") == (ends[1] or 0)).alias("least"))


@query("with n as (select s_nationkey as store, count(*) as leaders from supplier group by 1) select store, leaders, row_number() over (order by leaders desc, store) as place from n")
def W12_stores_by_leaders(spark, sf):
    n = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("store")).agg(F.count("*").alias("leaders"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("leaders").desc(), "store")).cast("long"))  # a row a store


@query("select store, count(*) as replicas, count(*) filter (voter) as voters from (select (l_suppkey + l_linenumber) % 25 as store, l_linenumber <= 3 as voter from lineitem) group by store")
def A15_replicas(spark, sf):
    line = read(spark, sf, "lineitem").select(((F.col("l_suppkey") + F.col("l_linenumber")) % 25).alias("store"), (F.col("l_linenumber") <= 3).alias("voter"))
    return line.groupBy("store").agg(F.count("*").alias("replicas"), F.count_if("voter").alias("voters"))


@query("with recursive n as (select user_id, event_id, cast(value * 100 as bigint) + 1 as v, row_number() over (partition by user_id order by event_id) as k from events), r as (select user_id, k, event_id, v as ema from n where k = 1 union all select n.user_id, n.k, n.event_id, cast(ceil(r.ema * 0.75 + n.v * 0.25) as bigint) from r join n on n.user_id = r.user_id and n.k = r.k + 1) select user_id, max(k) as n, arg_max(ema, k) as ema from r group by user_id")
def A16_moving_average(spark, sf):
    """The exponential average is a fold in order; an inbox's values are one ordered array of numbers."""
    e = read(spark, sf, "events").select("user_id", "event_id", (F.round("value", 2) * 100).cast("decimal(20,2)").cast("long").alias("v0"), "value")
    v = e.withColumn("v", F.bround(F.col("value") * 100).cast("long") + 1)
    got = v.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "v"))).alias("vs"))
    fold = F.aggregate("vs", F.lit(0).cast("long"), lambda a, x: F.when(a == 0, x["v"]).otherwise(F.ceil(a * F.lit(0.75) + x["v"] * F.lit(0.25))))
    return got.select("user_id", F.size("vs").cast("long").alias("n"), fold.alias("ema"))


@query(f"with {P}, c as (select range_id, count(*) as n, cast(sum(cast(o_totalprice * 100 as bigint)) as bigint) as cents from orders, p where o_orderkey >= coalesce(lo, 0) and o_orderkey < coalesce(hi, 2 ** 62) group by range_id) select sum(n)::bigint as n, sum(cents)::bigint as cents, count(*) as parts from c")
def A20_scatter_gather(spark, sf):
    cents = F.bround(F.col("o_totalprice").cast("double") * 100).cast("long")
    part = ranges.route(read(spark, sf, "orders").select("o_orderkey", cents.alias("cents")), src.ranges(spark), "o_orderkey").groupBy("range_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return part.agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.count("*").alias("parts"))


# replicated values


@query("select l_suppkey as uri, l_linenumber % 4 as replica, max(l_orderkey * 10 + l_linenumber) as ver, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) + 5 as value from lineitem group by 1, 2")
def C1_counter_add(spark, sf):
    """Each replica adds 5 to what it wrote last, under a version of its own."""
    return replicated.last_written(_written(spark, sf)).withColumn("value", F.col("value") + 5)


@query(DOTS + " select uri, exists (select 1 from a where a.uri = d.uri and value = 'N') as enabled from d group by uri")
def C3_enable_wins(spark, sf):
    d, replaced = _dots(spark, sf)
    alive = replicated.merge(d, replaced, ["uri", "replica", "ver"]).where("value = 'N'").select("uri", F.lit(True).alias("on")).distinct()
    return d.select("uri").distinct().join(alive, "uri", "left").select("uri", F.coalesce("on", F.lit(False)).alias("enabled"))


@query(DOTS + " select uri, not exists (select 1 from a where a.uri = d.uri and value = 'R' and l_partkey % 9 = 0) as enabled from d group by uri")
def C4_disable_wins(spark, sf):
    d, replaced = _dots(spark, sf)
    off = replicated.merge(d, replaced, ["uri", "replica", "ver"]).where("value = 'R' and l_partkey % 9 = 0").select("uri", F.lit(True).alias("off")).distinct()
    return d.select("uri").distinct().join(off, "uri", "left").select("uri", F.col("off").isNull().alias("enabled"))


@query(DOTS + " select uri || '/' || value || '/' || (l_partkey % 3) as path, case l_partkey % 3 when 0 then 'counter' when 1 then 'register' else 'set' end as kind, count(*) as dots, max(ver) as ver from a group by uri, value, l_partkey % 3")
def C7_nested_map(spark, sf):
    d, replaced = _dots(spark, sf)
    alive = replicated.merge(d, replaced, ["uri", "replica", "ver"])
    path = F.array(F.col("uri").cast("string"), F.col("value"), (F.col("l_partkey") % 3).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("counter", "register", "set"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    return alive.groupBy(F.array_join(path, "/").alias("path"), kind.alias("kind")).agg(F.count("*").alias("dots"), F.max("ver").alias("ver"))


@query(DOTS + " select uri, replica, ver from a")
def C8_join(spark, sf):
    d, replaced = _dots(spark, sf)
    once = replicated.merge(d, replaced, ["uri", "replica", "ver"])
    return replicated.merge(once.unionByName(d), replaced, ["uri", "replica", "ver"]).select("uri", "replica", "ver")


LEADERS = """l as (select l_suppkey, l_linenumber // 3 as epoch, l_orderkey * 10 + l_linenumber as id, case when l_partkey % 17 > 0 then l_partkey end as lo, case when l_partkey % 19 > 0 then l_partkey + 5 + l_linenumber * 3 end as hi from lineitem where l_returnflag <> 'R')"""


@query(f"""with recursive {LEADERS}, f as (select *, row_number() over (partition by l_suppkey order by lo nulls first, id) as k from l x where epoch = (select min(epoch) from l y where y.l_suppkey = x.l_suppkey)),
t as (select a.l_suppkey, a.k, min(b.k) as then_k from f a join f b on a.l_suppkey = b.l_suppkey and b.lo >= a.hi group by all),
r as (select l_suppkey, k from f where k = 1 union all select r.l_suppkey, t.then_k from r join t on t.l_suppkey = r.l_suppkey and t.k = r.k) select l_suppkey, epoch, lo, id, hi from f join r using (l_suppkey, k)""")
def A14_effective_route(spark, sf):
    """A supplier stands for a service, its lines that were not returned for leaders of ranges."""
    part = F.col("l_partkey")
    led = read(spark, sf, "lineitem").where("l_returnflag <> 'R'").select(
        "l_suppkey", F.call_function("div", F.col("l_linenumber"), F.lit(3)).alias("epoch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(part % 17 > 0, part).alias("lo"), F.when(part % 19 > 0, part + 5 + F.col("l_linenumber") * 3).alias("hi"),
    )
    return ranges.effective_route(led, ["l_suppkey"])


@query("""with e as (select l_orderkey, l_linenumber, case when l_partkey % 4 = 0 then l_returnflag end as value, l_suppkey as stamp from lineitem), b as (select x.l_orderkey, x.l_linenumber, y.value, exists (select 1 from lineitem z where z.l_orderkey = y.l_orderkey and z.l_linenumber in (y.l_linenumber + 1, y.l_linenumber + 2)) as replaced from e x join e y on y.l_orderkey = x.l_orderkey and y.l_linenumber in (x.l_linenumber + 1, x.l_linenumber + 2))
select l_orderkey, l_linenumber from e where value is null and stamp < 40 and not exists (select 1 from b where b.l_orderkey = e.l_orderkey and b.l_linenumber = e.l_linenumber and (b.value is not null or not b.replaced))""")
def C10_compact(spark, sf):
    """An order's lines stand for events, each replaced by the next two."""
    line = read(spark, sf, "lineitem")
    events = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 4 == 0, F.col("l_returnflag")).alias("value"), F.col("l_suppkey").alias("at"))
    ends = line.select(F.col("l_orderkey").alias("by_l_orderkey"), F.col("l_linenumber").alias("by_l_linenumber"))
    older = ends.select("*", F.col("by_l_orderkey").alias("l_orderkey"), F.explode(F.array(F.col("by_l_linenumber") - 1, F.col("by_l_linenumber") - 2)).alias("l_linenumber")).where("l_linenumber > 0")
    return replicated.compactable(events, older, ["l_orderkey", "l_linenumber"], 40).select("l_orderkey", "l_linenumber")


@query("select l_suppkey, count(*) filter (l_linenumber <= 4) as mine, count(*) filter (l_linenumber % 2 = 0) as theirs, count(*) filter (l_linenumber <= 4 or l_linenumber % 2 = 0) as mine_after, count(*) filter (l_linenumber <= 4 or l_linenumber % 2 = 0) as theirs_after from lineitem group by 1")
def R12_exchange(spark, sf):
    """Two peers with parts of the lines, before and after each sent the other what it lacks."""
    line = read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    mine, theirs = line.where("l_linenumber <= 4"), line.where("l_linenumber % 2 = 0")
    keys = ["l_orderkey", "l_linenumber"]
    states = {"mine": mine, "theirs": theirs, "mine_after": replicated.exchange(mine, theirs, keys), "theirs_after": replicated.exchange(theirs, mine, keys)}
    each = [df.select("l_suppkey", *((F.lit(1) if n == name else F.lit(0)).alias(n) for n in states)) for name, df in states.items()]
    every = line.select("l_suppkey", *(F.lit(0).alias(n) for n in states))
    for df in each:
        every = every.unionByName(df)
    return every.groupBy("l_suppkey").agg(*(F.sum(n).alias(n) for n in states))


ALIASES = 3


@query(f"""with recursive {M}, s as (select publisher, event_id, topic, row_number() over (partition by publisher order by event_id) as k from m),
r as (select publisher, 0::bigint as k, 0::bigint as event_id, 0::bigint as alias, false as fresh, []::struct(n bigint, a bigint, t varchar)[] as st from (select distinct publisher from s)
 union all
 select publisher, k, event_id, case when old then list_filter(st, lambda x: x.t = topic)[1].a when room then len(st) + 1 else list_sort(st)[1].a end, not old,
  case when old then list_transform(st, lambda x: {{'n': case when x.t = topic then x.n + 1 else x.n end, 'a': x.a, 't': x.t}}) when room then list_append(st, {{'n': 1::bigint, 'a': (len(st) + 1)::bigint, 't': topic}}) else list_append(list_sort(st)[2:], {{'n': 1::bigint, 'a': list_sort(st)[1].a, 't': topic}}) end
 from (select s.*, st, len(list_filter(st, lambda x: x.t = topic)) > 0 as old, len(st) < {ALIASES} as room from r join s on s.publisher = r.publisher and s.k = r.k + 1))
select event_id, alias, fresh from r where k > 0""")
def P33_sender_alias(spark, sf):
    sent = src.messages(spark, sf).select("publisher", F.col("event_id").alias("id"), "topic")
    return sessions.sender_aliases(sent, "publisher", ALIASES).withColumnRenamed("id", "event_id")


@query("select event_type, s as start_ms, cast(sum(cast(round(value * 100) as bigint)) as bigint) as total, count(*) as n from (select event_type, value, unnest([(epoch_us(ts) // 3600000000 - i) * 3600000 for i in range(6)]) as s from events) group by all")
def R4_sliding(spark, sf):
    """The form of the moving average that runs on streams too."""
    return windows.moving(read(spark, sf, "events"), "ts", "6 hours", "1 hour", ["event_type"], F.round(F.col("value") * 100).cast("long"))
