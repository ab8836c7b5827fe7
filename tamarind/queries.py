"""Queries over the driver's tables, keyed by the operator inventory's ids, and independently phrased SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import topics as T
from .registry import query
from .operators import matching, queues, ranges, replicated
from .sources import messages as src
from .sources.messages import MESSAGES_SQL as M
from .sources.messages import NOW_MS, read, rows
from .sources.messages import RANGES_SQL as P
from .sources.messages import SUBSCRIPTIONS_SQL as S
from .streaming import windows

FILTERS = ["a/b", "+", "+/+", "#", "/#", "a/+/#", "a/#/b", "a+/b", "", "/", "$share/g/a/+", "$share//a", "$oshare/h/#", "$share/g", "a/b#", "$sys/+"]


def _filters(spark: SparkSession) -> DataFrame:
    return rows(spark, [(f,) for f in FILTERS], "filter string")


F_SQL = "f(filter) as (values " + ", ".join(f"('{f}')" for f in FILTERS) + ")"
#: Independent phrasing of matching: the filter as an anchored regular expression.
RX = r"regexp_full_match(topic, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(plain, '$', '\$'), '\+', '[^/]*', 'g'), '^#$', '(?s:.*)'), '/#$', '(?:/(?s:.*))?'), '^\[\^/\]\*#', '')) and not (topic like '$%' and (plain like '+%' or plain like '#%'))"
SP = "sp as (select *, case when filter like '$share/%' or filter like '$oshare/%' then regexp_replace(filter, '^\\$o?share/[^/]*/', '') else filter end as plain from s)"
MATCHED = f"with {M}, {S}, {SP}, j as (select m.*, client, filter, qos, no_local from m join sp on m.tenant = sp.tenant and {RX})"


@query(f"with {M} select topic, count(*) as n, len(string_split(topic, '/')) as depth, string_split(topic, '/')[1] as head, string_split(topic, '/')[-1] as leaf from m group by topic")
def P1_parse(spark, sf):
    m = src.messages(spark, sf).groupBy("topic").agg(F.count("*").alias("n"))
    parts = T.levels(F.col("topic"))
    return m.select("topic", "n", F.size(parts).cast("long").alias("depth"), F.element_at(parts, 1).alias("head"), F.element_at(parts, -1).alias("leaf"))


@query(f"with {M} select event_id, length(topic) between 1 and 255 and not regexp_matches(topic, '[+#]') and len(string_split(topic, '/')) <= 3 and topic not like '$share/%' and topic not like '$oshare/%' and list_max([length(x) for x in string_split(topic, '/')]) <= 8 as valid from m")
def P4_valid_topic(spark, sf):
    return src.messages(spark, sf).select("event_id", T.valid_topic(F.col("topic"), 8, 3).alias("valid"))


@query(f"""with {F_SQL}, g as (select filter, case when filter like '$share/%' or filter like '$oshare/%' then regexp_replace(filter, '^\\$o?share/[^/]*/?', '') else filter end as b, filter like '$share/%' or filter like '$oshare/%' as sh from f)
select filter, b <> '' and not regexp_matches(b, '[^/]\\+|\\+[^/]|[^/]#|#.') and (not sh or regexp_matches(filter, '^\\$o?share/[^/+#]+/')) as valid,
  contains(filter, '+') or ends_with(filter, '#') as wildcard, case when filter like '$share/%' then 'unordered' when filter like '$oshare/%' then 'ordered' else 'normal' end as kind from g""")
def P5_valid_filter(spark, sf):
    f = F.col("filter")
    return _filters(spark).select("filter", F.coalesce(T.valid_filter(f), F.lit(False)).alias("valid"), T.is_wildcard(f).alias("wildcard"), T.share_kind(f).alias("kind"))


@query(f"with {S} select client, filter, case when filter like '$share/%' or filter like '$oshare/%' then string_split(filter, '/')[2] end as grp, case when filter like '$share/%' or filter like '$oshare/%' then regexp_replace(filter, '^\\$o?share/[^/]*/', '') else filter end as plain from s")
def P8_matcher(spark, sf):
    return src.subscriptions(spark).select("client", "filter", T.share_group(F.col("filter")).alias("grp"), T.plain_filter(F.col("filter")).alias("plain"))


@query(f"with {M} select event_id, hlc // 65536 as ms, (hlc // 65536) + expiry * 1000 as expire_at, expiry - ({NOW_MS} - (hlc // 65536)) // 1000 as secs from m")
def P12_hlc(spark, sf):
    m = src.messages(spark, sf)
    return m.select("event_id", T.physical_ms(F.col("hlc")).alias("ms"), T.expire_at(F.col("hlc"), F.col("expiry")).alias("expire_at"), T.left_seconds(F.col("hlc"), F.col("expiry"), F.lit(NOW_MS).cast("long")).alias("secs"))


@query(f"with {S} select client, filter, coalesce(array_to_string(string_split(filter, '/')[1:coalesce(list_position([x in ('+', '#') for x in string_split(filter, '/')], true) - 1, len(string_split(filter, '/')))], '/'), '') as prefix from s")
def P26_literal_prefix(spark, sf):
    return src.subscriptions(spark).select("client", "filter", F.array_join(T.literal_prefix(F.col("filter")), "/").alias("prefix"))


@query(MATCHED + " select distinct tenant, topic, filter from j")
def J1_topic_filter(spark, sf):
    names = src.messages(spark, sf).select("tenant", "topic").distinct()
    return matching.match_topics(names, src.subscriptions(spark).select("tenant", "filter").distinct()).select("tenant", "topic", "filter")


@query(MATCHED + " select event_id, client, filter from j")
def J2_receivers(spark, sf):
    return matching.match_topics(src.messages(spark, sf), src.subscriptions(spark)).select("event_id", "client", "filter")


DELIVERED = MATCHED + """, k as (select *, least(pub_qos, qos) as eff_qos, case when filter like '$oshare/%' then publisher else event_id end as pick, filter like '$share/%' or filter like '$oshare/%' as sh from j where not (no_local and publisher = client)),
d as (select * from k where not sh union all select * from k x where sh and not exists (select 1 from k y where y.sh and y.event_id = x.event_id and y.filter = x.filter and ((y.pick * 31 + y.client * 17) % 101, y.client) < ((x.pick * 31 + x.client * 17) % 101, x.client)))"""


@query(DELIVERED + " select event_id, client, filter, eff_qos from d")
def J19_deliveries(spark, sf):
    return matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).select("event_id", "client", "filter", "eff_qos")


@query(DELIVERED + " select tenant, topic, count(*) as n from d group by tenant, topic")
def A1_fanout_count(spark, sf):
    return matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).groupBy("tenant", "topic").agg(F.count("*").alias("n"))


@query(DELIVERED + " select tenant, cast(sum(length(topic) + length(payload)) as bigint) as n_bytes from d group by tenant")
def A8_fanout_bytes(spark, sf):
    return matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).groupBy("tenant").agg(F.sum(F.length("topic") + F.length("payload")).alias("n_bytes"))


RETAINED = f"with {M}, l as (select *, row_number() over (partition by tenant, topic order by hlc desc, event_id desc) as r from m where retain), t as (select * from l where r = 1 and payload <> '')"


@query(RETAINED + " select tenant, topic, event_id, payload, hlc from t")
def T1_retained(spark, sf):
    return matching.retained(src.messages(spark, sf)).select("tenant", "topic", "event_id", "payload", "hlc")


@query(RETAINED + f", {S}, {SP}, a as (select distinct t.tenant, topic, filter, event_id from t join (select distinct tenant, filter, plain from sp) sp on t.tenant = sp.tenant and {RX} where ms + expiry * 1000 > 1706500000000), q as (select *, (select count(*) from a b where b.tenant = a.tenant and b.filter = a.filter and b.topic <= a.topic) as rank from a) select tenant, filter, topic, event_id, rank from q where rank <= 10")
def T2_retained_match(spark, sf):
    table = matching.retained(src.messages(spark, sf))
    return matching.match_retained(table, src.subscriptions(spark), 1706500000000, 10).select("tenant", "filter", "topic", "event_id", F.col("rank").cast("long").alias("rank"))


@query(RETAINED + " select tenant, topic, event_id from t where ms + expiry * 1000 <= 1706500000000")
def T3_gc(spark, sf):
    return matching.expired(matching.retained(src.messages(spark, sf)), 1706500000000).select("tenant", "topic", "event_id")


@query(RETAINED + " select tenant, topic, event_id from t where ms + 3600000 <= 1706500000000")
def T3_gc_override(spark, sf):
    return matching.expired(matching.retained(src.messages(spark, sf)), 1706500000000, 3600).select("tenant", "topic", "event_id")


@query(RETAINED + " select tenant, count(*) as n_topics, cast(sum(length(topic) + length(payload)) as bigint) as space from t group by tenant")
def A3_retained_usage(spark, sf):
    return matching.retained(src.messages(spark, sf)).groupBy("tenant").agg(F.count("*").alias("n_topics"), F.sum(F.length("topic") + F.length("payload")).alias("space"))


@query(RETAINED + ", u as (select tenant, count(*) as n from t group by tenant), q(tenant, quota) as (values ('t0', 10), ('t1', 1000)) select u.tenant, n, coalesce(quota, 20) as quota, n >= coalesce(quota, 20) as exceeded from u left join q on u.tenant = q.tenant")
def T5_quota(spark, sf):
    usage = matching.retained(src.messages(spark, sf)).groupBy("tenant").agg(F.count("*").alias("n"))
    quota = rows(spark, [("t0", 10), ("t1", 1000)], "tenant string, quota int")
    out = usage.join(quota, "tenant", "left").withColumn("quota", F.coalesce("quota", F.lit(20)))
    return out.withColumn("exceeded", F.col("n") >= F.col("quota"))


def _queued(spark, sf):
    sent = matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).select("client", "event_id", "hlc", "eff_qos").distinct()
    return queues.numbered(sent, ["client"], ["hlc", "event_id", "eff_qos"])


QUEUED = DELIVERED + ", u as (select distinct client, event_id, hlc, eff_qos from d), q as (select *, row_number() over (partition by client order by hlc, event_id, eff_qos) - 1 as seq from u)"


@query(QUEUED + " select client, event_id, eff_qos, seq from q")
def W3_sequence(spark, sf):
    return _queued(spark, sf).select("client", "event_id", "eff_qos", F.col("seq").cast("long").alias("seq"))


@query(QUEUED + " select client, event_id, seq from q where seq < 100")
def W4_drop_newest(spark, sf):
    return queues.bounded(_queued(spark, sf), ["client"], 100, False).select("client", "event_id", F.col("seq").cast("long").alias("seq"))


@query(QUEUED + " select client, event_id, seq from q where seq > (select max(seq) from q b where b.client = q.client) - 100")
def W5_drop_oldest(spark, sf):
    return queues.bounded(_queued(spark, sf), ["client"], 100, True).select("client", "event_id", F.col("seq").cast("long").alias("seq"))


@query(QUEUED + " select client, event_id, seq from q where seq > 4 and seq <= 14")
def W6_fetch(spark, sf):
    return queues.fetch(_queued(spark, sf), ["client"], 4, 10).select("client", "event_id", F.col("seq").cast("long").alias("seq"))


@query(QUEUED + " select client, count(*) as n_left, min(seq) as first_seq from q where seq > 20 group by client")
def W7_commit(spark, sf):
    return queues.committed(_queued(spark, sf), 20).groupBy("client").agg(F.count("*").alias("n_left"), F.min("seq").cast("long").alias("first_seq"))


@query(QUEUED + " select client, eff_qos, count(*) as dropped from q where seq >= 100 group by client, eff_qos")
def A7_drop_counts(spark, sf):
    return _queued(spark, sf).where("seq >= 100").groupBy("client", "eff_qos").agg(F.count("*").alias("dropped"))


@query(f"with {M} select tenant, topic, event_id from (select *, max(ms - event_id % 7 * 60000) over (partition by tenant, topic order by event_id rows between unbounded preceding and 1 preceding) as x from m) where x is null or ms - event_id % 7 * 60000 > x")
def W9_dedup(spark, sf):
    m = src.messages(spark, sf).withColumn("stamp", F.col("ms") - F.col("event_id") % 7 * 60000)
    return queues.fresh(m, ["tenant", "topic"], "stamp", ["event_id"]).select("tenant", "topic", "event_id")


@query("select o_custkey, o_orderkey, o_totalprice from orders o where not exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderkey > o.o_orderkey)")
def W1_latest(spark, sf):
    return queues.latest(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("select o_custkey, o_orderkey from orders o where exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderkey > o.o_orderkey)")
def W2_older(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return o.join(last, "o_custkey").where("o_orderkey < last").select("o_custkey", "o_orderkey")


@query(f"with {M} select event_id, publisher, (select count(*) from m b where b.publisher = m.publisher and b.ms // 1000 = m.ms // 1000 and b.event_id <= m.event_id) <= 1 as admitted from m")
def R3_rate_limit(spark, sf):
    m = src.messages(spark, sf)
    return queues.rate_limited(m, ["publisher"], F.col("ms"), 1, ["event_id"]).select("event_id", "publisher", "admitted")


@query("select event_id, user_id, lag(event_type) over (partition by user_id order by event_id) as kicked, lead(event_id) over (partition by user_id order by event_id) is null as latest from events where event_type in ('signup', 'error')")
def I15_register_kick(spark, sf):
    e = read(spark, sf, "events").where(F.col("event_type").isin("signup", "error")).withColumn("owner", F.col("event_type"))
    return queues.owners(e, ["user_id"], "owner", ["event_id"]).select("event_id", "user_id", "kicked", "latest")


@query("select distinct user_id from events e where coalesce((select arg_max(event_type, event_id) from events s where s.user_id = e.user_id and s.event_type in ('signup', 'error')), 'error') <> 'signup'")
def J13_offline(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id")
    last = e.where(F.col("event_type").isin("signup", "error")).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    return e.select("user_id").distinct().join(last.where("last = 'signup'"), "user_id", "left_anti")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as present from customer")
def J14_exist(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("there")).distinct()
    return read(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("there", F.lit(False)).alias("present"))


@query(f"with {P} select range_id, count(*) as n, min(o_orderkey) as least_key, max(o_orderkey) as most_key from orders, p where (lo is null or o_orderkey >= lo) and (hi is null or o_orderkey < hi) group by range_id")
def J4_route(spark, sf):
    o = ranges.route(read(spark, sf, "orders").select("o_orderkey"), src.ranges(spark), "o_orderkey")
    return o.groupBy("range_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least_key"), F.max("o_orderkey").alias("most_key"))


@query(f"with {P} select a.range_id as a, b.range_id as b from p a, (values (10, 500, 1000), (11, 999, 4097), (12, null, null), (13, 9000, 9001)) b(range_id, lo, hi) where coalesce(a.lo, -1) < coalesce(b.hi, 1e18) and coalesce(b.lo, -1) < coalesce(a.hi, 1e18)")
def J5_overlap(spark, sf):
    asked = rows(spark, [(10, 500, 1000), (11, 999, 4097), (12, None, None), (13, 9000, 9001)], "b int, lo2 long, hi2 long")
    a = src.ranges(spark).withColumnRenamed("range_id", "a")
    return ranges.overlapping(a, asked).select(F.col("a").cast("int").alias("a"), "b")


PREFIXES = ["S", "STANDARD", "STANDARD POLISHED", "PROMO", "ECONOMY A", "MEDIUM", "LARGE BRUSHED", "P"]


@query("with x(prefix) as (values " + ", ".join(f"('{p}')" for p in PREFIXES) + ") select p_partkey, p_type, (select prefix from x where starts_with(p_type, prefix) order by length(prefix) desc limit 1) as prefix from part")
def J7_longest_prefix(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_type")
    return ranges.longest_prefix(p, rows(spark, [(x,) for x in PREFIXES], "prefix string"), "p_type").select("p_partkey", "p_type", "prefix")


@query("with k as (select l_orderkey, sum(l_linenumber) as load from lineitem group by 1), c as (select *, sum(load) over (order by l_orderkey) as cum, sum(load) over () as total from k) select min(l_orderkey) as split_key, cast(min(cum) as bigint) as load_below from c where cum * 2 >= total")
def A12_split_key(spark, sf):
    return ranges.split_key(read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("with e as (select *, time_bucket(interval '1 hour', ts) as w from events) select epoch(w)::bigint as w, event_type, count(*) as n, round(sum(value), 2) as total, max(value) as most from e group by w, event_type")
def A10_metrics(spark, sf):
    e = read(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("most"))
    return e.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("w"), "event_type", "n", "total", "most")


@query("select event_id, max(value) over (partition by user_id order by event_id rows between 4 preceding and current row) as most from events")
def A17_moving_max(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return read(spark, sf, "events").select("event_id", F.max("value").over(w).alias("most"))


def _written(spark, sf):
    d = src.placed(spark, sf, "lineitem")
    return d.select(F.col("l_suppkey").alias("uri"), (F.col("l_linenumber") % 4).alias("replica"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ver"), F.col("l_quantity").alias("value"), "_file", "_row")


@query("select l_suppkey as uri, sum(v) as value from (select l_suppkey, l_linenumber % 4 as r, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) as v from lineitem group by 1, 2) group by 1")
def A19_counter(spark, sf):
    return replicated.counter(_written(spark, sf))


def _dots(spark, sf):
    d = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("uri"), (F.col("l_orderkey") % 4).alias("replica"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ver"), F.col("l_returnflag").alias("value"), "l_linenumber", "l_partkey")
    replaced = d.where("l_linenumber % 3 = 0").select("uri", "replica", "ver")
    return d, replaced


DOTS = "with d as (select l_suppkey as uri, l_orderkey % 4 as replica, l_orderkey * 10 + l_linenumber as ver, l_returnflag as value, l_linenumber, l_partkey from lineitem), a as (select distinct * from d where l_linenumber % 3 <> 0 and not exists (select 1 from d x where x.l_linenumber % 3 = 0 and x.uri = d.uri and x.replica = d.replica and x.ver = d.ver))"


@query(DOTS + " select uri, string_agg(distinct value, ',' order by value) as vals from a group by uri")
def C2_register(spark, sf):
    d, replaced = _dots(spark, sf)
    alive = replicated.merge(d.unionByName(d), replaced, ["uri", "replica", "ver"])
    return replicated.register(alive).select("uri", F.array_join("values", ",").alias("vals"))


@query(DOTS + " select distinct uri, value from a")
def C5_add_wins(spark, sf):
    d, replaced = _dots(spark, sf)
    return replicated.add_wins(replicated.merge(d, replaced, ["uri", "replica", "ver"]))


@query(DOTS + " select uri, value from a group by uri, value having min(l_partkey % 50) <> 0")
def C6_remove_wins(spark, sf):
    d, replaced = _dots(spark, sf)
    alive = replicated.merge(d, replaced, ["uri", "replica", "ver"]).withColumn("flag", F.col("l_partkey") % 50 != 0)
    return replicated.remove_wins(alive)


@query("select l_orderkey, l_linenumber, l_suppkey from lineitem l where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def C9_delta(spark, sf):
    known = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return replicated.delta(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), known, ["l_orderkey"])


@query("""with r as (select distinct l_suppkey, l_orderkey as lo, l_orderkey + l_linenumber * 20 as hi from lineitem), x as (select *, max(hi) over (partition by l_suppkey order by lo, hi rows between unbounded preceding and 1 preceding) as m from r),
y as (select *, sum(case when m is null or lo > m + 1 then 1 else 0 end) over (partition by l_suppkey order by lo, hi rows unbounded preceding) as i from x) select l_suppkey, min(lo) as lo, max(hi) as hi from y group by l_suppkey, i""")
def U5_merge_ranges(spark, sf):
    line = src.dealt(read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey")
    r = line.select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber") * 20).alias("hi")).distinct()
    return ranges.merge_ranges(r, ["l_suppkey"])


@query("select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 5000")
def S4_range_scan(spark, sf):
    return read(spark, sf, "orders").where("o_orderkey >= 100 and o_orderkey < 5000").select("o_orderkey", "o_custkey")


@query("select max(o_orderkey) as k from orders where o_orderkey <= 5000")
def S3_seek_for_prev(spark, sf):
    return read(spark, sf, "orders").where("o_orderkey <= 5000").agg(F.max("o_orderkey").alias("k"))


@query("select c_name, c_acctbal from customer where c_name like 'Customer#00000001%'")
def S5_prefix_scan(spark, sf):
    return read(spark, sf, "customer").where(F.startswith("c_name", F.lit("Customer#00000001"))).select("c_name", "c_acctbal")


@query("select cast(sum(length(c_name) + length(c_mktsegment)) as bigint) as n_bytes from customer where c_custkey >= 10 and c_custkey < 900")
def S8_range_size(spark, sf):
    return read(spark, sf, "customer").where("c_custkey >= 10 and c_custkey < 900").agg(F.sum(F.length("c_name") + F.length("c_mktsegment")).alias("n_bytes"))


@query("select c_custkey, coalesce(n, c_acctbal) as bal from customer left join (select o_custkey, max(o_totalprice) as n from orders group by 1) on o_custkey = c_custkey")
def K1_upsert(spark, sf):
    old = read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.lit(0).alias("v"))
    new = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("bal")).withColumn("v", F.lit(1)).join(old.select("c_custkey"), "c_custkey", "left_semi")
    return queues.latest(old.unionByName(new), ["c_custkey"], "v").select("c_custkey", "bal")


@query("select c_custkey from customer where c_custkey < 100 or c_custkey >= 1000")
def K4_range_delete(spark, sf):
    return read(spark, sf, "customer").where("not (c_custkey >= 100 and c_custkey < 1000)").select("c_custkey")


@query(f"with {M} select tenant, topic, string_agg(event_id::varchar, ',' order by hlc, event_id) as ids from m group by tenant, topic, publisher")
def A2_message_packs(spark, sf):
    m = src.messages(spark, sf).groupBy("tenant", "topic", "publisher").agg(F.sort_array(F.collect_list(F.struct("hlc", "event_id"))).alias("p"))
    return m.select("tenant", "topic", F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("""with a as (select distinct l_suppkey as k, unnest(range(l_orderkey, l_orderkey + l_linenumber * 20 + 1)) as x from lineitem), b as (select distinct l_suppkey as k, unnest(range(l_orderkey, l_orderkey + l_linenumber * 5 + 1)) as x from lineitem where l_linenumber % 3 = 0),
d as (select * from a except select * from b), i as (select *, x - row_number() over (partition by k order by x) as g from d) select k as l_suppkey, min(x) as lo, max(x) as hi from i group by k, g""")
def U4_subtract_ranges(spark, sf):
    rows = src.dealt(read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey")
    span = lambda df, n: df.select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber") * n).alias("hi"))
    return ranges.subtract_ranges(span(rows, 20), span(rows.where("l_linenumber % 3 = 0"), 5), ["l_suppkey"])


NODES = ["ash", "birch", "cedar", "elm", "fir"]


@query("with n(node) as (values " + ", ".join(f"('{n}')" for n in NODES) + "), p as (select min(node) as node, h from (select node, ('0x' || substr(md5(node || '-' || k), 1, 8))::bigint as h from n, range(16) t(k)) group by h), q as (select c_custkey, c_name, ('0x' || substr(md5(c_name), 1, 8))::bigint as hk from customer) select c_custkey, coalesce((select arg_min(node, h) from p where h >= hk), (select arg_min(node, h) from p)) as node from q")
def J17_hash_ring(spark, sf):
    return ranges.assign(read(spark, sf, "customer").select("c_custkey", "c_name"), rows(spark, [(n,) for n in NODES], "node string"), "c_name", "node").select("c_custkey", "node")


@query("select event_type, slot, count(*) as n from (select event_type, unnest(generate_series((epoch_us(ts) // 1000) // 5000, ((epoch_us(ts) // 1000) + event_id % 5 * 3000) // 5000)) as slot from events) group by event_type, slot")
def R2_load_slots(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return windows.slots(read(spark, sf, "events"), ms, ms + F.col("event_id") % 5 * 3000, 5000, ["event_type"])


@query("select event_id, cast(sum(cast(round(value * 100) as bigint)) over w as bigint) as cents, count(*) over w as n from events window w as (partition by user_id order by epoch_us(ts) // 1000 range between 86400000 preceding and current row)")
def R4_moving_average(spark, sf):
    e = read(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-86400000, 0)
    return e.select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("cents"), F.count("*").over(w).alias("n"))


@query("""with g as (select *, case when (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over w < 21600000 then 0 else 1 end as opens from events window w as (partition by user_id order by ts)),
i as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) // 1000 as first_ms, count(*) as n from i group by user_id, k""")
def R5_idle_sessions(spark, sf):
    return windows.idle_sessions(read(spark, sf, "events"), "ts", "6 hours", ["user_id"])
