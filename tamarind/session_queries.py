"""Queries over sessions, their subscriptions and deliveries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import topics as T
from .operators import matching, queues, sessions
from .queries import DELIVERED, MATCHED, QUEUED, RETAINED, RX, SP, M, S, _queued
from .registry import query
from .sources import messages as src
from .sources.messages import NOW_MS, rows

MOST, LATER = 3, NOW_MS + 86_400_000
OPS = """o as (select event_id as id, user_id as inbox, ['attach', 'attach', 'sub', 'sub', 'sub', 'unsub', 'detach', case when event_id // 8 % 3 = 0 then 'delete' else 'expire' end][event_id % 8 + 1] as op,
  'f/' || (event_id // 8 % 5) as filter, event_id % 2 as qos, epoch_us(ts) // 1000 as ms, event_id // 8 % 4 * 20000 as expiry, event_id % 11 = 0 as stale from events)"""
#: Independent phrasing of the replay: one recursion step a request.
REPLIES = f"""with recursive {OPS}, n as (select *, row_number() over (partition by inbox order by id) as k from o),
r as (select inbox, 0::bigint as k, 0::bigint as id, '' as op, '' as code, null::bigint as incarnation, null::bigint as mod, null::bigint as expiry, null::bigint as detached, []::varchar[] as fs, []::varchar[] as told from (select distinct inbox from o)
 union all
 select inbox, k, id, op, code, case when code = 'CREATED' then id when ends then null else p_incarnation end, case when code = 'CREATED' then 0 when ends then null when code = 'REUSED' or moves then p_mod + 1 else p_mod end,
  case when ends then null when code in ('CREATED', 'REUSED') or moves then expiry else p_expiry end, case when ends or code in ('CREATED', 'REUSED') then null when moves then ms else p_detached end,
  case when ends or code = 'CREATED' then [] when op = 'sub' and code = 'OK' then list_append(rest, filter || '=' || qos) when op = 'unsub' and code = 'OK' then rest else fs end, case when ends then fs else [] end
 from (select *, code = 'OK' and op in ('delete', 'expire') as ends, code = 'OK' and op = 'detach' as moves from (select *,
   case when op = 'attach' then case when p_incarnation is not null and not gone then 'REUSED' when expiry = 0 then 'TRANSIENT' else 'CREATED' end
     when p_incarnation is null then 'NO_INBOX' when op = 'expire' then case when gone then 'OK' else 'KEPT' end when stale then 'CONFLICT' when op in ('detach', 'delete') then 'OK'
     when op = 'sub' then case when len(fs) >= {MOST} then 'EXCEED_LIMIT' when list_contains(fs, filter || '=' || qos) then 'EXISTS' else 'OK' end
     else case when len(rest) < len(fs) then 'OK' else 'NO_SUB' end end as code
   from (select n.*, r.incarnation as p_incarnation, r.mod as p_mod, r.expiry as p_expiry, r.detached as p_detached, r.fs, coalesce(r.detached + r.expiry * 1000 < n.ms, false) as gone,
     [x for x in r.fs if split_part(x, '=', 1) <> n.filter] as rest from r join n on n.inbox = r.inbox and n.k = r.k + 1)))),
v as (select id, inbox, op, code, incarnation, mod, expiry, detached, array_to_string(list_sort(case when len(told) > 0 then told else fs end), ',') as filters from r where k > 0),
z as (select * from v where incarnation is not null and not exists (select 1 from v x where x.inbox = v.inbox and x.id > v.id))"""


def _requests(spark, sf):
    e = src.read(spark, sf, "events")
    part = F.call_function("div", F.col("event_id"), F.lit(8))
    last = F.when(part % 3 == 0, "delete").otherwise("expire")
    op = F.element_at(F.array(*map(F.lit, ("attach", "attach", "sub", "sub", "sub", "unsub", "detach")), last), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("inbox"), op.alias("op"), F.concat(F.lit("f/"), (part % 5).cast("string")).alias("filter"), (F.col("event_id") % 2).alias("qos"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (part % 4 * 20000).alias("expiry"), (F.col("event_id") % 11 == 0).alias("stale"),
    )


def _replies(spark, sf):
    return sessions.replies(_requests(spark, sf), MOST)


def _sessions(spark, sf):
    return sessions.latest_sessions(_requests(spark, sf), MOST)


@query(REPLIES + " select id, inbox, code, incarnation, mod, expiry from v where op = 'attach'")
def I1_attach(spark, sf):
    return _replies(spark, sf).where("op = 'attach'").select("id", "inbox", "code", "incarnation", "mod", "expiry")


@query(REPLIES + " select id, inbox, code, mod, detached from v where op = 'detach'")
def I2_detach(spark, sf):
    return _replies(spark, sf).where("op = 'detach'").select("id", "inbox", "code", "mod", "detached")


@query(REPLIES + " select id, inbox, code, filters from v where op = 'delete'")
def I3_delete(spark, sf):
    return _replies(spark, sf).where("op = 'delete'").select("id", "inbox", "code", "filters")


@query(REPLIES + " select id, inbox, code, filters from v where op = 'sub'")
def I4_sub(spark, sf):
    return _replies(spark, sf).where("op = 'sub'").select("id", "inbox", "code", "filters")


@query(REPLIES + " select id, inbox, code, filters from v where op = 'unsub'")
def I5_unsub(spark, sf):
    return _replies(spark, sf).where("op = 'unsub'").select("id", "inbox", "code", "filters")


@query(REPLIES + " select id, inbox, code, filters from v where op = 'expire'")
def I11_expire(spark, sf):
    return _replies(spark, sf).where("op = 'expire'").select("id", "inbox", "code", "filters")


@query(REPLIES + f" select inbox, incarnation, coalesce(detached + expiry * 1000 < {LATER}, false) as gone from z")
def P15_has_expired(spark, sf):
    return _sessions(spark, sf).select("inbox", "incarnation", sessions.expired("detached", "expiry", LATER).alias("gone"))


@query(REPLIES + f" select c_custkey as inbox, exists (select 1 from z where z.inbox = c_custkey and not coalesce(detached + expiry * 1000 < {LATER}, false)) as there from customer")
def J10_live_inbox(spark, sf):
    live = _sessions(spark, sf).where(~sessions.expired("detached", "expiry", LATER)).select("inbox", F.lit(True).alias("there"))
    return src.read(spark, sf, "customer").select(F.col("c_custkey").alias("inbox")).join(live, "inbox", "left").select("inbox", F.coalesce("there", F.lit(False)).alias("there"))


@query(REPLIES + f""" select c_custkey as inbox, case when z.inbox is null or coalesce(detached + expiry * 1000 < {LATER}, false) then 'NO_INBOX' when len([x for x in string_split(filters, ',') if x like 'f/2=%']) > 0 then 'OK' else 'NO_MATCH' end as code
from customer left join z on z.inbox = c_custkey""")
def J11_check_sub(spark, sf):
    asked = src.read(spark, sf, "customer").select(F.col("c_custkey").alias("inbox"))
    made = asked.join(_sessions(spark, sf), "inbox", "left")
    has = F.exists(F.split("filters", ","), lambda x: F.startswith(x, F.lit("f/2=")))
    none = F.col("incarnation").isNull() | sessions.expired("detached", "expiry", LATER)
    return made.select("inbox", F.when(none, "NO_INBOX").when(has, "OK").otherwise("NO_MATCH").alias("code"))


@query(REPLIES + " select 't' || (inbox % 3) as tenant, count(*) as n_sessions, cast(sum(case when filters = '' then 0 else len(string_split(filters, ',')) end) as bigint) as n_subs from z group by 1")
def A5_subscriptions(spark, sf):
    n = F.when(F.col("filters") == "", 0).otherwise(F.size(F.split("filters", ",")))
    return _sessions(spark, sf).groupBy(F.concat(F.lit("t"), (F.col("inbox") % 3).cast("string")).alias("tenant")).agg(F.count("*").alias("n_sessions"), F.sum(n).alias("n_subs"))


@query(REPLIES + " select 't' || (inbox % 3) as tenant, count(*) filter (detached is null) as live, count(*) filter (detached is null and expiry > 0) as persistent from z group by 1")
def A6_connections(spark, sf):
    return _sessions(spark, sf).groupBy(F.concat(F.lit("t"), (F.col("inbox") % 3).cast("string")).alias("tenant")).agg(F.count_if(F.col("detached").isNull()).alias("live"), F.count_if(F.col("detached").isNull() & (F.col("expiry") > 0)).alias("persistent"))


@query(REPLIES + " select 't' || (inbox % 3) as tenant, cast(sum(length(filters) + 8) as bigint) as space from z group by 1")
def A4_used_space(spark, sf):
    return _sessions(spark, sf).groupBy(F.concat(F.lit("t"), (F.col("inbox") % 3).cast("string")).alias("tenant")).agg(F.sum(F.length("filters") + 8).cast("long").alias("space"))


@query(REPLIES + " select inbox, incarnation, mod, filters from z where inbox = 7")
def S15_session(spark, sf):
    return sessions.latest_sessions(_requests(spark, sf).where("inbox = 7"), MOST).select("inbox", "incarnation", "mod", "filters")


@query(REPLIES + " select inbox, detached + expiry * 1000 as due, row_number() over (order by detached + expiry * 1000, inbox) as place from z where detached is not null qualify place <= 20")
def W11_by_deadline(spark, sf):
    due = _sessions(spark, sf).where("detached is not null").select("inbox", (F.col("detached") + F.col("expiry") * 1000).alias("due"))
    first = due.orderBy("due", "inbox").limit(20)
    return first.withColumn("place", F.row_number().over(Window.orderBy("due", "inbox")).cast("long"))


@query(REPLIES + " select inbox, least(expiry, inbox % 5 * 7000) as delay, detached + least(expiry, inbox % 5 * 7000) * 1000 as due from z where detached is not null")
def I10_will_delay(spark, sf):
    delay = F.least(F.col("expiry"), F.col("inbox") % 5 * 7000)
    return _sessions(spark, sf).where("detached is not null").select("inbox", delay.alias("delay"), (F.col("detached") + delay * 1000).alias("due"))


@query(REPLIES + f" select inbox, 'will/' || inbox as topic, case when inbox % 2 = 1 then 'NO_LWT' when detached + least(expiry, inbox % 5 * 7000) * 1000 > {LATER} then 'TRY_LATER' else 'OK' end as code from z where detached is not null")
def I9_send_will(spark, sf):
    due = F.col("detached") + F.least(F.col("expiry"), F.col("inbox") % 5 * 7000) * 1000
    return _sessions(spark, sf).where("detached is not null").select("inbox", F.concat(F.lit("will/"), F.col("inbox").cast("string")).alias("topic"), F.when(F.col("inbox") % 2 == 1, "NO_LWT").when(due > LATER, "TRY_LATER").otherwise("OK").alias("code"))


# timers: the last request of a key decides


@query("select user_id as k, event_id as id, epoch_us(ts) // 1000 + event_id % 50 * 60000 as due from events e where event_type <> 'error' and not exists (select 1 from events x where x.user_id = e.user_id and x.event_id > e.event_id)")
def R7_timers(spark, sf):
    e = src.read(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), (F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") % 50 * 60000).alias("due"), "event_type")
    return queues.latest(e, ["k"], "id").where("event_type <> 'error'").select("k", "id", "due")


@query("select user_id, event_id, sends, ms + 1000 * (2 ** (sends - 1))::bigint as again from (select user_id, event_id, epoch_us(ts) // 1000 as ms, row_number() over (partition by user_id, event_type order by event_id) as sends from events) where sends <= 5")
def R8_retransmit(spark, sf):
    e = src.read(spark, sf, "events").withColumn("sends", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long")).where("sends <= 5")
    again = F.unix_millis(F.col("ts").cast("timestamp")) + 1000 * F.pow(F.lit(2), F.col("sends") - 1).cast("long")
    return e.select("user_id", "event_id", "sends", again.alias("again"))


@query("select event_id, user_id, least(count(*) over (partition by user_id, event_type order by event_id), 6) as tries, count(*) over (partition by user_id, event_type order by event_id) <= 5 as again from events")
def I13_retry_count(spark, sf):
    n = F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return src.read(spark, sf, "events").select("event_id", "user_id", F.least(n, F.lit(6)).cast("long").alias("tries"), (n <= 5).alias("again"))


# deliveries


@query(MATCHED + " select event_id, client, filter, least(pub_qos, qos) as qos from j")
def P16_effective_qos(spark, sf):
    return matching.match_topics(src.messages(spark, sf), src.subscriptions(spark)).select("event_id", "client", "filter", F.least("pub_qos", "qos").alias("qos"))


@query(MATCHED + " select event_id, client, filter, client % 2 = 0 and retain as kept from j")
def P17_retain_flag(spark, sf):
    return matching.match_topics(src.messages(spark, sf), src.subscriptions(spark)).select("event_id", "client", "filter", ((F.col("client") % 2 == 0) & F.col("retain")).alias("kept"))


@query(MATCHED + " select event_id, client, filter from j where not (no_local and publisher = client)")
def P18_no_local(spark, sf):
    return matching.match_topics(src.messages(spark, sf), src.subscriptions(spark)).where(~(F.col("no_local") & (F.col("publisher") == F.col("client")))).select("event_id", "client", "filter")


ACL = [("t0", "dev/+/view", True), ("t0", "$sys/#", True), ("t0", "dev/3/#", False), ("t1", "#", True), ("t2", "dev/#", True), ("t2", "+/5/+", False)]
ACL_SQL = "acl(tenant, filter, allow) as (values " + ", ".join(f"('{t}', '{f}', {str(a).lower()})" for t, f, a in ACL) + ")"
PERMITTED = f"with {M}, {ACL_SQL}, pairs as (select m.event_id, allow from m join (select *, filter as plain from acl) a on a.tenant = m.tenant and {RX}), ok as (select event_id from pairs group by event_id having bool_and(allow))"


def _permitted(spark, sf):
    m = src.messages(spark, sf)
    names = m.select("tenant", "topic").distinct()
    ruled = matching.match_topics(names, rows(spark, ACL, "tenant string, filter string, allow boolean"))
    return m.join(ruled.groupBy("tenant", "topic").agg(F.bool_and("allow").alias("allow")), ["tenant", "topic"], "left").withColumn("allow", F.coalesce("allow", F.lit(False)))


@query(PERMITTED + " select event_id, event_id in (select event_id from ok) as allow from m")
def P29_permission(spark, sf):
    return _permitted(spark, sf).select("event_id", "allow")


@query(PERMITTED + " select tenant, count(*) filter (event_id in (select event_id from ok)) as passed, count(*) filter (event_id not in (select event_id from ok)) as refused from m group by tenant")
def X1_permission_counts(spark, sf):
    return _permitted(spark, sf).groupBy("tenant").agg(F.count_if("allow").alias("passed"), F.count_if(~F.col("allow")).alias("refused"))


CASCADE = DELIVERED + f""", {ACL_SQL}, ok as (select event_id from (select m.event_id, allow from m join (select *, filter as plain from acl) a on a.tenant = m.tenant and {RX}) group by event_id having bool_and(allow)),
w as (select *, row_number() over (partition by client, event_id order by filter) as nth from d),
y as (select *, case when event_id not in (select event_id from ok) then 'NO_PERMISSION' when nth > 1 then 'DUPLICATE' when ms + expiry * 1000 <= {NOW_MS} then 'EXPIRED' when event_id % 29 = 0 then 'RESOURCE_EXHAUSTED' when client % 6 = 0 then 'CHANNEL_CLOSED' end as why from w),
q2 as (select *, case when why is null then row_number() over (partition by client, why is null order by hlc, event_id) end as place from y)"""


@query(CASCADE + " select event_id, client, filter, coalesce(why, case when place > 200 then 'OVERFLOW' else 'SENT' end) as outcome, eff_qos > 0 and coalesce(why, case when place > 200 then 'OVERFLOW' else 'SENT' end) not in ('SENT', 'CHANNEL_CLOSED') as confirmed from q2")
def P35_drop_reason(spark, sf):
    allowed = _permitted(spark, sf).select("event_id", "allow")
    sent = matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).join(allowed, "event_id")
    sent = sent.withColumn("nth", F.row_number().over(Window.partitionBy("client", "event_id").orderBy("filter")))
    why = F.when(~F.col("allow"), "NO_PERMISSION").when(F.col("nth") > 1, "DUPLICATE").when(T.expire_at(F.col("hlc"), F.col("expiry")) <= NOW_MS, "EXPIRED")
    sent = sent.withColumn("why", why.when(F.col("event_id") % 29 == 0, "RESOURCE_EXHAUSTED").when(F.col("client") % 6 == 0, "CHANNEL_CLOSED"))
    stopped = sent.where("why is not null").withColumn("outcome", F.col("why"))
    rest = queues.numbered(sent.where("why is null"), ["client"], ["hlc", "event_id"])
    rest = rest.withColumn("outcome", F.when(F.col("seq") >= 200, "OVERFLOW").otherwise("SENT")).drop("seq")
    out = stopped.unionByName(rest)
    return out.select("event_id", "client", "filter", "outcome", ((F.col("eff_qos") > 0) & ~F.col("outcome").isin("SENT", "CHANNEL_CLOSED")).alias("confirmed"))


@query(DELIVERED + " select d.client, d.filter, d.client % 4 as bucket, count(*) as n from d group by all")
def J8_local_routes(spark, sf):
    made = matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).withColumn("bucket", F.col("client") % 4)
    routes = src.subscriptions(spark).select("tenant", "filter", "client", (F.col("client") % 4).alias("bucket")).distinct()
    return made.join(routes, ["tenant", "filter", "client", "bucket"]).groupBy("client", "filter", "bucket").agg(F.count("*").alias("n"))


@query(MATCHED + " select event_id, client, filter, case when client % 3 = 0 then null else qos end as option_qos, client % 3 = 0 as rejected from j")
def J9_option_lookup(spark, sf):
    options = src.subscriptions(spark).where("client % 3 <> 0").select("client", "filter", F.col("qos").alias("option_qos"))
    made = matching.match_topics(src.messages(spark, sf), src.subscriptions(spark)).select("event_id", "client", "filter").join(options, ["client", "filter"], "left")
    return made.withColumn("rejected", F.col("option_qos").isNull())


@query(f"with {S} select client, filter from s where not (client % 4 = 1 and filter like '%/#%')")
def J12_stale_routes(spark, sf):
    routes = src.subscriptions(spark).select("client", "filter")
    told = routes.where((F.col("client") % 4 == 1) & F.contains("filter", F.lit("/#"))).select("client", "filter").distinct()
    return routes.join(told, ["client", "filter"], "left_anti")


@query("select c_custkey, c_name from customer where c_name >= 'Customer#000000042' and c_name < 'Customer#000000042' || chr(1)")
def J15_by_user(spark, sf):
    return src.read(spark, sf, "customer").where(F.col("c_name") == "Customer#000000042").select("c_custkey", "c_name")


@query(RETAINED + f", {S}, {SP}, a as (select distinct t.tenant, topic, filter from t join (select distinct tenant, filter, plain from sp) sp on t.tenant = sp.tenant and {RX}), n as (select tenant, filter, count(*) as n from a group by all) select client, s.tenant, s.filter, coalesce(n, 0) as n from s left join n on n.tenant = s.tenant and n.filter = s.filter")
def J16_answers(spark, sf):
    asked = src.subscriptions(spark).select("client", "tenant", "filter")
    found = matching.match_topics(matching.retained(src.messages(spark, sf)), asked.select("tenant", "filter").distinct()).groupBy("tenant", "filter").agg(F.count("*").alias("n"))
    return asked.join(found, ["tenant", "filter"], "left").select("client", "tenant", "filter", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


SERVERS = [("east", 3), ("west", 1), ("north", 2)]


@query("with w(server, weight) as (values ('east', 3), ('west', 1), ('north', 2)), p as (select server, row_number() over (order by server, k) - 1 as slot from w, range(10) r(k) where k < weight) select c_custkey, server from customer join p on slot = c_custkey % 6")
def J18_weighted_pick(spark, sf):
    places = rows(spark, SERVERS, "server string, weight int").select("server", F.explode(F.sequence(F.lit(1), F.col("weight"))).alias("k"))
    places = places.withColumn("slot", F.row_number().over(Window.orderBy("server", "k")) - 1)  # a row a unit of weight
    c = src.read(spark, sf, "customer").withColumn("slot", F.col("c_custkey") % sum(w for _, w in SERVERS))
    return c.join(places, "slot").select("c_custkey", "server")


@query(RETAINED + f", {S}, {SP} select t.tenant, cast(sum(length(topic) + length(payload)) as bigint) as n_bytes from t join (select distinct tenant, filter, plain from sp) sp on t.tenant = sp.tenant and {RX} group by t.tenant")
def A9_matched_bytes(spark, sf):
    found = matching.match_topics(matching.retained(src.messages(spark, sf)), src.subscriptions(spark).select("tenant", "filter").distinct())
    return found.groupBy("tenant").agg(F.sum(F.length("topic") + F.length("payload")).alias("n_bytes"))


@query(QUEUED + ", u2 as (select *, event_id % 6 <> 0 as acked from q), f as (select client, coalesce(min(seq) filter (not acked), max(seq) + 1) as upto from u2 group by client) select u2.client, event_id, seq from u2 join f on f.client = u2.client where seq < upto")
def W10_confirmed(spark, sf):
    q = _queued(spark, sf).withColumn("acked", F.col("event_id") % 6 != 0)
    upto = q.groupBy("client").agg(F.coalesce(F.min(F.when(~F.col("acked"), F.col("seq"))), F.max("seq") + 1).alias("upto"))
    return q.join(upto, "client").where("seq < upto").select("client", "event_id", F.col("seq").cast("long").alias("seq"))


@query(f"with {S} select tenant, filter, client % 4 as bucket, min(client) as client from s group by all")
def W13_bucket_routes(spark, sf):
    return src.subscriptions(spark).groupBy("tenant", "filter", (F.col("client") % 4).alias("bucket")).agg(F.min("client").alias("client"))


@query(DELIVERED + ", f as (select *, row_number() over (partition by event_id order by client, filter) as nth from d) select event_id, client, filter from f where nth = 1 or event_id % 3 <> 0")
def I18_local_fanout(spark, sf):
    made = matching.deliveries(src.messages(spark, sf), src.subscriptions(spark))
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("client", "filter"))
    return made.withColumn("nth", nth).where((F.col("nth") == 1) | (F.col("event_id") % 3 != 0)).select("event_id", "client", "filter")


@query(DELIVERED + " select client, topic, count(*) as n, count(distinct publisher) as publishers, string_agg(distinct filter, ',' order by filter) as filters from d group by client, topic")
def I19_delivery_groups(spark, sf):
    made = matching.deliveries(src.messages(spark, sf), src.subscriptions(spark))
    return made.groupBy("client", "topic").agg(F.count("*").alias("n"), F.count_distinct("publisher").alias("publishers"), F.array_join(F.sort_array(F.collect_set("filter")), ",").alias("filters"))


INSERTED = QUEUED + ", i as (select *, case when eff_qos = 0 then 0 else 1 end as queue from u), k2 as (select *, row_number() over (partition by client, queue order by hlc, event_id, eff_qos) - 1 as pos from i)"


def _inserted(spark, sf):
    sent = matching.deliveries(src.messages(spark, sf), src.subscriptions(spark)).select("client", "event_id", "hlc", "eff_qos").distinct()
    return queues.numbered(sent.withColumn("queue", F.when(F.col("eff_qos") == 0, 0).otherwise(1)), ["client", "queue"], ["hlc", "event_id", "eff_qos"])


@query(INSERTED + " select client, queue, count(*) as offered, count(*) filter (pos < 150) as kept, count(*) filter (pos >= 150) as dropped from k2 group by client, queue")
def I6_insert(spark, sf):
    return _inserted(spark, sf).groupBy("client", "queue").agg(F.count("*").alias("offered"), F.count_if(F.col("seq") < 150).alias("kept"), F.count_if(F.col("seq") >= 150).alias("dropped"))


@query(INSERTED + " select client, queue, event_id, pos as seq from k2 where pos >= case when queue = 0 then 3 else 8 end and pos < case when queue = 0 then 3 else 8 end + 12")
def I7_fetch(spark, sf):
    q = _inserted(spark, sf)
    made = queues.fetch(q.where("queue = 0"), ["client"], 2, 12).unionByName(queues.fetch(q.where("queue = 1"), ["client"], 7, 12))
    return made.select("client", F.col("queue").cast("int").alias("queue"), "event_id", F.col("seq").cast("long").alias("seq"))


@query(INSERTED + " select client, queue, min(pos) as first_seq, max(pos) + 1 as next_seq, count(*) as n from k2 where pos > case when queue = 0 then 9 else 5 end group by client, queue")
def I8_commit(spark, sf):
    left = _inserted(spark, sf).where(F.col("seq") > F.when(F.col("queue") == 0, 9).otherwise(5))
    return left.groupBy("client", "queue").agg(F.min("seq").cast("long").alias("first_seq"), (F.max("seq") + 1).cast("long").alias("next_seq"), F.count("*").alias("n"))


@query(f"with {S} select client, filter from s where tenant = 't0'")
def I16_kill_all(spark, sf):
    return src.subscriptions(spark).where("tenant = 't0'").select("client", "filter")


@query(f"with {S}, g as (select client, count(*) as n from s group by client) select client, string_agg(filter, ',' order by filter) as filters, n from (select s.client, s.filter, n from s join g on g.client = s.client) group by client, n")
def P27_filter_map(spark, sf):
    made = src.subscriptions(spark).groupBy("client").agg(F.map_from_entries(F.collect_list(F.struct("filter", "qos"))).alias("m"))
    return made.select("client", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("filters"), F.size("m").cast("long").alias("n"))


@query(f"with {S} select client, string_agg(filter || '=' || qos, ',' order by filter) as filters from (select client, filter, qos from s where filter <> '#' union all select distinct client, 'new/+', 1 from s) group by client")
def P28_map_put_remove(spark, sf):
    made = src.subscriptions(spark).groupBy("client").agg(F.map_from_entries(F.collect_list(F.struct("filter", "qos"))).alias("m"))
    changed = F.map_concat(F.map_filter("m", lambda k, v: k != "#"), F.create_map(F.lit("new/+"), F.lit(1).cast("long")))
    told = F.transform(F.sort_array(F.map_entries(changed)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return made.select("client", F.array_join(told, ",").alias("filters"))


@query(f"with {S}, g as (select tenant, filter, client from s where client % 5 <> 0), n as (select tenant, filter, client from s where client % 4 = 0), k as (select tenant, filter, client from s where client % 5 = 0) select * from (select * from g union select * from k) except select * from n")
def U1_match_sets(spark, sf):
    s = src.subscriptions(spark).select("tenant", "filter", "client")
    return s.where("client % 5 <> 0").union(s.where("client % 5 = 0")).distinct().join(s.where("client % 4 = 0"), ["tenant", "filter", "client"], "left_anti")


@query(f"with {S} select filter from s except select filter from s where client > 8")
def U2_obsolete_filters(spark, sf):
    s = src.subscriptions(spark)
    return s.select("filter").subtract(s.where("client > 8").select("filter"))


@query(RETAINED + " select tenant, count(*) as n from t where tenant = 't1' group by tenant")
def T4_expire_all(spark, sf):
    gone = matching.expired(matching.retained(src.messages(spark, sf)).where("tenant = 't1'"), 2**45, 0)
    return gone.groupBy("tenant").agg(F.count("*").alias("n"))


NEVER_RETAINED = RETAINED.replace("from m where retain", "from (select * replace (case when event_id % 2 = 0 then 4294967295 else expiry end as expiry) from m) where retain")


@query(NEVER_RETAINED + " select tenant, topic, event_id from t where expiry = 4294967295 or ms + expiry * 1000 > 1706500000000")
def T2_never(spark, sf):
    m = src.messages(spark, sf).withColumn("expiry", F.when(F.col("event_id") % 2 == 0, F.lit(T.NEVER)).otherwise(F.col("expiry")))
    return matching.alive(matching.retained(m), 1706500000000).select("tenant", "topic", "event_id")


@query("with t as (select event_id, 'a' || repeat('/b', cast(event_id % 70 as int)) as topic, event_id % 70 + 1 as depth from events) select event_id, '#' as filter from t union all select event_id, 'a/#' from t union all select event_id, 'a/b/b/#' from t where depth >= 3 union all select event_id, 'a/+/b' from t where depth = 3")
def J1_deep(spark, sf):
    t = src.read(spark, sf, "events").select("event_id", F.lit("t").alias("tenant"), F.concat(F.lit("a"), F.expr("repeat('/b', cast(event_id % 70 as int))")).alias("topic"))
    filters = rows(spark, [("t", f) for f in ("#", "a/#", "a/b/b/#", "a/+/b")], "tenant string, filter string")
    return matching.match_topics(t, filters).select("event_id", "filter")


@query(MATCHED + ", a as (select distinct tenant, topic, filter from j), r as (select *, row_number() over (partition by tenant, topic order by filter) as n from a) select tenant, topic, filter from r where n <= 2")
def W8_match_limit(spark, sf):
    found = matching.match_topics(src.messages(spark, sf).select("tenant", "topic").distinct(), src.subscriptions(spark).select("tenant", "filter").distinct())
    return found.withColumn("n", F.row_number().over(Window.partitionBy("tenant", "topic").orderBy("filter"))).where("n <= 2").select("tenant", "topic", "filter")


@query("with e as (select event_id, user_id as conn, event_id % 4 as alias, case when event_id % 3 = 0 then 'top/' || (event_id % 5) end as topic from events), b as (select *, lead(event_id) over (partition by conn, topic order by event_id) as moved from e where topic is not null), l as (select e.*, (select max(event_id) from b where b.conn = e.conn and b.alias = e.alias and b.event_id <= e.event_id) as at from e) select l.event_id, coalesce(l.topic, case when b.moved is null or b.moved > l.event_id then b.topic end) as topic from l left join b on b.event_id = l.at")
def P34_topic_alias(spark, sf):
    e = src.read(spark, sf, "events").select("event_id", F.col("user_id").alias("conn"), (F.col("event_id") % 4).alias("alias"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("top/"), (F.col("event_id") % 5).cast("string"))).alias("topic"))
    moved = F.when(F.col("topic").isNotNull(), F.lead("event_id").over(Window.partitionBy("conn", "topic").orderBy("event_id")))
    bound = F.when(F.col("topic").isNotNull(), F.struct("topic", "moved"))
    last = F.last("bound", ignorenulls=True).over(Window.partitionBy("conn", "alias").orderBy("event_id"))
    made = e.withColumn("moved", moved).withColumn("bound", bound).withColumn("last", last)
    held = F.when(F.col("last.moved").isNull() | (F.col("last.moved") > F.col("event_id")), F.col("last.topic"))
    return made.select("event_id", F.coalesce("topic", held).alias("topic"))


@query(RETAINED + f", {S}, {SP} select client, filter, topic, event_id from sp join t on t.tenant = sp.tenant and {RX} where filter = plain and (client % 3 = 0 or (client % 3 = 1 and client % 2 = 0)) and t.ms + t.expiry * 1000 > {NOW_MS}")
def I14_subscribe(spark, sf):
    """Retained messages that a subscription is sent: handling 0 always, 1 where it is new, 2 never; shared ones get none."""
    subs = src.subscriptions(spark).withColumns({"handling": F.col("client") % 3, "existed": F.col("client") % 2 == 1})
    asks = subs.where((T.share_kind(F.col("filter")) == "normal") & ((F.col("handling") == 0) | ((F.col("handling") == 1) & ~F.col("existed"))))
    table = matching.alive(matching.retained(src.messages(spark, sf)), NOW_MS)
    return matching.match_topics(table, asks).select("client", "filter", "topic", "event_id")
