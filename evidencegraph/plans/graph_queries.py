"""Queries of entity resolution, the relationship graph and the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph, resolve
from ..tables import spread
from .inputs import EDGE_EVENTS, MENTIONS, SPARSE_EDGES, edge_events, mentions, sparse_edges, table

UPSERTED = f"""
select least(source, target) as source, greatest(source, target) as target, sum(weight) as weight, count(*) as frequency,
       arg_min(relation, seq) as relation, min(ts) as ts
from ({EDGE_EVENTS}) group by 1, 2
"""
_BOTH = "(select source as node, target as neighbour, weight from edges union all select target, source, weight from edges where source <> target)"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a registry whose phones some customers share."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return resolve.with_keys(
        s.select(
            k.alias("seq"),
            F.format_string("ENTITY_%06d", k).alias("entity_id"),
            F.col("s_name").alias("name"),
            F.when(k % 2 == 0, (13800000000 + k).cast("string")).alias("phone"),
            F.when(k % 3 == 0, F.concat(F.lit(" WX"), k.cast("string"))).alias("wechat"),
            F.when(k % 5 == 0, F.concat(F.lit("62 "), k.cast("string"))).alias("account"),
            F.lit(1).alias("merged_count"),
        )
    )


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return resolve.with_keys(
        c.select(
            k.alias("seq"),
            F.col("c_name").alias("name"),
            F.when(k % 4 != 0, F.concat(F.lit("+86 "), (13800000000 + k).cast("string"))).alias("phone_number"),
            F.concat(F.lit("wx"), k.cast("string")).alias("handle"),
            F.concat(F.lit("62"), k.cast("string")).alias("bank_account"),
        )
    )


@query(
    "deterministic_match",
    """with r as (select s_suppkey as k, case when s_suppkey % 2 = 0 then 13800000000 + s_suppkey end::varchar as phone, case when s_suppkey % 3 = 0 then ' WX' || s_suppkey end as wechat, case when s_suppkey % 5 = 0 then '62 ' || s_suppkey end as account from supplier),
n as (select k, right(regexp_replace(phone, '[^0-9]', '', 'g'), 11) as phone, lower(trim(wechat)) as wechat, regexp_replace(account, '\\s+', '', 'g') as account from r),
i as (select c_custkey as seq, right(regexp_replace(case when c_custkey % 4 <> 0 then '+86 ' || (13800000000 + c_custkey) end, '[^0-9]', '', 'g'), 11) as phone, 'wx' || c_custkey as wechat, '62' || c_custkey as account from customer),
m as (select seq, p.k as p, w.k as w, a.k as a from i left join n p on p.phone = i.phone left join n w on w.wechat = i.wechat left join n a on a.account = i.account)
select seq, 'ENTITY_' || lpad(coalesce(p, w, a)::varchar, 6, '0') as matched_entity_id, case when p is not null then 'phone' when w is not null then 'wechat' when a is not null then 'account' end as matching_field,
(case when p is not null or w is not null then 1.0 when a is not null then 0.9 else 0.0 end)::double as match_confidence from m""",
)
def deterministic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.deterministic_matches(_incoming(spark, sf_dir), _registry(spark, sf_dir))
    return out.select("seq", "matched_entity_id", "matching_field", "match_confidence")


@query("fuzzy_match")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-2: part names with an edit against those without."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("seq"))
    reg = names.select("seq", F.format_string("ENTITY_%06d", F.col("seq")).alias("entity_id"), F.col("p_name").alias("n_name"))
    new = names.select("seq", F.concat(F.lit("x"), F.expr("substring(p_name, 2)")).alias("n_name"))
    return resolve.fuzzy_matches(new, reg).select("seq", "matched_entity_id", F.round("score", 6).alias("score"))


@query(
    "registry_statistics",
    """select count(*) as total_entities, count(*) filter (s_suppkey % 2 = 0) as phone_indexed, count(*) filter (s_suppkey % 3 = 0) as wechat_indexed, 0::bigint as idcard_indexed,
count(*) filter (s_suppkey % 5 = 0) as account_indexed, count(distinct lower(s_name)) as name_indexed, 1.0::double as avg_merged_count from supplier""",
)
def registry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.registry_statistics(_registry(spark, sf_dir))


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as mentions: three share a name of letters, one of them with an edit; thirds share a phone."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.translate(F.md5(F.floor(k / 3).cast("string")), "0123456789", "ghijklmnop")
    return c.select(
        k.alias("seq"),
        F.when(k % 3 == 1, F.concat(name, F.lit("x"))).otherwise(name).alias("name"),
        F.when(k % 3 == 0, (13900000000 + F.floor(k / 30)).cast("string")).alias("phone"),
        F.when(k % 7 == 0, F.concat(F.lit("acct"), F.floor(k / 70).cast("string"))).alias("account"),
        F.col("c_mktsegment").alias("source"),
        (0.5 + (k % 5) / 10.0).alias("confidence"),
    )


@query("resolve_in_order")
def resolve_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_in_order(_persons(spark, sf_dir))[1]


@query(
    "resolve_as_set",
    """with recursive p as (select c_custkey as seq, case when c_custkey % 3 = 0 then c_custkey // 30 end as phone, case when c_custkey % 7 = 0 then c_custkey // 70 end as account from customer),
e as (select a.seq as a, b.seq as b from p a join p b on a.phone = b.phone or a.account = b.account), r(seq, entity) as (select seq, seq from p union select e.b, r.entity from r join e on e.a = r.seq)
select seq, min(entity) as entity from r group by seq""",
)
def resolve_as_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_as_set(_persons(spark, sf_dir))


@query(
    "entity_fuse",
    f"""select lower(trim(name)) as key, arg_max(type, (confidence, -seq)) as type, array_to_string(list_sort(list(distinct source)), ',') as sources, count(*) as mention_count, count(uuid) as n_uuids,
'deterministic' as match_level, round(least(1.0, avg(confidence) * 1.2), 6)::double as confidence, min(seq) as first_seq from ({MENTIONS}) group by 1""",
)
def entity_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = resolve.fused(mentions(spark, sf_dir))
    return e.select("key", "type", F.array_join("sources", ",").alias("sources"), "mention_count", F.size("uuids").cast("long").alias("n_uuids"), "match_level", F.round("confidence", 6).alias("confidence"), "first_seq")


def _attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        ((F.col("o_orderkey") % 7) / 10.0).alias("confidence"),
        F.col("o_orderstatus").alias("source"),
    )


_ATTRIBUTES = "(select o_custkey as entity, o_orderkey as seq, case when o_orderkey % 3 <> 0 then o_orderpriority else '' end as priority, o_orderstatus as status, (o_orderkey % 7) / 10.0::double as confidence, o_orderstatus as source from orders)"


@query(
    "survivorship",
    f"""select entity, arg_max(priority, (confidence, -seq)) filter (priority <> '') as priority, arg_max(status, (confidence, -seq)) as status, array_to_string(list_sort(list(distinct source)), ',') as sources, count(*) as merged_count from {_ATTRIBUTES} group by 1""",
)
def survivorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.survivors(_attributes(spark, sf_dir), "entity", ["priority", "status"]).withColumn("sources", F.array_join("sources", ","))


@query(
    "conflict_rows",
    f"""with long as (select entity, seq, confidence, 'priority' as attribute, priority as value from {_ATTRIBUTES} where priority <> '' union all select entity, seq, confidence, 'status', status from {_ATTRIBUTES}),
kept as (select *, first_value(value) over w as resolved from long window w as (partition by entity, attribute order by confidence desc, seq))
select distinct entity, attribute, value as rejected, resolved, 'existing_value' as strategy from kept where value <> resolved""",
)
def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.conflicts(_attributes(spark, sf_dir), "entity", ["priority", "status"])


@query(
    "ema_confidence",
    """select user_id as entity, count(*) as mentions, round(list_reduce(list(((event_id % 10) / 10.0)::double order by event_id), lambda c, x: 0.3 * x + 0.7 * c), 6) as confidence from events group by 1""",
)
def ema_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return resolve.running_confidence(e, "entity", "seq")


@query(
    "external_integration",
    """with r as (select o_orderkey as seq, o_custkey as k, o_custkey + 1 as q from orders)
select seq, case when k % 2 = 0 then 'ENTITY_' || lpad(a.s_suppkey::varchar, 6, '0') end as entity_id, case when q % 2 = 0 then 'ENTITY_' || lpad(b.s_suppkey::varchar, 6, '0') end as counterparty_id,
coalesce(a.s_suppkey is not null and k % 2 = 0, false) as matched, (case when seq % 2 = 0 then 2.0 else 1.0 end)::double as weight
from r left join supplier a on a.s_suppkey = k left join supplier b on b.s_suppkey = q""",
)
def external_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    records = o.select(F.col("o_orderkey").alias("seq"), (13800000000 + k).cast("string").alias("phone"), (13800000001 + k).cast("string").alias("counterparty_phone"), F.when(F.col("o_orderkey") % 2 == 0, 2.0).alias("weight"))
    return resolve.integrated(records, _registry(spark, sf_dir)).select("seq", "entity_id", "counterparty_id", "matched", "weight")


COOCCURRENCES = f"""
with once as (select uuid, entity, max(confidence) as c from ({MENTIONS}) group by 1, 2),
pairs as (select a.entity as source, b.entity as target, count(*) as common from once a join once b on a.uuid = b.uuid and a.entity < b.entity group by 1, 2),
conf as (select entity, max(confidence) as c from ({MENTIONS}) group by 1)
select source, target, common, common * (x.c + y.c) / 2 as weight from pairs join conf x on x.entity = source join conf y on y.entity = target
"""


@query("cooccurrence_edges", f"select source, target, common, round(weight, 6) as weight from ({COOCCURRENCES})")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrences(mentions(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("edge_upsert", f"select source, target, round(weight, 6) as weight, frequency, relation, ts from ({UPSERTED})")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert(edge_events(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("relation_distribution", f"select relation, count(*) as n, round(sum(weight), 6) as weight from ({EDGE_EVENTS}) group by 1")
def relation_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_distribution(edge_events(spark, sf_dir))


@query("edges_of_type", f"select distinct least(source, target) as source, greatest(source, target) as target from ({EDGE_EVENTS}) where relation = 'transfer'")
def edges_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.of_type(edge_events(spark, sf_dir), "transfer")


@query("edges_in_time", f"select source, target, frequency from ({UPSERTED}) where ts is null or ts between timestamp '1995-01-01' and timestamp '1996-12-31'")
def edges_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.upsert(edge_events(spark, sf_dir))
    return graph.in_time(e, F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")).select("source", "target", "frequency")


@query(
    "relation_edges",
    """with ids as (select lower(n_name) as n, arg_max(n_nationkey, n_nationkey) as id from nation group by 1),
r as (select lower(a.n_name) as s, lower(b.n_name) as t, a.n_nationkey * 100 + b.n_nationkey as seq from nation a join nation b on a.n_regionkey = b.n_regionkey),
p as (select least(x.id, y.id) as source, greatest(x.id, y.id) as target, count(*) as n from r join ids x on x.n = s join ids y on y.n = t where x.id <> y.id group by 1, 2)
select source, target, 'associated' as relation, round(case when target - source = 1 then least(1.0, 0.2 + 0.3 * n) else least(1.0, 0.3 * n) end, 6)::double as weight, target - source = 1 as existed from p""",
)
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    a = n.select(F.col("n_name").alias("source"), "n_regionkey", F.col("n_nationkey").alias("i"))
    b = n.select(F.col("n_name").alias("target"), "n_regionkey", F.col("n_nationkey").alias("j"))
    relations = a.join(b, "n_regionkey").select("source", "target", F.lit("associated").alias("type"), (F.col("i") * 100 + F.col("j")).alias("seq"))
    entities = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("entity_id"), F.col("n_nationkey").alias("seq"))
    existing = n.select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") + 1).alias("target"), F.lit(0.2).alias("weight"))
    return graph.relation_edges(relations, entities, existing)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"), F.min("event_id").alias("id"))


_POINTS = "(select user_id, event_type, min(ts) as ts, min(event_id) as id from events group by 1, 2)"


@query(
    "temporal_edges",
    f"""select a.user_id, least(a.id, b.id) as source, greatest(a.id, b.id) as target, round(1 / (1 + (epoch_us(b.ts) - epoch_us(a.ts)) / 3.6e9::double), 6) as weight, a.ts as ts
from {_POINTS} a join {_POINTS} b on a.user_id = b.user_id and b.ts > a.ts and epoch_us(b.ts) - epoch_us(a.ts) < 86400000000""",
)
def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.temporal_edges(_points(spark, sf_dir), ["user_id"])
    return e.select("user_id", "source", "target", F.round("weight", 6).alias("weight"), "ts")


@query("multimodal_edges", f"select a.user_id, a.id as source, b.id as target, 0.8::double as weight from {_POINTS} a join {_POINTS} b on a.user_id = b.user_id and a.id < b.id and a.event_type <> b.event_type")
def multimodal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.multimodal_edges(_points(spark, sf_dir).withColumn("modality", F.col("event_type")), "user_id").drop("relation")


@query(
    "shared_source_edges",
    """with s as (select distinct l_suppkey as e, l_orderkey as s from lineitem)
select a.e as source, b.e as target, count(*)::double as weight from s a join s b on a.s = b.s and a.e < b.e group by 1, 2""",
)
def shared_source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), "l_orderkey"), "entity_id").groupBy("entity_id").agg(F.collect_set("l_orderkey").alias("sources"))
    return graph.shared_source_edges(li).drop("relation")


@query(
    "graph_stats",
    f"""with edges as ({COOCCURRENCES}), nodes as (select distinct entity as node from ({MENTIONS})), d as (select node, count(neighbour) as degree from nodes left join {_BOTH} b using (node) group by 1),
n as (select count(*) as node_count, avg(degree) as avg_degree, max(degree) as max_degree, min(degree) as min_degree from d), e as (select count(*) as edge_count, sum(weight) as total_weight from edges)
select node_count, edge_count, round(avg_degree, 6) as avg_degree, max_degree, min_degree, round(total_weight / edge_count, 6) as avg_edge_weight, round(total_weight, 6) as total_weight,
round(edge_count / (node_count * (node_count - 1) / 2.0::double), 6) as density from n, e""",
)
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    return graph.statistics(m.select(F.col("entity").alias("node")), graph.cooccurrences(m))


@query("degrees", f"with edges as ({UPSERTED}) select node, count(*) as degree, round(sum(weight), 6) as weighted_degree from {_BOTH} group by 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.upsert(edge_events(spark, sf_dir))).withColumn("weighted_degree", F.round("weighted_degree", 6))


@query(
    "connected_components",
    f"""with recursive edges as ({SPARSE_EDGES}), r(node, root) as (select source, source from edges union select target, target from edges union select b.neighbour, r.root from r join {_BOTH} b on b.node = r.node where r.root < b.neighbour)
select node, min(root) as component from r group by 1""",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(sparse_edges(spark, sf_dir).select(F.col("source").alias("a"), F.col("target").alias("b")))


def _star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return graph.upsert(edge_events(spark, sf_dir)), 1


_HOPS = f"""with recursive edges as ({UPSERTED}), both_ways as {_BOTH}, r(node, hops) as (select 1::bigint, 0 union select b.neighbour, r.hops + 1 from r join both_ways b on b.node = r.node where r.hops < {{0}}),
d as (select node, min(hops) as hops from r group by 1)"""


@query("path_lengths", _HOPS.format(3) + " select node, hops from d")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, start = _star(spark, sf_dir)
    return graph.distances(e, F.lit(start).cast("long"), 3).select("node", "hops")


@query("shortest_path", _HOPS.format(4) + ", t as (select max(node) as node from d where hops = 2) select hops from d join t using (node)")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, start = _star(spark, sf_dir)
    d = graph.distances(e, F.lit(start).cast("long"), 4)
    end = d.filter("hops = 2").agg(F.max("node").alias("node"))
    return d.join(end, "node").select("hops")


@query("ego_network", _HOPS.format(1) + " select source, target, round(weight, 6) as weight from edges where source in (select node from d) and target in (select node from d)")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, start = _star(spark, sf_dir)
    return graph.ego_network(e, F.lit(start).cast("long"), 1).select("source", "target", F.round("weight", 6).alias("weight"))


@query("communities")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(sparse_edges(spark, sf_dir))


@query("isolated_entities", "select c_custkey as entity_id from customer where c_nationkey % 4 <> 1 and c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and o_orderkey % 3 = 0)")
def isolated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_nationkey") % 4 == 1, 2).otherwise(1).alias("merged_count"))
    e = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("source"), F.lit(-1).cast("long").alias("target"), F.lit(1.0).alias("weight"))
    return graph.isolated(c, e).select("entity_id")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("entity_id"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("ts"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))


_TIMELINE = "select ts, user_id as entity_id, event_id as seq, 'entity_activity' as event_type, (event_id % 10) / 10.0::double as confidence from events where event_id % 9 <> 0 and event_id % 10 >= 5"


@query("timeline", _TIMELINE)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.timeline(_dated(spark, sf_dir))


@query("timeline_coverage", f'select min(ts) as "start", max(ts) as "end", count(*) as events from ({_TIMELINE})')
def timeline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coverage(graph.timeline(_dated(spark, sf_dir)))


@query("timeline_extended", f"select ts, entity_id, seq, event_type from ({_TIMELINE}) union all select o_orderdate, o_custkey, o_orderkey, 'external_activity' from orders")
def timeline_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    external = o.select(F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("seq"), F.lit("external_activity").alias("event_type"))
    return graph.extended_timeline(graph.timeline(_dated(spark, sf_dir)), external).select("ts", "entity_id", "seq", "event_type")


@query(
    "temporal_context",
    """with t as (select user_id as node, min(ts) as ts from events group by 1), c as (select min(node) as node from t)
select t.node, round(abs(epoch_us(t.ts) - epoch_us(o.ts)) / 3.6e9::double, 6) as hours, 1.0::double as weight from t, c join t o on o.node = c.node
where t.node <> c.node and abs(epoch_us(t.ts) - epoch_us(o.ts)) <= 86400000000""",
)
def temporal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.min("ts").alias("ts"))
    first = t.agg(F.min("node")).first()[0]
    edges = t.filter(F.col("node") != first).select(F.lit(first).cast("long").alias("source"), F.col("node").alias("target"), F.lit(1.0).alias("weight"))
    return graph.temporal_context(edges, t, F.lit(first).cast("long")).withColumn("hours", F.round("hours", 6))


@query("windowed_counts", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.fusion import windowed_counts as counts

    return counts(table(spark, sf_dir, "events"))


@query(
    "user_sessions",
    """with m as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m)
select user_id, min(ts) as "start", max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.fusion import sessions

    return sessions(table(spark, sf_dir, "events"), "user_id")
