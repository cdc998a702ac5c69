"""Queries of workers, dispatch, lookups, alignment, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..operators import evaluation, graph, intake, quality, resolve, workers
from .graph_queries import _incoming, _registry
from .inputs import EDGE_EVENTS, MENTIONS, SPARSE_EDGES, edge_events, mentions, sparse_edges, table
from .score_queries import _BATCH, _BY_ROLE, _COUNTS, _SCORES, _TOLD, _checked, _roles, _told
from .text_queries import REASON, _judged, _pairs, asr_sql

#: Tasks of all kinds made of events: texts, voices and images, some without a file, in Spark and in SQL.
_PATH = """case event_id % 6 when 0 then 's3://case/call_' || event_type || '_' || user_id || '_recorded_in_the_evening_of_a_long_day.MP3' when 1 then 'drug-' || event_type || '.jpg' when 2 then 'photo_' || event_id || '.png'
when 3 then 'v-' || event_id || '.amr' else '' end"""
_CONTENT = "case event_id % 7 when 0 then 'Ann took aspirin and Metformin' when 1 then 'hello ' || event_type else 'sertraline for ' || user_id end"
TASKS = f"(select event_id as task_id, {_CONTENT} as content, {_PATH} as file_path, case when event_id % 6 = 4 then 'voice' end as message_type from events)"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("task_id"), F.expr(_CONTENT).alias("content"), F.expr(_PATH).alias("file_path"), F.expr("case when event_id % 6 = 4 then 'voice' end").alias("message_type"))


_SPOKEN = "regexp_replace(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', ''), '[_-]+', ' ', 'g')"
_SCORE = "case when n = 0 then 0.0 when n < 10 then 0.3 when n < 50 then 0.6 else 0.8 end::double"
_VOICES = f"""select task_id, transcript, {_SCORE} as quality_score, {_SCORE} as confidence, {_SCORE} >= 0.7 as usable, case when file_path = '' then 'File not found' end as error
from (select *, length(transcript) as n from (select *, {_SPOKEN} as transcript from {TASKS}))"""


@query("voice_results", f"select * from ({_VOICES})")
def voice_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-3, UDF-6."""
    return workers.voice_results(_tasks(spark, sf_dir), "task_id", "file_path").select("task_id", "transcript", "quality_score", "confidence", "usable", "error")


_IMAGES = f"""select task_id, category, 1.0::double as confidence, ocr_text, round(least(s * (1 - least(((1 - s) * (1 - s) + (b - s) * (b - s) + s * s) / 3, 0.3)), 1.0), 6) as quality_score, case when file_path = '' then 'File not found' end as error
from (select *, 0.5 + 0.3 * b as s from (select *, least(length(ocr_text) / 100.0::double, 1.0) as b from (select *, case when category = 'drug_related' then words else '' end as ocr_text
from (select *, case when contains(lower(words), 'drug') then 'drug_related' else 'normal' end as category from (select *, {_SPOKEN} as words from {TASKS})))))"""


@query("image_results", f"select * from ({_IMAGES})")
def image_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-2, UDF-8."""
    return workers.image_results(_tasks(spark, sf_dir), "task_id", "file_path").select("task_id", "category", "confidence", "ocr_text", "quality_score", "error")


_DRUGS = f"[{', '.join(repr(d) for d in S.DRUGS)}]"
_ROUTED = f"""select *, case when regexp_matches(lower(file_path), '\\.(jpg|jpeg|png|bmp|gif|webp)') then 'image' when regexp_matches(lower(file_path), '\\.(mp3|wav|m4a|amr|aac)') then 'voice' when message_type is not null then message_type else 'text' end as modality,
case when regexp_matches(lower(file_path), '\\.(jpg|jpeg|png|bmp|gif|webp|mp3|wav|m4a|amr|aac)') then 0.9 when message_type is not null then 0.8 else 0.7 end as sure from {TASKS}"""
#: An offline answer tells the drugs in the dictionary's order, and entities always; a text with drugs or without is valid then.
_DISPATCHED = f"""select r.task_id, r.modality, coalesce(v.error, i.error) is null as success,
round(case when coalesce(v.error, i.error) is not null then 0.0 when r.modality = 'voice' then r.sure * v.confidence when r.modality = 'image' then r.sure * i.confidence
  else r.sure * (0.8 + case when len(drugs) > 0 then 0.2 else 0.0 end) end, 6)::double as confidence,
case r.modality when 'voice' then v.transcript when 'image' then i.category else array_to_string(drugs, ',') end as detail, coalesce(v.error, i.error) as error
from (select *, list_filter({_DRUGS}, lambda d: contains(lower(content), d)) as drugs from ({_ROUTED})) r left join ({_VOICES}) v on r.modality = 'voice' and r.task_id = v.task_id left join ({_IMAGES}) i on r.modality = 'image' and r.task_id = i.task_id"""


@query("dispatch_results", _DISPATCHED)
def dispatch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-9 to UDF-11, FIL-6."""
    return workers.dispatched(_tasks(spark, sf_dir))


@query(
    "dispatch_statistics",
    f"select modality, count(*) as tasks, count(*) filter (success) as succeeded, count(*) filter (not success) as failed, round(avg(confidence), 6) as confidence from ({_DISPATCHED}) group by rollup (modality)",
)
def dispatch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workers.dispatch_statistics(workers.dispatched(_tasks(spark, sf_dir)))


_REPLY = """case event_id % 6 when 0 then 'Sure: {"modality": "image", "confidence": 0.65, "reason": "' || event_type || '"} so' when 1 then '{"modality": "voice"}' when 2 then 'no answer' when 3 then '{"modality": "smell", "confidence": 1}'
when 4 then '{broken' || user_id || '}' end"""


@query(
    "model_classify",
    f"""with r as (select event_id, reply, case when json_valid(regexp_extract(reply, '\\{{.*\\}}', 0, 's')) then regexp_extract(reply, '\\{{.*\\}}', 0, 's') end as j, path from (select event_id, {_REPLY} as reply, case when event_id % 4 = 1 then 'x.PNG' else 'y' end as path from events)),
m as (select *, coalesce(j ->> '$.modality', 'text') as kind from r), k as (select *, j is not null and kind in ('text', 'image', 'voice', 'unknown') as by_model, reply is null and regexp_matches(lower(path), '\\.png') as by_name from m)
select event_id, case when by_model then kind when by_name then 'image' else 'text' end as modality, (case when by_model then coalesce((j ->> '$.confidence')::double, 0.5) when by_name then 0.9 else 0.7 end)::double as confidence,
case when by_model then coalesce(j ->> '$.reason', '') when by_name then 'File extension indicates image' else 'Default to text' end as reason, by_model from k""",
)
def model_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-5, MSC-1."""
    path = F.when(F.col("event_id") % 4 == 1, "x.PNG").otherwise("y")
    c = workers.model_classified(F.expr(_REPLY), path, F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", "c.*")


_SAID = """case event_id % 5 when 0 then '{"aspirin": "2"}' when 1 then '{}' when 2 then '[1]' when 3 then 'none' else '{"a": ' || event_id || '}' end"""
_TOLD_OF = """case event_id % 7 when 0 then '{"drugs": []}' when 1 then '{"drugs": ["x"], "persons": []}' when 2 then '{"persons": ["' || event_type || '"]}' when 3 then '{"drugs": null}' when 4 then '{}' when 5 then '"text"' else '{"drugs": "aspirin"}' end"""


@query(
    "result_validation",
    f"""with r as (select event_id, {_SAID} as d, {_TOLD_OF} as e from events), p as (select event_id, case when json_valid(d) then d::json end as d, case when json_valid(e) then e::json end as e from r)
select event_id, coalesce(json_type(d) = 'OBJECT' and json_type(e) = 'OBJECT' and not (len(json_keys(d)) > 0 and list_contains(json_keys(e), 'drugs') and ((e -> '$.drugs')::varchar in ('[]', 'null', '{{}}', '""') or (e -> '$.drugs') is null)), false) as valid from p""",
)
def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-27."""
    return table(spark, sf_dir, "events").select("event_id", S.validated(F.expr(_SAID), F.expr(_TOLD_OF)).alias("valid"))


@query(
    "entity_lookup",
    """select 'id' as "by", s_suppkey as seq from supplier where s_suppkey = 6 union all select 'phone', s_suppkey from supplier where s_suppkey % 2 = 0 and right((s_suppkey + 13800000000)::varchar, 11) = right('8613800000004', 11)
union all select 'name', s_suppkey from supplier where lower(s_name) = (select lower(s_name) from supplier where s_suppkey = 3)""",
)
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-10."""
    reg = _registry(spark, sf_dir)
    name = table(spark, sf_dir, "supplier").filter("s_suppkey = 3").first().s_name
    found = (("id", resolve.lookup(reg, entity_id="ENTITY_000006")), ("phone", resolve.lookup(reg, phone="+86 138-0000-0004")), ("name", resolve.lookup(reg, name=f" {name.upper()} ")))
    parts = [df.select(F.lit(by).alias("by"), "seq") for by, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("first_valid", f"select index from ({REASON}) where reason is null order by index limit 100")
def first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-11."""
    return intake.first_valid(_judged(spark, sf_dir)).select("index")


_SEEN = "(select page_id::varchar as image, s_name as name, s_suppkey as k from pages join supplier on s_suppkey = page_id % 40)"


@query(
    "image_text_edges",
    f"""select 'E' || s_suppkey as source, 'image_' || image as target, round(least(1.0, case when s_suppkey % 2 = 0 then 0.3 else 0.0 end + 0.5 * count(*)), 6)::double as weight
from {_SEEN} join supplier on lower(s_name) = lower(name) group by 1, 2, s_suppkey""",
)
def image_text_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-8."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "pages").select("page_id")
    seen = p.join(s, F.col("s_suppkey") == F.col("page_id") % 40).select(F.col("page_id").cast("string").alias("image"), F.upper("s_name").alias("name"), "s_suppkey")
    entities = s.select(F.col("s_name").alias("name"), F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_suppkey").alias("seq"))
    held = seen.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("image_"), "image").alias("target"), F.lit(0.3).alias("weight"))
    return graph.image_text_edges(seen, entities, held).select("source", "target", "weight")


@query(
    "graph_full_statistics",
    f"""with recursive edges as ({SPARSE_EDGES}), both_ways as (select source as node, target as neighbour from edges union all select target, source from edges where source <> target),
r(node, root) as (select source, source from edges union select target, target from edges union select b.neighbour, r.root from r join both_ways b on b.node = r.node where r.root < b.neighbour),
c as (select node, min(root) as root from r group by 1), n as (select c_custkey as node, c_mktsegment as type from customer), t as (select type, count(*) as n from n group by 1)
select (select count(*) from n) as node_count, (select count(*) from edges) as edge_count, (select count(distinct coalesce(root, node)) from n left join c using (node)) as components,
(select string_agg(type || '=' || n, ',' order by type) from t) as types, round(2.0::double * (select count(*) from edges) / (select count(*) from n), 6) as avg_degree_loops""",
)
def graph_full_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRA-3, GRA-8."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("type"))
    return graph.full_statistics(nodes, sparse_edges(spark, sf_dir)).select("node_count", "edge_count", "components", "types", "avg_degree_loops")


@query(
    "fusion_counters",
    f"""with m as (select case when b.s_suppkey is not null then 1 else 0 end as level from customer left join supplier b on c_custkey = s_suppkey and ((c_custkey % 2 = 0 and c_custkey % 4 <> 0) or c_custkey % 3 = 0 or c_custkey % 5 = 0))
select 'match_level' as counter, level::varchar as value, count(*) as n from m group by 2 union all select 'modality', source, count(*) from ({MENTIONS}) group by 2 union all select 'relation', relation, count(*) from ({EDGE_EVENTS}) group by 2""",
)
def fusion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9."""
    found = resolve.deterministic_matches(_incoming(spark, sf_dir), _registry(spark, sf_dir))
    levels = found.select(F.when(F.col("matched_entity_id").isNotNull(), 1).otherwise(0).alias("match_level"))
    return workers.fusion_counters(levels, mentions(spark, sf_dir).withColumnRenamed("source", "modality"), edge_events(spark, sf_dir))


@query(
    "entity_align",
    f"""with m as (select * from ({MENTIONS})), p as (select a.seq as seq_a, b.seq as seq_b, a.name as na, b.name as nb, a.type as ta, b.type as tb, a.source as sa, b.source as sb, (a.confidence + b.confidence) / 2 as mean,
1 - levenshtein(lower(trim(a.name)), lower(trim(b.name))) / greatest(length(trim(a.name)), length(trim(b.name)))::double as near from m a join m b on a.uuid = b.uuid and a.seq < b.seq),
l as (select *, case when ta <> tb or na = '' or nb = '' then 'none' when lower(na) = lower(nb) then 'deterministic' when contains(lower(na), lower(nb)) or contains(lower(nb), lower(na)) then 'semantic' when sa <> sb and near > 0.6 then 'cross-modal' else 'none' end as level from p)
select seq_a, seq_b, level, round(case level when 'deterministic' then mean when 'semantic' then 0.8 * mean else near * mean * 0.7 end, 6)::double as score from l where level <> 'none'""",
)
def entity_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-5, FN-14: parts of one order."""
    m = mentions(spark, sf_dir)
    return resolve.aligned_pairs(m, m, "uuid").select("seq_a", "seq_b", "level", "score")


@query(
    "external_created",
    """with r as (select o_orderkey as seq, o_custkey as k, o_orderdate as ts from orders where o_custkey % 2 = 1 or o_custkey > (select max(s_suppkey) from supplier)), f as (select k, min(seq) as first from r group by 1),
i as (select k, row_number() over (order by first) + (select count(*) from supplier) as n from f) select seq, 'ENTITY_' || lpad(n::varchar, 6, '0') as entity_id, ts, 'external_activity' as event_type from r join i using (k)""",
)
def external_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI-10: what external records add."""
    o = table(spark, sf_dir, "orders")
    records = o.select(F.col("o_orderkey").alias("seq"), (13800000000 + F.col("o_custkey")).cast("string").alias("phone"), F.lit(None).cast("string").alias("counterparty_phone"), F.lit(1.0).alias("weight"), F.col("o_orderdate").alias("ts"))
    return resolve.created(records, _registry(spark, sf_dir))


@query(
    "quality_report",
    f"""with b as ({_BATCH}) select concat_ws(chr(10), printf('Checked: %d, passed: %d, failed: %d', sum(total)::bigint, sum(passed)::bigint, (sum(total) - sum(passed))::bigint),
string_agg(printf('%s: %d checked, %d passed (%.2f), mean score %.4f', modality, total, passed, pass_rate, average_quality_score), chr(10) order by modality),
printf('Levels: %d excellent, %d good, %d fair, %d poor', sum(n_excellent)::bigint, sum(n_good)::bigint, sum(n_fair)::bigint, sum(n_poor)::bigint)) as report from b""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12."""
    return quality.full_report(_checked(spark, sf_dir))


def _unpivoted(sql: str, name: str, metrics: list[str]) -> str:
    return " union all ".join(f"select '{name}' as evaluation, '{m}' as metric, {m}::double as value from ({sql})" for m in metrics)


_RELATED = f"select tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1 from {_SCORES.format(f'(select {_COUNTS} from {_TOLD})')}"
_ASR = [f"{n}_{m}" for m in ("cer", "wer") for n in ("avg", "min", "max", "std")]


@query(
    "evaluation_report",
    _unpivoted(asr_sql(), "asr", ["samples", *_ASR])
    + " union all "
    + _unpivoted(f"select round(avg(f1), 4) as macro_f1 from ({_BY_ROLE})", "roles", ["macro_f1"])
    + " union all "
    + _unpivoted(_RELATED, "relations", ["tp", "fp", "fn", "tn", "precision", "recall", "f1"])
    + " union all "
    + _unpivoted(f"select round(avg((t = p)::int::double), 6) as accuracy from {_TOLD}", "images", ["accuracy"]),
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-2."""
    told = _told(spark, sf_dir).select(F.col("t").alias("truth"), F.col("p").alias("predicted"))
    rows, roles = _roles(spark, sf_dir)
    return evaluation.evaluated(_pairs(spark, sf_dir), rows, roles, told, told)
