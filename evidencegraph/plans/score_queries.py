"""Queries of quality reports, votes, confusion counts, health and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import context, datagen, metrics, quality
from .inputs import REPORTS, reports, table

CHECKED = f"""
with r as ({REPORTS}), c as (select *, uuid is null or confidence is null as missing, error is not null as failed, coalesce(confidence, 0.0) as conf,
  case modality when 'text' then has_drugs or has_entities when 'voice' then has_transcription and has_quality else has_classification and has_details end as complete,
  case modality when 'text' then case when has_drugs and has_entities and not entity_drugs then 'Extracted drugs but no drug information in entities' end
    when 'voice' then case when voice_score > 0.8 and length(transcript) < 10 then 'High quality score but transcription text is too short' end
    else case when category in ('transaction', 'chat_screenshot') and ocr_text = '' then 'Image category requires text but OCR is empty' end end as clash from r),
s as (select *, least(case when not missing and not failed then 0.3::double else 0.0 end + 0.3::double * conf + case when complete then 0.2::double else 0.0 end + case when clash is null then 0.2::double else 0.0 end, 1.0) as score from c)
select seq, modality, confidence, score as quality_score, case when score >= 0.9 then 'excellent' when score >= 0.7 then 'good' when score >= 0.5 then 'fair' else 'poor' end as quality_level, score >= 0.5 as passed,
  concat_ws('; ', case when missing then 'Missing required fields: ' || concat_ws(', ', case when uuid is null then 'uuid' end, case when confidence is null then 'confidence' end) end, 'Processing error: ' || error) as issues,
  concat_ws('; ', case when conf < 0.5 then 'Low confidence, manual review recommended' end, case when not complete then 'Incomplete data' end, 'Consistency issue: ' || clash) as warnings,
  (case when conf < 0.5 then 1 else 0 end + case when not complete then 1 else 0 end + case when clash is not null then 1 else 0 end) as n_warnings
from s
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.checked(reports(spark, sf_dir))


@query("quality_check", f"select seq, modality, round(quality_score, 6) as quality_score, quality_level, passed, issues, warnings from ({CHECKED})")
def quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checked(spark, sf_dir)
    return c.select("seq", "modality", F.round("quality_score", 6).alias("quality_score"), "quality_level", "passed", F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"))


_BATCH = f"""select modality, count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, round(avg(passed::int::double), 6) as pass_rate, round(avg(quality_score), 6) as average_quality_score,
round(avg(coalesce(confidence, 0)), 6) as average_confidence, {", ".join(f"count(*) filter (quality_level = '{x}') as n_{x}" for x in ("excellent", "good", "fair", "poor"))} from ({CHECKED}) group by 1"""


@query("quality_batch", _BATCH)
def quality_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.batch_report(_checked(spark, sf_dir))


@query(
    "quality_global",
    f"""select quality_level, modality, case when grouping(quality_level) = 1 and grouping(modality) = 1 then 'all' when grouping(modality) = 1 then 'level' else 'modality' end as "by", count(*) as checked,
count(*) filter (passed) as passed, sum(n_warnings)::bigint as warnings from ({CHECKED}) group by grouping sets ((quality_level), (modality), ())""",
)
def quality_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.global_statistics(_checked(spark, sf_dir))


@query("anomaly_tail", f"select seq, modality, issues, warnings from ({CHECKED}) where not passed order by seq desc limit 100")
def anomaly_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = quality.anomalies(_checked(spark, sf_dir))
    return a.select("seq", "modality", F.array_join("issues", "; ").alias("issues"), F.array_join("warnings", "; ").alias("warnings"))


@query("quality_lines", f"select modality, printf('%s: %d checked, %d passed (%.2f), mean score %.4f', modality, total, passed, pass_rate, average_quality_score) as line from ({_BATCH})")
def quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_report(_checked(spark, sf_dir))


@query(
    "quality_histogram",
    f"select count(*) as total, round(avg(quality_score), 6) as average, count(*) filter (quality_score > 0.8) as high, count(*) filter (quality_score between 0.5 and 0.8) as medium, count(*) filter (quality_score < 0.5) as low from (select round(quality_score, 6) as quality_score from ({CHECKED}))",
)
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.histogram(_checked(spark, sf_dir).withColumn("quality", F.round("quality_score", 6)))


@query(
    "health_scores",
    """with e as (select event_type, event_id, event_id % 4 <> 0 as success, (event_id % 10) / 10.0::double as quality, row_number() over (partition by event_type order by event_id desc) as n from events),
s as (select event_type, avg(success::int::double) as rate, coalesce(avg(quality) filter (n <= 10 and success), 0.5) as q from e group by 1)
select event_type, round(rate, 6) as success_rate, round(q, 6) as avg_quality, round(0.6 * rate + 0.4 * q, 6) as health from s""",
)
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("event_id") % 4 != 0).alias("success"), ((F.col("event_id") % 10) / 10.0).alias("quality"))
    return quality.health(e, "event_type", "event_id")


@query(
    "worker_selection",
    """with w as (select event_type as modality, 'w' || user_id % 4 as worker, avg((event_id % 10) / 10.0::double) as health from events group by 1, 2)
select modality, arg_max(worker, (case when worker = 'w2' and health > 0.3 then 1 else 0 end, health, worker)) as selected, count(*) - 1 as n_alternatives from w group by 1""",
)
def worker_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-7."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.col("event_type").alias("modality"), F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("worker")).agg(F.avg((F.col("event_id") % 10) / 10.0).alias("health"))
    return quality.best_worker(w, "w2").select("modality", "selected", F.size("alternatives").cast("long").alias("n_alternatives"))


@query("agent_statistics", "select event_type as agent, count(*) as processed, round(sum((event_id % 100) / 8.0::double) / count(*), 6) as avg_time from events group by 1")
def agent_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.agent_statistics(table(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), ((F.col("event_id") % 100) / 8.0).alias("seconds")))


@query(
    "vote_majority",
    "with c as (select user_id, event_type, count(*) as n, min(event_id) as first from events group by 1, 2) select user_id, arg_max(event_type, (n, -first)) as label, round(max(n) / sum(n)::double, 6) as confidence from c group by 1",
)
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.majority(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("ensemble_pick", "select user_id, arg_max(event_type, (case when event_id % 2 = 0 then 0.7 else 0.3 end, -event_id)) as picked, count(*) as answers from events group by 1")
def ensemble_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 2 == 0, 0.7).otherwise(0.3).alias("w"))
    return metrics.ensemble(e, "user_id", "event_type", "w", "event_id")


_ROLES = ("view", "click", "purchase", "robot")
_F1 = "round(case when {p} + {r} > 0 then 2 * {p} * {r} / ({p} + {r}) else 0 end, 4) as f1"
_SCORES = "(select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0.0 end as r from {0})"
_SAID = "(select event_type as t, case when event_id % 3 = 0 then 'click' when event_id % 7 = 0 then 'view' else event_type end as p from events)"
_BY_ROLE = f"""select role, tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, {_F1.format(p='p', r='r')} from {_SCORES.format(f'''(select role, count(*) filter (t = role and p = role) as tp, count(*) filter (t <> role and p = role) as fp, count(*) filter (t = role and p <> role) as fn
from (values {", ".join(f"('{r}')" for r in _ROLES)}) roles(role), {_SAID} s group by 1)''')}"""


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("true_role"), F.when(i % 3 == 0, "click").when(i % 7 == 0, "view").otherwise(F.col("event_type")).alias("predicted_role"))
    roles = spark.range(1).select(F.explode(F.array(*map(F.lit, _ROLES))).alias("role"))
    return e, roles


@query("role_confusion", _BY_ROLE)
def role_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.role_scores(*_roles(spark, sf_dir))


@query("role_macro_f1", f"select round(avg(f1), 6) as macro_f1 from ({_BY_ROLE})")
def role_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(metrics.role_scores(*_roles(spark, sf_dir)), 6)


_TOLD = "(select lang, quality = 1 as t, n_chars > 1500 as p from documents join labels using (doc_id) where quality is not null)"
_COUNTS = "count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id").select("lang", (F.col("quality") == 1).alias("t"), (F.col("n_chars") > 1500).alias("p"))


@query("relation_confusion", f"select tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, {_F1.format(p='p', r='r')} from {_SCORES.format(f'(select {_COUNTS} from {_TOLD})')}")
def relation_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_told(spark, sf_dir), "t", "p")


@query("type_confusion", f"select lang, tp, fp, fn, tn, round(p, 4) as precision, round(r, 4) as recall, {_F1.format(p='p', r='r')} from {_SCORES.format(f'(select lang, {_COUNTS} from {_TOLD} group by rollup (lang))')}")
def type_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_told(spark, sf_dir), "t", "p", ["lang"])


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("input"), F.col("source").alias("output"))
    return d.select(F.col("lang").alias("task_type"), "input", "output", ((F.col("doc_id") % 100) / 100.0).alias("confidence"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 3 != 0).alias("success"), F.concat(F.lit("E"), (F.col("doc_id") % 5).cast("string")).alias("error_type"))


_CASES = "(select lang as task_type, text as input, source as output, (doc_id % 100) / 100.0::double as confidence, doc_id as seq, doc_id % 3 <> 0 as success, 'E' || doc_id % 5 as error_type from documents)"
_RANKED = "row_number() over (partition by task_type order by {0}confidence desc, seq) as rank"


@query("fewshot_topk", f"select task_type, seq, confidence, rank from (select *, {_RANKED.format('')} from {_CASES} where confidence >= 0.8) where rank <= 5")
def fewshot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.best_cases(_cases(spark, sf_dir)).select("task_type", "seq", "confidence", F.col("rank").cast("long").alias("rank"))


_STORE = f"(select * from {_CASES} where confidence >= 0.98)"


@query(
    "example_refresh",
    f"""with new as (select * from (select *, {_RANKED.format('')} from {_CASES} where confidence >= 0.8) where rank <= 3),
fresh as (select * from (select *, row_number() over (partition by task_type, input order by confidence desc, seq) as n from new) where n = 1 and (task_type, input) not in (select (task_type, input) from {_STORE})),
both_ as (select task_type, seq, confidence from {_STORE} union all select task_type, seq, confidence from fresh)
select task_type, seq, confidence, rank from (select *, {_RANKED.format('')} from both_) where rank <= 10""",
)
def example_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cases(spark, sf_dir)
    return context.refreshed(c.filter("confidence >= 0.98"), c).select("task_type", "seq", "confidence", F.col("rank").cast("long").alias("rank"))


@query(
    "example_fetch",
    f"""with h as (select * from (select *, {_RANKED.format('')} from {_CASES} where confidence >= 0.8) where rank <= 5),
both_ as (select task_type, seq, confidence, 0 as origin from {_STORE} union all select task_type, seq, confidence, 1 from h)
select task_type, seq, rank from (select *, {_RANKED.format('origin, ')} from both_) where rank <= 5""",
)
def example_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-5."""
    c = _cases(spark, sf_dir)
    return context.examples(c.filter("confidence >= 0.98"), c).select("task_type", "seq", F.col("rank").cast("long").alias("rank"))


@query(
    "prompt_texts",
    f"""select task_type, 'Do this:' || chr(10) || chr(10) || string_agg('Input: ' || input || chr(10) || 'Output: ' || output, chr(10) || chr(10) order by rank) as prompt
from (select *, {_RANKED.format('')} from {_CASES} where confidence >= 0.8) where rank <= 5 group by 1""",
)
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-6."""
    return context.prompts(context.best_cases(_cases(spark, sf_dir)), "Do this:")


@query("case_triggers", f"select task_type, seq, nth from (select *, row_number() over (partition by task_type order by seq) as nth from {_CASES}) where nth % 10 = 0")
def case_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2."""
    return context.triggers(_cases(spark, sf_dir), 10).select("task_type", "seq", F.col("nth").cast("long").alias("nth"))


@query("context_statistics", f"select task_type, count(*) as cases, count(*) filter (success) as successes, round(avg(success::int::double), 6) as success_rate from {_CASES} group by 1")
def context_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.statistics(_cases(spark, sf_dir))


@query("failure_counts", f"select error_type, count(*) as n from {_CASES} where not success group by 1")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.failures(_cases(spark, sf_dir))


@query(
    "vector_topk",
    """with v as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) as score
from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-15: the queries are the rows whose id 50 divides, against all rows."""
    v = table(spark, sf_dir, "embeddings")
    return context.nearest(v.filter("vec_id % 50 = 0"), v).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "function_results",
    "select conv_id, turn, call, text as result from (select *, lag(text) over w as call, lag(role) over w as caller from conversations window w as (partition by conv_id order by turn)) where role = 'assistant' and caller = 'user'",
)
def function_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.function_results(table(spark, sf_dir, "conversations"))


@query("generated_annotations")
def generated_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEN-1: rows of each generated table."""
    made = {"users": datagen.users(spark), "relations": datagen.relations(spark), "messages": datagen.messages(spark), "asr": datagen.asr_pairs(spark), "images": datagen.images(spark)}
    out = None
    for name, df in made.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
