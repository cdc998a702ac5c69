"""Queries of intake, scalar rules, pseudonyms and providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars as S
from ..functions.similarity import aligned_name, alignment_of
from ..operators import intake, metrics, providers, pseudonymize
from ..operators.name_pairs import SAME, UNNAMED, WITHIN, measured
from .inputs import MESSAGES, messages, table

SALT = "a salt of the case"
REASON = f"""
select index, case when content is null then 'missing key: content' when trim(content) = '' then 'content invalid'
  when uuid is null then 'missing key: uuid or id' when time_kind is null then 'timestamp invalid type' end as reason
from ({MESSAGES})
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    none = F.lit(None).cast("string")
    return m.withColumn("reason", intake.reason(F.col("content"), F.lit(True), F.col("uuid"), F.col("uuid").isNotNull(), none, F.col("time_kind")))


@query("intake_validate", REASON)
def intake_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("index", "reason")


@query(
    "intake_report",
    f"""with r as ({REASON}), first as (select * from r where reason is not null order by index limit 200)
select (select count(*) from r where reason is null) as valid_count, (select count(*) from r where reason is not null) as error_count,
       (select string_agg(index || ':' || reason, ',' order by index) from first) as errors""",
)
def intake_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, errors = intake.split_valid(_judged(spark, sf_dir))
    text = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["index"].cast("string"), e["reason"])), ",")
    return intake.quality_report(valid, errors).select("valid_count", "error_count", text.alias("errors"))


_KIND = """case when regexp_matches(lower(url), '\\.(jpg|jpeg|png|bmp|gif|webp)') then 'image' when regexp_matches(lower(url), '\\.(mp3|wav|m4a|amr|aac)') then 'voice'
when page_id % 5 = 0 then 'image' when page_id % 7 = 0 then 'voice' else 'text' end"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 0, F.concat("url", F.lit(".PNG"))).when(F.col("page_id") % 11 == 0, F.concat("url", F.lit(".mp3?x"))).otherwise(F.col("url")).alias("url"))
    kind = F.when(F.col("page_id") % 5 == 0, "image").when(F.col("page_id") % 7 == 0, "voice")
    return p.select("page_id", intake.classified(F.col("url"), kind).alias("c")).select("page_id", "c.*")


_PAGES = "(select page_id, case when page_id % 9 = 0 then url || '.PNG' when page_id % 11 = 0 then url || '.mp3?x' else url end as url from pages)"


@query(
    "modality_classify",
    f"""with m as (select page_id, {_KIND} as modality, regexp_matches(lower(url), '\\.(jpg|jpeg|png|bmp|gif|webp|mp3|wav|m4a|amr|aac)') as by_name from {_PAGES})
select page_id, modality, (case when by_name then 0.9 when modality <> 'text' then 0.8 else 0.7 end)::double as confidence,
  (case when by_name then 0.1 when modality <> 'text' then 0.2 else 0.8 end)::double as p_text,
  (case modality when 'image' then case when by_name then 0.8 else 0.7 end else 0.1 end)::double as p_image,
  (case modality when 'voice' then case when by_name then 0.8 else 0.7 end else 0.1 end)::double as p_voice,
  false as requires_verification from m""",
)
def modality_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).drop("reason")


@query("modality_counts", f"select {_KIND} as modality, count(*) as n from {_PAGES} group by 1")
def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    return _classified(spark, sf_dir).groupBy("modality").agg(F.count("*").alias("n"))


@query(
    "task_numbering",
    """select 'task_' || (row_number() over (order by case modality when 'text' then 0 when 'voice' then 1 else 2 end, pos) - 1) as task_id, modality, pos
from (select case role when 'system' then 'voice' else 'text' end as modality, conv_id * 1000 + turn as pos from conversations union all select 'image', page_id from pages)""",
)
def task_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "system", "voice").otherwise("text").alias("modality"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    p = table(spark, sf_dir, "pages").select(F.lit("image").alias("modality"), F.col("page_id").alias("pos"))
    return intake.numbered(c.unionByName(p)).select("task_id", "modality", "pos")


@query(
    "timestamp_normalize",
    "select event_id, case event_id % 5 when 3 then '' else strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end as at from events",
)
def timestamp_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, ts = table(spark, sf_dir, "events"), F.col("event_id") % 5, F.col("ts").cast("timestamp")
    raw = (
        F.when(k == 0, F.unix_seconds(ts).cast("string")).when(k == 1, F.unix_millis(ts).cast("string")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS+08:00")).when(k == 3, "").otherwise("no time")
    )
    return e.select("event_id", S.normalized_time(raw).alias("at"))


_SPOKEN = """case event_id % 6 when 0 then 'x {"voiceLength": ' || event_id % 60 || '} y' when 1 then 'voiceLength: ' || event_id % 90 when 2 then 'no length' when 3 then '{voiceLength: 9}' when 4 then '{"voiceLength": 12' else '{"length": ' || user_id || '}' end"""


@query(
    "voice_duration",
    f"""with c as (select event_id, {_SPOKEN} as t from events), b as (select *, regexp_extract(t, '\\{{.*\\}}', 0, 's') as j, regexp_extract(t, 'voiceLength["'']?\\s*:\\s*["'']?([0-9]+)', 1) as w from c)
select event_id, coalesce(try_cast(case when j <> '' then case when json_valid(j) then j ->> '$.voiceLength' end else w end as int), 0) as seconds from b""",
)
def voice_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.voice_duration(F.expr(_SPOKEN)).alias("seconds"))


@query(
    "mime_lookup",
    """select event_type, case event_type when 'view' then 'audio/mpeg' when 'click' then 'audio/m4a' when 'signup' then 'audio/ogg' else 'audio/wav' end as mime, count(*) as n from events group by 1, 2""",
)
def mime_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.create_map(*[F.lit(x) for pair in {"view": "MP3", "click": "m4a", "signup": "ogg", "purchase": "xyz", "error": "wav"}.items() for x in pair])
    path = F.concat(F.lit("dir.x/file."), F.try_element_at(endings, F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy("event_type", S.mime_type(path).alias("mime")).agg(F.count("*").alias("n"))


@query(
    "normalize_keys",
    """select c_custkey, right('0086' || (13800000000 + c_custkey), 11) as phone, lower(c_name) as name, 'AB' || c_custkey || 'X' as idcard, 'acct' || c_custkey as account from customer""",
)
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    phone = F.concat(F.lit("+0086-"), (F.lit(13800000000) + F.col("c_custkey")).cast("string"))
    return c.select(
        "c_custkey",
        S.normalized_phone(phone).alias("phone"),
        S.normalized_name(F.concat(F.lit(" \t"), "c_name", F.lit("　"))).alias("name"),
        S.normalized_idcard(F.concat(F.lit("ab "), k, F.lit(" x"))).alias("idcard"),
        S.normalized_account(F.concat(F.lit(" acct "), k)).alias("account"),
    )


#: DuckDB's levenshtein goes by bytes, so what isn't ASCII is taken from these few short rows in Spark and SQL alike.
_PAIRS = """(select item_id, a as reference, coalesce(b, '') as hypothesis from (select item_id, text as a,
lead(text) over (order by item_id) as b from (select item_id, regexp_replace(text, '[^ -~]', ' ', 'g') as text from benchmark)))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", " ").alias("text"))
    nxt = F.lead("text").over(Window.orderBy("item_id"))  # the benchmark is small and of fixed size
    return b.select("item_id", F.col("text").alias("reference"), F.coalesce(nxt, F.lit("")).alias("hypothesis"))


@query("cer_samples", f"select item_id, round(case when reference = '' then case when hypothesis = '' then 0.0 else 1.0 end else levenshtein(reference, hypothesis) / length(reference)::double end, 6) as cer from {_PAIRS}")
def cer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("item_id", F.round(S.error_rate(F.col("reference"), F.col("hypothesis")), 6).alias("cer"))


_WORDS = f"""(select item_id, list_filter(string_split(reference, ' '), lambda x: x <> '') as r, list_filter(string_split(hypothesis, ' '), lambda x: x <> '') as h from {_PAIRS})"""
_CODED = f"""(select item_id, len(r) as n, len(h) as m, array_to_string(list_transform(r, lambda x: chr(list_position(k, x)::int)), '') as a,
array_to_string(list_transform(h, lambda x: chr(list_position(k, x)::int)), '') as b from (select *, list_distinct(list_concat(r, h)) as k from {_WORDS}))"""


@query("wer_samples", f"select item_id, round(case when n = 0 then case when m = 0 then 0.0 else 1.0 end else levenshtein(a, b) / n::double end, 6) as wer from {_CODED}")
def wer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("item_id", F.round(S.word_error_rate(F.col("reference"), F.col("hypothesis")), 6).alias("wer"))


def asr_sql() -> str:
    cer = "case when reference = '' then case when hypothesis = '' then 0.0 else 1.0 end else levenshtein(reference, hypothesis) / length(reference)::double end"
    wer = "case when n = 0 then case when m = 0 then 0.0 else 1.0 end else levenshtein(a, b) / n::double end"
    of = lambda m: f"round(avg({m}), 4) as avg_{m}, round(min({m}), 4) as min_{m}, round(max({m}), 4) as max_{m}, round(coalesce(stddev_samp({m}), 0.0), 4) as std_{m}"
    return f"select count(*) as samples, {of('cer')}, {of('wer')} from (select item_id, {cer} as cer from {_PAIRS}) join (select item_id, {wer} as wer from {_CODED}) using (item_id)"


@query("asr_metrics", asr_sql())
def asr_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    return metrics.error_rates(_pairs(spark, sf_dir))


_NAMES = "(select s_suppkey, c_custkey, lower(s_name) as a, lower(c_name) as b from supplier join customer on s_nationkey = c_nationkey)"


def _names(spark: SparkSession, sf_dir: str, measure: str, key: Callable[[Column], Column] = F.lower) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), key(F.col("s_name")).alias("a"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), key(F.col("c_name")).alias("b"))
    return measured(s, c, "n", "a", "b", measure)


@query(
    "name_jaccard",
    f"""select s_suppkey, c_custkey, round(len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, ''))))::double, 6) as jaccard from {_NAMES}""",
)
def name_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, "jaccard")


@query("name_edit_ratio", f"select s_suppkey, c_custkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::double, 6) as ratio from {_NAMES}")
def name_edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, "edit_ratio")


@query("name_composite")
def name_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir, "composite")


@query(
    "align_similarity",
    f"""select s_suppkey, c_custkey, level, round(case level when 'semantic' then 0.8 * 0.7 when 'cross-modal' then near * 0.7 * 0.7 else 0 end, 6)::double as score from (
select *, case when contains(a, b) or contains(b, a) then 'semantic' when c_custkey % 2 = 0 and near > 0.6 then 'cross-modal' else 'none' end as level
from (select *, 1 - levenshtein(a, b) / greatest(length(a), length(b))::double as near from {_NAMES}))""",
)
def align_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("c_custkey") % 2 == 0, "voice").otherwise("text")
    rows = _names(spark, sf_dir, "nearness", aligned_name)
    k = F.col("kind")
    m = alignment_of(k == UNNAMED, k == SAME, k == WITHIN, F.col("near"), F.lit(0.6), F.lit("text"), F.lit(0.8), source)
    return rows.withColumn("m", m).select("s_suppkey", "c_custkey", F.col("m.level").alias("level"), F.round("m.score", 6).alias("score"))


_BEHAVED = """(select event_id, 'u' || user_id as a, event_type as b, case event_id % 8 when 0 then 'Transfer ' || event_id || '.50 received' when 1 then 'hongbao ' || event_id || ' expired'
when 2 then 'Voice Call ' || event_id % 100 || ' 秒' when 3 then 'shipin' when 4 then 'please ADD FRIEND' when 5 then 'location north gate' when 6 then 'transfer returned' else 'hello ' || event_type end as content from events)"""


@query(
    "behavior_normalize",
    f"""with t as (select *, lower(content) as low, coalesce(nullif(regexp_extract(content, '([0-9]+(?:\\.[0-9]+)?)', 1), ''), '0') as amount, coalesce(nullif(regexp_extract(content, '([0-9]+)\\s*秒', 1), ''), '0') as seconds, coalesce(nullif(regexp_extract(content, '([^\\s]{{2,}})', 1), ''), 'unknown') as place from {_BEHAVED}),
k as (select *, case when regexp_matches(low, 'transfer|zhuanzhang') then 'transfer' when regexp_matches(low, 'red envelope|hongbao') then 'red_envelope' when regexp_matches(low, 'voice call|yuyin') then 'call_voice' when regexp_matches(low, 'video call|shipin') then 'call_video'
when regexp_matches(low, 'add friend|tianjiahaoyou') then 'add_contact' when regexp_matches(low, 'location|weizhi') then 'location' else 'message' end as type from t)
select event_id, type, case type when 'transfer' then 'transfer: ' || amount || ' CNY from ' || a || ' to ' || b || ', ' || case when regexp_matches(low, 'received|yishoukuank') then 'received' when contains(low, 'returned') then 'returned' else 'pending' end
when 'red_envelope' then 'red_envelope: ' || amount || ' CNY from ' || a || ' to ' || b || ', ' || case when contains(low, 'expired') then 'expired' else 'opened' end
when 'call_voice' then 'call_voice: ' || seconds || ' s between ' || a || ' and ' || b when 'call_video' then 'call_video: ' || seconds || ' s between ' || a || ' and ' || b when 'add_contact' then 'add_contact: @' || b
when 'location' then 'location: ' || place else substr(content, 1, 200) end as normalized from k""",
)
def behavior_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 8
    content = (
        F.when(k == 0, F.concat(F.lit("Transfer "), i, F.lit(".50 received")))
        .when(k == 1, F.concat(F.lit("hongbao "), i, F.lit(" expired")))
        .when(k == 2, F.concat(F.lit("Voice Call "), (F.col("event_id") % 100).cast("string"), F.lit(" 秒")))
        .when(k == 3, "shipin")
        .when(k == 4, "please ADD FRIEND")
        .when(k == 5, "location north gate")
        .when(k == 6, "transfer returned")
        .otherwise(F.concat(F.lit("hello "), "event_type"))
    )
    b = S.behavior(content, F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", b.alias("b")).select("event_id", "b.type", "b.normalized")


_DRUG_TEXT = "(select conv_id, turn, text || case when turn % 3 = 0 then ' took Aspirin and METFORMIN 500 mg' when turn % 3 = 1 then ' sertraline' else '' end as text from conversations)"


@query(
    "drug_dictionary",
    f"""select conv_id, turn, array_to_string(list_transform(list_filter([{", ".join(repr(d) for d in S.DRUGS)}], lambda d: contains(lower(text), d)), lambda d: upper(d[1]) || d[2:]), ',') as drugs,
case when regexp_matches(lower(text), '([0-9]+)\\s*(?:mg|boxes?|pieces?|tablets?)') then regexp_extract(lower(text), '([0-9]+)\\s*(?:mg|boxes?|pieces?|tablets?)') else 'unknown' end as quantity
from {_DRUG_TEXT} where list_aggregate(list_transform([{", ".join(repr(d) for d in S.DRUGS)}], lambda d: contains(lower(text), d)), 'bool_or')""",
)
def drug_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " took Aspirin and METFORMIN 500 mg").when(F.col("turn") % 3 == 1, " sertraline").otherwise(""))
    rows = c.select("conv_id", "turn", S.drug_mentions(text).alias("m")).filter(F.size("m") > 0)
    return rows.select("conv_id", "turn", F.array_join("m.name", ",").alias("drugs"), F.col("m")[0]["quantity"].alias("quantity"))


@query(
    "person_tokens",
    """select conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\x0b\x1c-\x1f\x85]+'), lambda w: (length(w) > 1 and regexp_matches(w, '^\\p{Lu}') or regexp_full_match(w, '[\u4e00-\u9fa5]{2,4}')) and w not in ('CNY', 'USD', 'Transfer', 'Red', 'Envelope')), ' ') as persons from conversations""",
)
def person_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(S.person_tokens(F.col("text")), " ").alias("persons"))


@query("json_salvage", "select event_id, case when event_id % 6 <> 0 then props end as found from events")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.when(F.col("event_id") % 6 == 0, "no object here").otherwise(F.concat(F.lit("Answer:\n"), "props", F.lit("\nthat is all")))
    return table(spark, sf_dir, "events").select("event_id", S.salvaged_json(wrapped).alias("found"))


def _pads(salt: str) -> tuple[str, str]:
    key = salt.encode().ljust(64, b"\0")
    return tuple(bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))


_INNER, _OUTER = _pads(SALT)


@query("hmac_tag", f"select c_custkey, 'NAME_' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))), 1, 10) as tag from customer")
def hmac_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.keyed_tag(F.upper(F.lit("name")), F.col("c_name"), SALT).alias("tag"))


_COUNTED = {k: pseudonymize.PATTERNS[k] for k in ("phone", "id_card", "email", "url", "wechat", "long_number")}


@query("pii_counts", "select doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::bigint as n_{k}" for k, p in _COUNTED.items()) + " from documents")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSE-1: matches of single patterns over whole texts; digits, words and their ends are ASCII's, in Spark's patterns as in SQL's."""
    words = lambda p: p.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[F.regexp_count("text", F.lit(words(p).replace(r"[^\s]", r"[^\t\n\f\r ]"))).cast("long").alias(f"n_{k}") for k, p in _COUNTED.items()])


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "conversations"), F.col("turn") % 4
    more = (
        F.when(k == 0, F.concat(F.lit(" 王小明 13800138"), F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0")))
        .when(k == 1, F.lit(" https://example.org/a?b=ann@example.org 订单 12345678901234"))
        .when(k == 2, F.lit(" 北京市朝阳区建国路8号 ann@example.org"))
        .otherwise(" 110101199003074578")
    )
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat("text", more).alias("content"))


@query("pseudonymize_text")
def pseudonymize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize.pseudonymized(_coded(spark, sf_dir), SALT, seq="seq").select("seq", "content", F.size("spans").alias("n_spans"), "nested")


@query("pseudonym_mapping")
def pseudonym_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize.mapping(pseudonymize.pseudonymized(_coded(spark, sf_dir), SALT), SALT, "seq")


@query(
    "provider_text_results",
    f"""select conv_id * 1000 + turn as seq, array_to_string(drugs, ',') as drugs, true as validated, round(0.8 + case when len(drugs) > 0 then 0.2 else 0.0 end, 6)::double as confidence, null::varchar as error
from (select *, list_filter([{", ".join(repr(d) for d in S.DRUGS)}], lambda d: contains(lower(text || case when turn % 3 = 0 then ' took Aspirin' else '' end), d)) as drugs from conversations)""",
)
def provider_text_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, " took Aspirin").otherwise(""))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.regexp_replace(text, "\n", " ").alias("text"))
    out = providers.text_results(rows, "seq", "text")
    return out.select("seq", F.array_join("drugs", ",").alias("drugs"), "validated", "confidence", "error")


@query(
    "retryable_errors",
    """select event_id, regexp_matches(lower(m), 'timeout|connection|network|socket|rate limit|429|500|502|503|504') as retryable from (select event_id, event_type || ' ' || event_id || case when event_id % 7 = 0 then ' Timeout' else '' end as m from events)""",
)
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, " Timeout").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", S.retryable(m).alias("retryable"))


_BANDS = "case when n = 0 then {0} when n < 10 then {1} when n < 50 then {2} else {3} end"


@query(
    "voice_quality",
    f"select conv_id, turn, ({_BANDS.format(0.0, 0.3, 0.6, 0.8)})::double as quality_score, {_BANDS.format(repr('invalid'), repr('poor'), repr('fair'), repr('good'))} as completeness, case when n >= 10 then 'medium' else 'low' end as value_level, case when n < 50 then 'manual review' else 'usable' end as recommendation from (select conv_id, turn, length(text) as n from conversations)",
)
def voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.voice_quality(F.col("text")).alias("q")).select("conv_id", "turn", "q.*")


_IMAGE = "(select page_id, (page_id % 11) / 10.0::double as a, least((page_id % 150) / 100.0::double, 1.0) as b, least((page_id % 8) / 5.0::double, 1.0) as c from pages)"


@query(
    "image_quality",
    f"""select page_id, round(least(s * r, 1.0), 6) as quality_score, round(r, 6) as reliability, round(s * r, 9) >= 0.6 as usable from (
select page_id, s, 1 - least(((a - s) * (a - s) + (b - s) * (b - s) + (c - s) * (c - s)) / 3, 0.3) as r from (select *, 0.5 * a + 0.3 * b + 0.2 * c as s from {_IMAGE}))""",
)
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    q = S.image_quality((i % 11) / 10.0, i % 150, i % 8)
    return table(spark, sf_dir, "pages").select("page_id", q.alias("q")).select("page_id", F.round("q.quality_score", 6).alias("quality_score"), F.round("q.reliability", 6).alias("reliability"), "q.usable")


_SEEN = "(select event_id, lower(case event_id % 3 when 0 then 'a Drug_Box, no drug_list' when 1 then 'DRUG_LIST of a page' else 'a cat' end) as reply, event_id % 4 = 0 as failed from events)"


@query(
    "image_categories",
    f"select event_id, case when contains(reply, 'drug_box') then 'drug_box' when contains(reply, 'drug_list') then 'drug_list' else 'other' end as category, case when not failed and contains(reply, 'drug') then 'drug_related' else 'normal' end as related, (case when failed then 0.0 else 0.7 end)::double as confidence from {_SEEN}",
)
def image_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25, FN-26."""
    k = F.col("event_id") % 3
    reply = F.when(k == 0, "a Drug_Box, no drug_list").when(k == 1, "DRUG_LIST of a page").otherwise("a cat")
    r = S.drug_related(reply, F.col("event_id") % 4 == 0)
    return table(spark, sf_dir, "events").select("event_id", S.image_category(reply).alias("category"), r["category"].alias("related"), r["confidence"].alias("confidence"))


@query(
    "text_confidence",
    "select event_id, round(least(1.0, 0.5 + case when event_id % 2 = 0 then 0.2 else 0 end + case when event_id % 3 = 0 then 0.1 else 0 end + case when event_id % 5 = 0 then 0.2 else 0 end), 6)::double as confidence from events",
)
def text_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.text_confidence(i % 2 == 0, i % 3 == 0, i % 5 == 0), 6).alias("confidence"))


_FIELDS = "(select event_id, case event_id % 4 when 0 then {0} when 1 then {1} when 2 then {2} else {3} end as fields from {4})"
_LISTS = _FIELDS.format("[event_type, '', 'x']", "[event_type]", "['', '']", "[]::varchar[]", "events")


@query(
    "extraction_quality",
    f"""select event_id, round(case when len(fields) < 1 then 0.0 else least(1.0, 0.5 + 0.2 + case when len(fields) >= 3 then 0.1 else 0.0 end + 0.05 * len(list_filter(fields, lambda x: x <> ''))) end, 6)::double as quality from {_LISTS}""",
)
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.expr("case event_id % 4 when 0 then map('a', event_type, 'b', '', 'c', 'x') when 1 then map('a', event_type) when 2 then map('a', '', 'b', '') else cast(map() as map<string,string>) end")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.extraction_quality(fields), 6).alias("quality"))
