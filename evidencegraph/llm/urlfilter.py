"""URL rules by a sort-merge range join over reversed hosts, in DataFrame functions only.

A host turns into its labels in reverse, each followed by a dot; all that a rule's host covers then lies in one
interval of these keys, and intervals of different rules are nested or apart. Boundaries and pages are sorted
into ranges together. Sweeping a range, each boundary sets the stack of rules that are active from there on;
a range starts with the stack that the ranges before it left. Of the stack's rules whose path the url's path
starts with, the longest decides. The longest host and path wins; of two rules for one host and path, block.

Defined results: a null url or one without `://` has an empty host and path and fits no rule; a host with empty
labels only fits a rule for such a host; rows of equal page_id are judged one by one; a null page_id is kept; no
rules or an empty table give the default or nothing; urls may be of any length; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _AZ, _AZ.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, "\\."))), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: the rules that are active from `key` on. `rules` has host, path, verdict."""
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.col("verdict").alias("verdict"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"))
    hosts = rules.filter("host is not null and path is not null and verdict is not null").groupBy("host").agg(F.collect_set(rule).alias("own"))
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    chain = hosts.select("host", F.explode(above).alias("up")).join(hosts.select(F.col("host").alias("up"), "own"), "up")
    chain = chain.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("host"), F.col("own")))).alias("below"))
    low = key_of(F.col("host"))
    high = F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit("/"))  # the character after the dot
    found = chain.withColumn("k", low)
    return found.select(F.col("k").alias("key"), "stack").unionByName(found.select(high.alias("key"), F.col("below").alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """`key`, host, path, rule (or null), verdict of every row."""
    spark = pages.sparkSession
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", key_of(F.col("host")))
    marks = boundaries(rules)
    none = F.lit(None)
    both = marks.select("key", F.lit(0).alias("kind"), "stack", none.cast(rows.schema["page_id"].dataType).alias("page_id"), none.cast("string").alias("host"), none.cast("string").alias("path"))
    both = both.unionByName(rows.select("key", F.lit(1).alias("kind"), none.cast(marks.schema["stack"].dataType).alias("stack"), "page_id", "host", "path"))
    # page_id is part of the range, so that one host's pages may fill several ranges
    n = partitions(spark)
    ranges = table(both.repartitionByRange(n, "key", "kind", "page_id").withColumn("at", F.spark_partition_id()), "urls")
    left = ranges.filter("kind = 0").groupBy("at").agg(F.max_by("stack", "key").alias("left"))  # a row for each range
    found = ranges.select("at").distinct().join(left, "at", "left")
    before = F.last("left", ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(found.select("at", before.alias("before")))
    sweep = Window.partitionBy("at").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranges.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1").join(carried, "at", "left")
    active = F.coalesce("active", "before")
    best = F.array_max(F.filter(active, lambda r: F.startswith(F.col("path"), r["path"])))
    out = swept.withColumn("best", best)
    return out.select(F.col("page_id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])).alias("r")).select("r.*")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


SQL = f"""
with rests as (
  select page_id, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_AZ}', '{_AZ.lower()}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests
), rules(h, p, v) as (values {", ".join(str(r) for r in RULES)})
select page_id, host, path,
       (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
       coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from parts
"""
