"""Messages, mentions and edges made of the driver's tables, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import tasks_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages, every eleventh without text, every thirteenth without an id, every seventeenth without a time."""
    t = table(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return t.select(
        seq.alias("index"),
        F.when(seq % 11 != 0, F.col("text")).when(seq % 2 == 0, F.lit("  ")).alias("content"),
        F.when(seq % 13 != 0, F.concat(F.lit("m"), seq.cast("string"))).alias("uuid"),
        F.when(seq % 17 != 0, F.lit("number")).alias("time_kind"),
        F.col("role").alias("sender"),
        F.col("text"),
    )


MESSAGES = """
select conv_id * 1000 + turn as index,
       case when (conv_id * 1000 + turn) % 11 <> 0 then text when (conv_id * 1000 + turn) % 2 = 0 then '  ' end as content,
       case when (conv_id * 1000 + turn) % 13 <> 0 then 'm' || (conv_id * 1000 + turn) end as uuid,
       case when (conv_id * 1000 + turn) % 17 <> 0 then 'number' end as time_kind,
       role as sender, text
from conversations
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in orders as entities in messages."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    n = tasks_of(rows, parts)
    rows, parts = rows.repartition(n, "l_partkey"), parts.repartition(n, "p_partkey")
    return rows.join(parts, rows.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("uuid"),
        F.col("l_partkey").alias("entity"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("type"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_returnflag").alias("source"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


MENTIONS = """
select l_orderkey as uuid, l_partkey as entity, p_name as name, p_brand as type, 1 - l_discount as confidence,
       l_returnflag as source, l_orderkey * 100 + l_linenumber as seq
from lineitem join part on l_partkey = p_partkey
"""


def edge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of one order as events of edges, in both directions; even orders are transfers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    n = tasks_of(o, li)
    o, li = o.repartition(n, "o_orderkey"), li.repartition(n, "l_orderkey")
    s, c = F.col("l_suppkey"), F.col("o_custkey") + 1_000_000
    odd = F.col("l_linenumber") % 2 == 1
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.when(odd, s).otherwise(c).alias("source"),
        F.when(odd, c).otherwise(s).alias("target"),
        F.when(F.col("o_orderkey") % 2 == 0, "transfer").otherwise("message").alias("relation"),
        F.lit(0.5).alias("weight"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("ts"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


EDGE_EVENTS = """
select case when l_linenumber % 2 = 1 then l_suppkey else o_custkey + 1000000 end as source,
       case when l_linenumber % 2 = 1 then o_custkey + 1000000 else l_suppkey end as target,
       case when o_orderkey % 2 = 0 then 'transfer' else 'message' end as relation, 0.5::double as weight,
       case when o_orderkey % 5 <> 0 then o_orderdate end as ts, l_orderkey * 100 + l_linenumber as seq
from orders join lineitem on o_orderkey = l_orderkey
"""


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose keys are 1 or 7 apart in the same nation: a graph of several components."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    a = c.select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("n"), F.explode(F.array(F.col("c_custkey") + 1, F.col("c_custkey") + 7)).alias("target"))
    b = c.select(F.col("c_custkey").alias("target"), F.col("c_nationkey").alias("n"))
    return a.join(b, ["target", "n"]).select("source", "target", F.lit(1.0).alias("weight"))


SPARSE_EDGES = """
select a.c_custkey as source, b.c_custkey as target, 1.0::double as weight
from customer a join customer b on a.c_nationkey = b.c_nationkey and b.c_custkey - a.c_custkey in (1, 7)
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as results of extraction: the quality label is the confidence, the id makes the modality."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "quality", "toxic")
    j = d.join(lab, d.doc_id == F.col("_d"), "left")
    i = F.col("doc_id")
    return j.select(
        i.alias("seq"),
        F.when(i % 19 != 0, F.concat(F.lit("u"), i.cast("string"))).alias("uuid"),
        F.when(F.col("quality").isNotNull(), 0.4 + F.col("quality") * 0.5).alias("confidence"),
        F.when(i % 23 == 0, "timeout").alias("error"),
        F.when(i % 3 == 0, "text").when(i % 3 == 1, "voice").otherwise("image").alias("modality"),
        (i % 2 == 0).alias("has_drugs"),
        (i % 5 != 0).alias("has_entities"),
        (i % 4 == 0).alias("entity_drugs"),
        (i % 7 != 0).alias("has_transcription"),
        (i % 3 == 1).alias("has_quality"),
        F.when(i % 2 == 0, 0.9).otherwise(0.5).alias("voice_score"),
        F.when(i % 5 == 0, "short").otherwise("a transcript that is long").alias("transcript"),
        F.lit(True).alias("has_classification"),
        (i % 5 != 2).alias("has_details"),
        F.when(i % 4 == 1, "transaction").otherwise("photo").alias("category"),
        F.when(i % 8 == 1, "").otherwise("words").alias("ocr_text"),
    )


REPORTS = """
select doc_id as seq, case when doc_id % 19 <> 0 then 'u' || doc_id end as uuid,
       case when quality is not null then 0.4::double + quality * 0.5::double end as confidence,
       case when doc_id % 23 = 0 then 'timeout' end as error,
       case doc_id % 3 when 0 then 'text' when 1 then 'voice' else 'image' end as modality,
       doc_id % 2 = 0 as has_drugs, doc_id % 5 <> 0 as has_entities, doc_id % 4 = 0 as entity_drugs,
       doc_id % 7 <> 0 as has_transcription, doc_id % 3 = 1 as has_quality,
       case when doc_id % 2 = 0 then 0.9::double else 0.5::double end as voice_score,
       case when doc_id % 5 = 0 then 'short' else 'a transcript that is long' end as transcript,
       true as has_classification, doc_id % 5 <> 2 as has_details,
       case when doc_id % 4 = 1 then 'transaction' else 'photo' end as category,
       case when doc_id % 8 = 1 then '' else 'words' end as ocr_text
from documents left join labels using (doc_id)
"""
