"""Readers: chat JSON, CSV exports, folders of media, envelopes, annotations, device exports. All plan in Spark; paths may be any that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import TYPE_CODES, first_truthy, normalized_time, voice_duration
from ..operators.intake import reason

# Names of columns in exports, and endings of media.
HEADERS = {
    "uuid": ("UUID", "msgSvrId", "id"),
    "type": ("type", "msgType", "Type"),
    "content": ("content", "Content"),
    "sender": ("talker", "sender", "Sender"),
    "receiver": ("des", "receiver", "Receiver"),
    "timestamp": ("createTime", "timestamp", "Timestamp"),
}
VOICE_FILES, IMAGE_FILES = ("mp3", "wav", "m4a", "amr"), ("jpg", "jpeg", "png", "bmp")
IMAGE_ENTRY = "id string, type string, category string, context string, sender string, receiver string, timestamp string, path string, entities array<struct<name:string,type:string,quantity:string,price:string>>"
ENVELOPE = "struct<uuid:string,content:string,file_path:string,sender:string,receiver:string,timestamp:string>"


def chat_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1, FIL-1: a JSON array of messages: index, reason (or null), and fields as text. A root that is no array gives one row of index -1.

    Elements keep their JSON kinds until they are judged. A missing file raises, as in every reader of Spark.
    """
    root = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("root"))
    is_array = F.coalesce(F.schema_of_variant("root").startswith("ARRAY"), F.lit(False))
    good = root.filter(is_array)
    parts = good.select(F.variant_get("root", "$", "array<variant>").alias("xs")).select(F.posexplode("xs").alias("index", "v"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    is_text = lambda k: F.coalesce(kind(k) == "STRING", F.lit(False))
    time_kind = F.when(kind("timestamp") == "STRING", "string").when(kind("timestamp") == "BOOLEAN", "boolean").when(F.rlike(kind("timestamp"), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")), "number")
    keyed = parts.withColumn("keys", F.map_keys(F.coalesce(F.try_variant_get("v", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))))
    has = lambda k: F.array_contains("keys", k)
    why = reason(text("content"), is_text("content"), F.when(is_text("uuid"), text("uuid")), has("uuid"), F.when(is_text("id"), text("id")), time_kind, has_content=has("content"))
    fields = ["type", "content", "timestamp", "sender_id", "sender_name", "sender", "receiver", "channel"]
    rows = keyed.select(F.col("index").cast("long").alias("index"), why.alias("reason"), F.when(has("uuid"), text("uuid")).otherwise(text("id")).alias("uuid"), *[text(k).alias(k) for k in fields])
    none = [F.lit(None).cast("string").alias(k) for k in ["uuid", *fields]]
    return rows.unionByName(root.filter(~is_array).select(F.lit(-1).cast("long").alias("index"), F.lit("root not array").alias("reason"), *none))


def message_csv(spark: SparkSession, path: str, media: str | None = None) -> DataFrame:
    """SRC-2 to SRC-4: a CSV export with any of the known headers (and a byte order mark): text, voice and image entries.

    Rows without uuid or type, of other types, or whose medium isn't found, are left out.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])
    none = F.lit(None).cast("string")
    named = {k: first_truthy(*[F.col(f"`{a}`") for a in names if a in rows.columns]) if any(a in rows.columns for a in names) else none for k, names in HEADERS.items()}
    table = F.create_map(*[F.lit(x) for pair in TYPE_CODES.items() for x in pair])
    out = rows.select(*[c.alias(k) for k, c in named.items()]).filter("uuid is not null and type is not null")
    out = out.withColumns({"modality": F.coalesce(F.try_element_at(table, F.col("type")), F.lit("unknown")), "timestamp": normalized_time(F.col("timestamp"))})
    out = out.filter(F.col("modality").isin("text", "voice", "image")).withColumn("duration", F.when(F.col("modality") == "voice", voice_duration(F.coalesce("content", F.lit("")))))
    texts = out.filter("modality = 'text'").withColumn("file_path", none)
    if media is None:
        return texts
    return texts.unionByName(with_media(out.filter("modality <> 'text'"), media_files(spark, media)))


def media_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of a folder and all below it, without their bytes: path, name, stem, ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).withColumns({"ending": F.lower(F.substring_index("name", ".", -1)), "stem": F.regexp_replace("name", r"\.[^.]*$", "")})


def with_media(entries: DataFrame, files: DataFrame) -> DataFrame:
    """SRC-4: the first path (in order of names) whose name holds the entry's uuid, of the endings of its modality.

    A uuid meets a name on every run of its length in the name, so that containment is an equi-join.
    """
    clean = F.regexp_replace("uuid", "[^A-Za-z0-9_-]", "")
    wanted = entries.withColumn("_u", clean).filter("_u <> ''")
    sizes = wanted.select(F.length("_u").alias("size")).distinct()
    of = F.when(F.col("ending").isin(*VOICE_FILES), "voice").when(F.col("ending").isin(*IMAGE_FILES), "image")
    runs = files.withColumn("_m", of).filter("_m is not null").join(F.broadcast(sizes.filter("size <= 1024")), F.length("name") >= F.col("size"))  # distinct lengths of ids; no store has longer names
    runs = runs.select("_m", "path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - F.col("size") + 1), lambda i: F.substring(F.col("name"), i, F.col("size"))))).alias("_u"))
    first = runs.groupBy("_m", "_u").agg(F.min("path").alias("file_path"))
    return wanted.join(first, (wanted["_u"] == first["_u"]) & (wanted["modality"] == first["_m"])).drop("_u", "_m")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: texts with their content, voices and images with their paths, named by the stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.substring_index("path", ".", -1))
    modality = F.when(ending == "txt", "text").when(ending.isin(*VOICE_FILES), "voice").when(ending.isin(*IMAGE_FILES), "image")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    unknown = F.lit("unknown")
    return files.withColumn("modality", modality).filter("modality is not null").select(
        "modality", stem.alias("uuid"), F.when(F.col("modality") == "text", F.decode("content", "UTF-8")).alias("content"), F.when(F.col("modality") != "text", F.col("path")).alias("file_path"), unknown.alias("sender"), unknown.alias("receiver")
    )


def envelope(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: entries of an object of three lists."""
    lists = ", ".join(f"{m}_entries array<{ENVELOPE}>" for m in ("text", "voice", "image"))
    rows = spark.read.schema(lists).json(path, multiLine=True)
    parts = [rows.select(F.lit(m).alias("modality"), F.explode(f"{m}_entries").alias("e")).select("modality", "e.*") for m in ("text", "voice", "image")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def user_roles(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: a map of user to role, or a list of true_role and predicted_role, as rows."""
    raw = spark.read.text(path, wholetext=True)
    as_map = raw.filter(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("user", "true_role")).withColumn("predicted_role", F.lit(None).cast("string"))
    as_list = raw.filter(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", "array<struct<user:string,true_role:string,predicted_role:string>>")).alias("e")).select("e.*")
    return as_map.unionByName(as_list)


def user_relations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: pairs of users, whether they are related, and whether that was predicted."""
    return spark.read.schema("id long, user1 string, user2 string, is_related boolean, interaction_count long, predicted_related boolean").json(path, multiLine=True)


def annotated_messages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: messages with a note whether they name a drug."""
    return spark.read.schema("id long, user string, text string, has_drug_mention boolean, timestamp long").json(path, multiLine=True)


def case_annotations(spark: SparkSession, folder: str, case: str) -> dict[str, DataFrame]:
    """SRC-7: the three annotation files of a case."""
    of = {"user_roles": user_roles, "user_drug_relations": user_relations, "chat_messages": annotated_messages}
    return {name: read(spark, f"{folder}/{case}_{name}.json") for name, read in of.items()}


def asr_samples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: reference and hypothesis, under either of their names."""
    rows = spark.read.schema("id long, reference string, hypothesis string, reference_text string, hypothesis_text string").json(path, multiLine=True)
    return rows.select("id", F.coalesce("reference_text", "reference").alias("reference"), F.coalesce("hypothesis_text", "hypothesis").alias("hypothesis"))


def image_annotations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9."""
    rows = spark.read.schema("id long, filename string, type string, image_type string, contains_drugs boolean, predicted_contains_drugs boolean").json(path, multiLine=True)
    return rows.select("id", "filename", F.coalesce("image_type", "type").alias("image_type"), "contains_drugs", "predicted_contains_drugs")


def image_entries(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14."""
    return spark.read.schema(IMAGE_ENTRY).json(path, multiLine=True)


def device_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-13: an array that a script assigns to a name."""
    body = F.regexp_replace("value", r"(?s)^\s*;?[^=\[]+=", "")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(body, f"array<{schema}>")).alias("e")).select("e.*")


def navigation_tree(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: the tree of an export: id, name, table_index, parent (null at the top)."""
    rows = spark.read.schema("id string, name string, tableIndex int, parentId string").json(path, multiLine=True)
    return rows.select("id", "name", F.col("tableIndex").alias("table_index"), F.col("parentId").alias("parent"))


def collected(spark: SparkSession, csv: str | None = None, directory: str | None = None) -> DataFrame:
    """SRC-12: the CSV if there is one, else the folder, else nothing."""
    if csv:
        return message_csv(spark, csv, directory).select("modality", "uuid", "content", "file_path", "sender", "receiver")
    if directory:
        return folder(spark, directory)
    return spark.createDataFrame([], "modality string, uuid string, content string, file_path string, sender string, receiver string")


def stored_cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15."""
    return spark.read.parquet(path)
