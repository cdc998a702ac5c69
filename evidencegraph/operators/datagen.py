"""GEN-1: synthetic annotations of any size, each row from its number and a seed, so that partitions need no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import error_rate

USERS, RELATIONS, MESSAGES, SAMPLES, IMAGES, SEED = 300, 5000, 30000, 100, 433, 42
#: Shares of the roles, and how often each speaks of drugs.
ROLES = (("prescriber", 0.15, 0.40), ("recipient", 0.25, 0.30), ("benign_user", 0.60, 0.02))


def draw(seed: int, *of: Column) -> Column:
    """A number of [0, 1) that depends on its arguments only."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) / float(1 << 30)


def _user(n: Column) -> Column:
    return F.format_string("user_%04d", n)


def users(spark: SparkSession, n: int = USERS) -> DataFrame:
    edge = ROLES[0][1], ROLES[0][1] + ROLES[1][1]
    place = F.col("id") / n
    role = F.when(place < edge[0], ROLES[0][0]).when(place < edge[1], ROLES[1][0]).otherwise(ROLES[2][0])
    return spark.range(n).select(_user(F.col("id")).alias("user"), role.alias("role"))


def relations(spark: SparkSession, n: int = RELATIONS, n_users: int = USERS, seed: int = SEED) -> DataFrame:
    """Pairs of users, 30 of 100 related; a user is never paired with itself."""
    pick = lambda k: F.floor(draw(seed + k, F.col("id")) * n_users)
    rows = spark.range(n).select("id", pick(1).alias("a"), pick(2).alias("b")).filter("a <> b")
    related = draw(seed + 3, F.col("id")) < 0.3
    count = F.when(related, 5 + F.floor(draw(seed + 4, F.col("id")) * 46)).otherwise(F.floor(draw(seed + 4, F.col("id")) * 5))
    return rows.select("id", _user(F.col("a")).alias("user1"), _user(F.col("b")).alias("user2"), related.alias("is_related"), count.alias("interaction_count"))


def messages(spark: SparkSession, n: int = MESSAGES, n_users: int = USERS, seed: int = SEED) -> DataFrame:
    rows = spark.range(n).select("id", F.floor(draw(seed + 5, F.col("id")) * n_users).alias("u"))
    place = F.col("u") / n_users
    chance = F.when(place < 0.15, ROLES[0][2]).when(place < 0.4, ROLES[1][2]).otherwise(ROLES[2][2])
    mention = draw(seed + 6, F.col("id")) < chance
    text = F.when(mention, F.concat(F.lit("message about a drug no. "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("message no. "), F.col("id").cast("string")))
    return rows.select("id", _user(F.col("u")).alias("user"), text.alias("text"), mention.alias("has_drug_mention"), (F.lit(1_600_000_000) + F.col("id") * 60).alias("timestamp"))


def asr_pairs(spark: SparkSession, n: int = SAMPLES, seed: int = SEED, noise: float = 0.15) -> DataFrame:
    """References, and hypotheses of which a share of the characters is replaced."""
    reference = F.concat(F.lit("spoken sample number "), F.col("id").cast("string"))
    heard = F.array_join(F.transform(F.split("reference", ""), lambda c, i: F.when(draw(seed + 7, F.col("id"), i) < noise, F.lit("#")).otherwise(c)), "")
    return spark.range(n).withColumn("reference", reference).withColumn("hypothesis", heard).withColumn("cer", error_rate(F.col("reference"), F.col("hypothesis")))


def images(spark: SparkSession, n: int = IMAGES, seed: int = SEED) -> DataFrame:
    x = draw(seed + 8, F.col("id"))
    kind = F.when(x < 0.6, "drug_box").when(x < 0.8, "drug_list").otherwise("other")
    return spark.range(n).select("id", F.format_string("image_%05d.jpg", F.col("id")).alias("filename"), kind.alias("type"), (kind != "other").alias("contains_drugs"))
