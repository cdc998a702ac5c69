"""Likeness of names: set and edit measures in Catalyst, the matching-block ratio in an Arrow UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The least composite score of one name, and the least matching-block ratio of a match across modalities.
SAME_NAME, SIMILAR_NAME = 0.85, 0.75


def edit_ratio(a: Column, b: Column) -> Column:
    """FN-7: 1 less the edits by the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """FN-12: of the sets of characters."""
    x, y = F.split(a, ""), F.split(b, "")
    union = F.size(F.array_union(x, y))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """FN-11: the matching-block ratio; the order of both counts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def composite(a: Column, b: Column) -> Column:
    """FN-13: of a new name against an older one."""
    return 0.5 * block_ratio(a, b) + 0.3 * edit_ratio(a, b) + 0.2 * jaccard(a, b)


def alignment(type_a: Column, name_a: Column, conf_a: Column, source_a: Column, type_b: Column, name_b: Column, conf_b: Column, source_b: Column) -> Column:
    """FN-14: struct score, level of two mentions."""
    a, b = aligned_name(name_a), aligned_name(name_b)
    apart = ~type_a.eqNullSafe(type_b) | (a == "") | (b == "")
    return alignment_of(apart, a == b, F.contains(a, b) | F.contains(b, a), edit_ratio(a, b), conf_a, source_a, conf_b, source_b)


def aligned_name(name: Column) -> Column:
    return F.trim(F.lower(F.coalesce(name, F.lit(""))))


def alignment_of(apart: Column, same: Column, within: Column, near: Column, conf_a: Column, source_a: Column, conf_b: Column, source_b: Column) -> Column:
    """`alignment` of two mentions that are `apart` by type or without a name, or whose names are the same, one within the other, or near by edits."""
    mean = (F.coalesce(conf_a, F.lit(0.5)) + F.coalesce(conf_b, F.lit(0.5))) / 2
    made = lambda score, level: F.struct(score.cast("double").alias("score"), F.lit(level).alias("level"))
    none = made(F.lit(0.0), "none")
    return (
        F.when(apart, none)
        .when(same, made(mean, "deterministic"))
        .when(within, made(0.8 * mean, "semantic"))
        .when((F.coalesce(source_a, F.lit("text")) != F.coalesce(source_b, F.lit("text"))) & (near > 0.6), made(near * mean * 0.7, "cross-modal"))
        .otherwise(none)
    )
