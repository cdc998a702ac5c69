"""Scores of extraction: error rates, confusion counts, votes, ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import error_rate, f1_scores, word_error_rate


def error_rates(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """AGG-14: mean, extremes and sample deviation (0 of one row) of character and word error rates, rounded to 4 digits."""
    rows = pairs.select(error_rate(F.col(reference), F.col(hypothesis)).alias("cer"), word_error_rate(F.col(reference), F.col(hypothesis)).alias("wer"))
    out = [F.count("*").alias("samples")]
    for m in ("cer", "wer"):
        out += [F.round(f(m), 4).alias(f"{n}_{m}") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
        out.append(F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 4).alias(f"std_{m}"))
    return rows.agg(*out)


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """AGG-16, AGG-17: tp, fp, fn, tn, precision, recall, f1 of two booleans; with `by`, of each group and in all (null)."""
    t, p = F.col(truth), F.col(predicted)
    counts = [F.count_if(x).alias(n) for n, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))]
    grouped = rows.rollup(*by).agg(*counts) if by else rows.agg(*counts)
    return grouped.withColumns(f1_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def role_scores(rows: DataFrame, roles: DataFrame, truth: str = "true_role", predicted: str = "predicted_role") -> DataFrame:
    """AGG-15: one against the rest for each of `roles` (role), zeros for a role that never comes.

    Each row counts for its true and its predicted role, so that no row meets all roles.
    """
    t, p = F.col(truth), F.col(predicted)
    hit = F.when(t == p, F.array(F.struct(t.alias("role"), F.lit("tp").alias("as")))).otherwise(F.array(F.struct(t.alias("role"), F.lit("fn").alias("as")), F.struct(p.alias("role"), F.lit("fp").alias("as"))))
    each = rows.select(F.explode(hit).alias("h")).groupBy("h.role").agg(*[F.count_if(F.col("h.as") == x).alias(x) for x in ("tp", "fp", "fn")])
    zero = [F.coalesce(F.col(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")]
    return roles.join(each, "role", "left").select("role", *zero).withColumns(f1_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(scores: DataFrame, digits: int = 4) -> DataFrame:
    """AGG-15: the mean of rounded f1, added as decimals: in doubles a tie would be rounded by the order of rows."""
    mean = F.avg(F.col("f1").cast("decimal(20,18)"))
    return scores.agg(F.round(mean, digits).cast("double").alias("macro_f1"))


def majority(votes: DataFrame, item: str, label: str, order: str) -> DataFrame:
    """AGG-6, AGG-7: the label of most votes, the first seen (by `order`) at ties, and its share."""
    counts = votes.groupBy(item, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(item).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias("label"), F.round(F.max("n") / F.sum("n"), 6).alias("confidence"))


def ensemble(results: DataFrame, item: str, value: str, weight: str, order: str) -> DataFrame:
    """AGG-8: the value of the greatest weight, the first one (by `order`) at ties, and how many answered."""
    return results.groupBy(item).agg(F.max_by(value, F.struct(weight, -F.col(order))).alias("picked"), F.count(value).alias("answers"))
