"""GEN-2, MSC-10: all evaluators over annotated tables, as one table of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import confusion, error_rates, macro_f1, role_scores


def long(metrics: DataFrame, name: str) -> DataFrame:
    """The columns of one row as evaluation, metric, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns])
    return metrics.select(F.explode(pairs).alias("m")).select(F.lit(name).alias("evaluation"), "m.*")


def evaluated(asr: DataFrame, roles: DataFrame, all_roles: DataFrame, relations: DataFrame, images: DataFrame) -> DataFrame:
    """evaluation, metric, value: `asr` has reference, hypothesis; `roles` true_role, predicted_role; `relations` and `images` two booleans, truth and predicted."""
    scores = role_scores(roles, all_roles)
    out = long(error_rates(asr), "asr").unionByName(long(macro_f1(scores), "roles"))
    accuracy = images.agg(F.round(F.avg((F.col("truth") == F.col("predicted")).cast("double")), 6).alias("accuracy"))
    return out.unionByName(long(confusion(relations, "truth", "predicted"), "relations")).unionByName(long(accuracy, "images"))
