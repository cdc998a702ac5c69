"""Names of a high composite score are found by marked segments."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evidencegraph.operators import resolve


def edited(r: random.Random, name: str, edits: int) -> str:
    x = list(name)
    for _ in range(edits):
        i, how = r.randrange(len(x) + 1), r.random()
        if how < 0.35 or i == len(x):
            x.insert(i, r.choice("abcdefghijklmnop王"))
        elif how < 0.7 and len(x) > 1:
            x.pop(i)
        else:
            x[i] = r.choice("abcdefghijklmnop")
    return "".join(x)


def test_no_pair_of_the_score_is_lost(spark):
    r = random.Random(11)
    bases = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 40))) for _ in range(25)]
    names = sorted({n for b in bases for n in (b, *(edited(r, b, r.randint(1, 9)) for _ in range(5)))})
    df = spark.createDataFrame([(n,) for n in names], "n_name string")
    got = {(x.a, x.b) for x in resolve.same_names(df, df).collect()}
    assert got == {(a, b) for a in names for b in names if a != b and resolve._composite(a, b) >= resolve.SAME_NAME}
    assert len(got) > 100


def test_keys_are_worked_out_once(spark):
    """The tables that blocks are made of hold the normalised keys, which each of their many uses worked out again before."""
    rows = spark.range(30).select(F.col("id").alias("seq"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), F.lit("s").alias("source"), F.lit(0.5).alias("confidence"))
    plan = resolve.blocks(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "levenshtein" not in plan
