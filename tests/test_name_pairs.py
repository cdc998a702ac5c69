"""Measures of all pairs of names, block by block, against the column functions and plain Python."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from evidencegraph import catalog
from evidencegraph.functions import likeness
from evidencegraph.functions.similarity import alignment, composite, edit_ratio, jaccard
from evidencegraph.operators import name_pairs


def made(r: random.Random, most: int, letters: str) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(1, most)))


def test_matching_blocks_are_difflib_s():
    r = random.Random(5)
    for most, letters in ((12, "ab"), (31, "abcd"), (63, "abc王é")):
        a, b = ([made(r, most, letters) for _ in range(40)] for _ in range(2))
        got = likeness.matched(likeness.coded(a, b))
        assert got.tolist() == [[sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for y in b] for x in a]


def test_measures_equal_the_columns(spark, monkeypatch):
    """Names that the matrices don't take are among them, and groups are of several chunks."""
    monkeypatch.setattr(name_pairs, "LEFT", 3)
    monkeypatch.setattr(name_pairs, "RIGHT", 5)
    r = random.Random(6)
    odd = [None, "", "x" * 64, "ab\U0001f600c", "a", "王小明", "ab c"]
    left = [(i, i % 2 if i != 4 else None, (odd + [made(r, 8, "abc") for _ in range(13)])[i]) for i in range(20)]
    right = [(i, i % 2, (odd + [made(r, 8, "abc") for _ in range(14)])[i]) for i in range(21)]
    s, c = spark.createDataFrame(left, "s long, n int, a string"), spark.createDataFrame(right, "c long, n int, b string")
    a, b = F.col("a"), F.col("b")
    rows = s.join(c, "n")
    for measure, of in {"jaccard": jaccard, "edit_ratio": edit_ratio, "composite": composite}.items():
        got = name_pairs.measured(s, c, "n", "a", "b", measure)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, rows.select("s", "c", F.round(of(a, b), 6)).collect())))


def test_alignment_of_pairs(spark, tmp_path):
    s = spark.createDataFrame([(i, x, 0) for i, x in enumerate(["Acme", "", None, "Acme Corp", " ann lee "])], "s_suppkey long, s_name string, s_nationkey int")
    c = spark.createDataFrame([(i, x, 0) for i, x in enumerate(["acme", "acme", "", "ann lea", "ann lea", None, "bmce", "\U0001f600"])], "c_custkey long, c_name string, c_nationkey int")
    s.write.parquet(f"{tmp_path}/supplier.parquet")
    c.write.parquet(f"{tmp_path}/customer.parquet")
    source = F.when(F.col("c_custkey") % 2 == 0, "voice").otherwise("text")
    m = alignment(F.lit("org"), F.lower("s_name"), F.lit(0.6), F.lit("text"), F.lit("org"), F.lower("c_name"), F.lit(0.8), source)
    want = s.crossJoin(c).withColumn("m", m).select("s_suppkey", "c_custkey", "m.level", F.round("m.score", 6))
    got = catalog.queries()["align_similarity"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and len({x.level for x in got}) == 4


def test_pairs_are_made_block_by_block(spark):
    """No pair of names is a row before it has its measure."""
    for name in ("name_jaccard", "name_edit_ratio", "name_composite", "align_similarity"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "collect_list" in plan


def test_rounding_is_catalyst_s(spark):
    import numpy as np

    x = np.array([i / n for n in (3, 64, 128, 256, 640, 2000000) for i in range(1, n, max(1, n // 40))])
    want = [row[0] for row in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert likeness.rounded(x).tolist() == want
