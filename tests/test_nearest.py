"""Nearest vectors, block by block, against all rows."""

from __future__ import annotations

import math
import random

from evidencegraph.operators import context


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in (*a, *b):
        return None
    s, p, q = 0.0, 0.0, 0.0
    for x, y in zip(a, b, strict=True):
        s, p, q = s + x * y, p + x * x, q + y * y
    return s / (math.sqrt(p) * math.sqrt(q))


def test_blocks_of_odd_vectors_and_ties(spark, monkeypatch):
    for name, size in (("QUERIES", 7), ("ROWS", 11), ("SCORES", 40)):
        monkeypatch.setattr(context, name, size)
    r = random.Random(8)
    rows = [(i, [float(r.randint(1, 3)) for _ in range(4)]) for i in range(70)]
    rows[10], rows[11], rows[12] = (10, None), (11, [1.0, 2.0]), (12, [1.0, None, 1.0, 1.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in context.nearest(df.filter("vec_id % 5 = 0"), df, 6).collect()}
    want = {}
    for q, a in rows[::5]:
        all_ = sorted(((s is None, -(s or 0.0), i, s) for i, b in rows if i != q for s in [cosine(a, b)]), key=lambda t: t[:3])
        want |= {(q, k + 1): (t[2], t[3]) for k, t in enumerate(all_[:6])}
    assert got == want


def test_vectors_meet_as_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    assert "MapInArrow" in context.nearest(df, df)._jdf.queryExecution().optimizedPlan().toString()
