"""Communities of many components."""

from __future__ import annotations

import random

from evidencegraph.operators import graph


def test_components_in_a_row_stay_apart(spark):
    """Frames end inside components; the groups don't."""
    r = random.Random(9)
    edges = [(10 * g + a, 10 * g + b, 1.0) for g in range(40) for a in range(7) for b in range(a) if r.random() < 0.5 or b == a - 1]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        found = graph.communities(spark.createDataFrame(edges, "source long, target long, weight double"))
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {x.node: x.community for x in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    back = {}
    for g in range(40):
        back |= graph.louvain(sorted(e for e in edges if e[0] // 10 == g))
    assert got == back
