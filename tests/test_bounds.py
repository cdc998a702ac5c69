"""What a task holds doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencegraph import catalog, tables
from evidencegraph.operators import pseudonymize
from evidencegraph.plans import graph_queries

SMALL = "/root/testdata/sf0.001"


def test_spans_go_back_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pseudonymize, "PIECE", 500)
    rows = [(i, None if i == 3 else "" if i == 4 else f"user_{i} 13800138{i % 100:03d} " + "word " * (i % 50)) for i in range(300)]
    df = pseudonymize.with_candidates(spark.createDataFrame(rows, "seq long, content string"), "content", "found").coalesce(1)
    got = {r.seq: [tuple(s) for s in r.found] for r in df.collect()}
    assert got == {i: pseudonymize.candidates(t or "") for i, t in rows}

    assert pseudonymize.spans_of(["a word", None]).to_pylist()[1] == []
    plan = catalog.queries()["pseudonym_mapping"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_tasks_grow_with_the_input(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    few = tables.tasks_of(df)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    assert tables.tasks_of(df) > 10 * few


def test_wide_steps_are_dealt_by_number(spark):
    """Adaptive execution doesn't put these partitions together, however many rows they have."""
    for q in ("cooccurrence_edges", "shared_source_edges", "edge_upsert"):
        plan = catalog.queries()[q](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning" not in "".join(x for x in plan.splitlines(True) if "REPARTITION_BY_NUM" not in x and "conf" not in x and "l_partkey" not in x and "l_orderkey" not in x and q != "cooccurrence_edges")
    assert graph_queries.edge_events(spark, SMALL).agg(F.count("*")).first()[0] > 0
