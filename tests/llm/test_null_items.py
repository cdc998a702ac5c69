"""Items without an id are cut out too."""

from __future__ import annotations

from evidencegraph.llm import decontaminate


def test_items_without_an_id_are_cut(spark):
    item, short = "one two three four five six seven eight nine ten eleven", "only words"
    docs = spark.createDataFrame([(1, f"clean words stand here before it yes they do and more so {item} and clean ones after as well quite many"), (2, item), (3, "a b c only words d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, short), (7, short)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(got) == {1, 3} and "three" not in got[1] and "only" not in got[3]
    assert {r.doc_id: r._items for r in decontaminate.matches(docs, items).collect()} == {1: [], 2: [], 3: ["7"]}
