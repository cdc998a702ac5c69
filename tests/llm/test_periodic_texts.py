"""Texts that repeat themselves without a break: the places of their cells are compared as hashes, in any order."""

from __future__ import annotations

import random

from evidencegraph.llm import suffixdedup


def test_periodic_texts_lose_all_that_is_repeated(spark):
    r = random.Random(31)
    docs = []
    for i in range(60):
        part = "".join(r.choice("abcdefgh ") for _ in range(r.randint(150, 300)))
        docs.append((i, (part * 8)[: r.randint(900, 1200)]))
    rows = suffixdedup.with_spans(spark.createDataFrame(docs, "doc_id long, text string"), text="_t", spans="_s").collect()
    got = {}
    for x in rows:
        gone = {k for a, b in x._s or () for k in range(max(a, 0), b)}
        got[x.doc_id] = len(gone & set(range(len(x._t))))
    assert got == {d: removed for d, _, removed, _, _ in suffixdedup.brute_force(docs)}
