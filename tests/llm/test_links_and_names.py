"""Large buckets are dealt out whole; columns of any name are carried along."""

from __future__ import annotations

import random

import pytest

from evidencegraph.llm import copies, decontaminate, linededup, links, pii, simhash, suffixdedup, toxicity


@pytest.mark.parametrize("block", [2048, 16, 5])
def test_buckets_of_any_size(spark, block, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", block)
    r = random.Random(block)
    base = [r.getrandbits(64) for _ in range(6)]
    rows = [(k % 2, i, (base[k] ^ (1 << r.randrange(64))).to_bytes(8, "big")) for i, k in enumerate(r.choices(range(6), k=60))] + [(7, 100, bytes(8))]
    df = spark.createDataFrame(rows, "key long, id long, code binary")
    got = {x.node: x.root for x in links.components(links.bucketed(df, links.Near(3, 5), "test", 8)).collect()}
    root = {i: i for _, i, _ in rows}
    for k, i, c in rows:
        for m, j, d in rows:
            near = (int.from_bytes(c, "big") ^ int.from_bytes(d, "big")).bit_count() <= 3 and sum(x == y for x, y in zip(c, d, strict=True)) >= 5
            if k == m and near and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {n: a if x == b else x for n, x in root.items()}
    assert {i: got.get(i, i) for i in root} == root


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    got = {x.node: x.root for x in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(50)}, **{100 + i: 100 for i in range(41)}}


NAMES = ["_id", "_hash", "_score", "_items", "_spans", "_n_words", "_text", "_h1", "_h2", "_doc", "_drop", "_base", "_added", "_part", "_ID", "id", "alt", "drop", "key", "fp", "root", "h1", "template"]


@pytest.mark.parametrize("name", ["toxicity", "simhash", "copies", "decontaminate", "linededup", "suffixdedup", "pii"])
def test_columns_of_any_name_stay(spark, name):
    names = [n for n in NAMES if n != "_ID"]
    texts = ["one two three four five six seven eight nine ten eleven", "ann@b.com is here", None, "", "one two three four five six seven eight nine ten twelve"]
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "nothing of this")], "item_id long, text string")
    run = {
        "toxicity": lambda: toxicity.reject_toxic(docs, labels, 1.1), "simhash": lambda: simhash.keep_one(docs), "copies": lambda: copies.keep_one(docs), "decontaminate": lambda: decontaminate.decontaminate(docs, items),
        "linededup": lambda: linededup.dedup_lines(docs), "suffixdedup": lambda: suffixdedup.dedup(docs), "pii": lambda: pii.redact(docs),
    }
    out = run[name]()
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) >= 4 and all(r[n] == f"{n} {r.doc_id}" for r in got for n in names)
