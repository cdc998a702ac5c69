"""The near-duplicate stage looks for copies by SimHash and its index of byte positions."""

from __future__ import annotations

import random

from evidencegraph.llm import copies, simhash


def test_fingerprints_link_near_copies_of_the_stage(spark):
    r = random.Random(8)
    docs = []
    for i in range(12):
        words = [f"{r.randrange(1 << 30):x}" for _ in range(400)]
        docs += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:-1], "x"])), (10 * i + 2, " ".join(words).upper())]
    docs += [(500, None), (501, ""), (502, "one two")]
    rows = copies.sets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    plain = simhash.simhashes([(t or "").encode() for _, t in sorted(docs)], copies.SHINGLE)
    assert [x.sim & (1 << 64) - 1 for x in sorted(rows, key=lambda x: x._id)] == plain.tolist()  # no shingle is repeated here
    fp = {x._id: x.fp for x in rows}
    sim = {x.fp: x.sim for x in rows}
    found = {frozenset((x.a, x.b)) for x in copies.linked(spark.createDataFrame(sorted(sim.items()), "fp long, sim long")).collect()}
    near = {frozenset((fp[10 * i], fp[10 * i + 1])) for i in range(12) if bin((sim[fp[10 * i]] ^ sim[fp[10 * i + 1]]) & (1 << 64) - 1).count("1") <= copies.MOST}
    assert len(near) >= 8 and near <= found
    assert found <= near
