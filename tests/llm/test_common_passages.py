"""Passages that many texts have don't pair these texts, and no copies are lost."""

from __future__ import annotations

import random

from evidencegraph.llm import copies


def with_passages() -> list[tuple[int, str]]:
    r = random.Random(3)
    prose = lambda n: [f"{r.randrange(1 << 30):x}" for _ in range(n)]
    passage, most = prose(100), prose(60)
    docs = [prose(700) + passage + prose(700) for _ in range(80)]
    docs += [prose(20) + most for _ in range(40)]  # too much of it is common for its buckets to be left
    for base in (docs[0], docs[1], docs[80]):
        for k in (2, len(base) // 50):
            own = list(base)
            for i in r.sample(range(len(own)), k):
                own[i] = "x"
            docs.append(own)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_common_passages_give_few_candidates_and_lose_no_copies(spark, monkeypatch):
    docs, made = with_passages(), []
    search = copies.bucketed

    def counted(*args):
        found = search(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(copies, "bucketed", counted)
    out = copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r.doc_id, r.text) for r in out.collect()} == copies.brute_force(docs)
    assert sum(made) < 10_000


def test_few_common_hashes_leave_another_one_for_every_copy():
    for n in range(1, 3000):
        for m in range(n, min(2999, n * copies.UNDER // copies.OVER) + 1, 7):
            assert copies.fewest(n) <= copies.shared(n) and copies.fewest(m) <= copies.shared(n)
