"""The pipeline's near-duplicate stage against the similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from evidencegraph.llm import copies


def edited() -> list[tuple[int | None, str | None]]:
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    docs: list[tuple[int | None, str | None]] = [(900, None), (901, " "), (902, "One two"), (903, "one TWO"), (None, "one two"), (None, "only here")]
    for i in range(30):
        base = [word() for _ in range(r.choice((9, 30, 120, 1500)))]
        for j in range(8):
            own = list(base)
            for k in r.sample(range(len(own)), round(len(own) * j / 150)):
                own[k] = word()
            docs.append((i * 10 + j if (i, j) != (3, 0) else None, " ".join(own)))
    return docs


def test_pairs_of_the_similarity_are_kept_once(spark):
    docs = edited()
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {(r.doc_id, r.text) for r in out.collect()} == copies.brute_force(docs)


def test_bounds_hold_for_every_pair_of_the_similarity():
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 9, 40, 700, 3000):
        for _ in range(20):
            x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            gone = int(r.integers(0, n // 9 + 1))
            y = np.unique(np.concatenate((x[r.permutation(len(x))[gone:]], r.integers(0, 1 << 63, gone).astype(np.uint64))))
            common = len(np.intersect1d(x, y))
            if 5 * common < 4 * (len(x) + len(y) - common):
                continue
            met = set(x[: copies.beginning(len(x))].tolist()) & set(y[: copies.beginning(len(y))].tolist())
            assert len(met) >= copies.shared(min(len(x), len(y)))
            code = [np.frombuffer(copies.sketch(s) + bytes([k] * 8), np.uint8)[None, :] for k, s in enumerate((x, y))]
            assert copies.Candidates(True).two(*code).all()
