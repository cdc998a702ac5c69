"""Edit fingerprints read whole texts, follow edits, and find near copies."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from evidencegraph.llm import editprint


def prose(r: random.Random, n: int) -> str:
    return "".join(r.choice("abcdefghij ") for _ in range(n))


def walk(text: str) -> list[tuple[int, int]]:
    """Step by step: the character at each step of the walk, and its class."""
    out, at, step = [], 0, 0
    classes = editprint._symbols(text).tolist()
    while at < len(text):
        out.append((at, classes[at]))
        at += int(editprint._MOVES[classes[at], step % editprint.PERIOD])
        step += 1
    return out


def test_walks_side_by_side_and_alone():
    r = random.Random(1)
    texts = [prose(r, r.choice((0, 1, 5, 80, 700, 3000))) for _ in range(150)] + ["日本é" * 50]
    together = editprint.fingerprints(texts)
    for t, code in zip(texts, together, strict=True):
        assert (editprint.fingerprints([t])[0] == code).all()
        steps = walk(t)
        scale, used = int(code[0]), int(code[1]) + 256 * int(code[2])
        wanted = [s for s in editprint.sampled(scale)[0].tolist() if s < len(steps)]
        assert used == len(wanted) and len(steps) <= editprint.steps_in(scale)
        left = editprint._walked(editprint._symbols(t), np.array([len(t)]), np.zeros(1, np.int64)) if t else np.zeros(0, np.int64)
        assert [steps[s][0] for s in wanted] == np.searchsorted(left, wanted, "right").tolist()


def test_scales_are_nested():
    for scale in range(1, 50):
        steps, kept = editprint.sampled(scale)
        before = editprint.sampled(scale - 1)[0]
        assert (np.diff(steps) > 0).all() and steps[-1] < editprint.steps_in(scale)
        assert (steps[: len(kept)] == before[kept]).all() and (steps[len(kept) :] >= editprint.steps_in(scale - 1)).all()


def test_ends_of_texts_count():
    r = random.Random(3)
    for n in (3, 40, 512, 5000):
        text = prose(r, n)
        other = text[: n // 2] + prose(r, n - n // 2)
        x, y = editprint.fingerprints([text, other])
        assert text == other or editprint.likeness(x[None], y[None])[0] < 0.95


def test_likeness_follows_edit_distance():
    r = random.Random(5)
    base = [prose(r, 2000) for _ in range(30)]
    near = []
    for share in (0.0, 0.002, 0.01, 0.05, 0.5, 1.0):
        other = []
        for t in base:
            c = list(t)
            for _ in range(round(share * len(c))):
                k = r.randrange(len(c))
                c[k : k + r.randint(0, 1)] = r.choice(("", "z", "y"))
            other.append("".join(c) if share < 1 else prose(r, 2000))
        near.append(float(editprint.likeness(editprint.fingerprints(base), editprint.fingerprints(other)).mean()))
    assert near[0] == 1 and near[:5] == sorted(near[:5], reverse=True) and near[1] > 0.8 and max(near[4:]) < 0.1


def test_half_edited_texts_are_half_alike(spark, tmp_path):
    r = random.Random(6)
    docs = [(i, prose(r, r.randint(200, 4000))) for i in range(40)] + [(50, None), (51, ""), (None, prose(r, 300))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in editprint.op5_editprint(spark, str(tmp_path)).collect()}
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):  # after the last comes the first
        t, following, row = t or "", following or "", got[d]
        new = editprint.edited(t, following)
        own, changed, nxt = editprint.fingerprints([t, new, following])
        assert (row.n_chars, row.edited_sha256, row.fingerprint, row.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), own.tobytes().hex(), changed.tobytes().hex())
        assert (row.near_edited, row.near_next) == (editprint.likeness(own[None], changed[None])[0], editprint.likeness(own[None], nxt[None])[0])
        if len(t) > 500 and len(following) > 500:
            assert 0.3 < row.near_edited < 0.8 and row.near_next < 0.25


def test_near_copies_are_found(spark):
    r = random.Random(7)
    docs = []
    for i in range(60):
        base = prose(r, r.choice((60, 400, 3000)))
        docs.append((10 * i, base))
        for j in range(1, 4):
            c = list(base)
            for _ in range(max(1, len(c) // 400) * (j - 1)):
                c[r.randrange(len(c))] = "z"
            docs.append((10 * i + j, "".join(c)))
    got = {x.doc_id: x.class_id for x in editprint.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    codes = editprint.fingerprints([t for _, t in docs])
    root = {d: d for d, _ in docs}
    for i in range(len(docs)):  # links by all pairs
        alike = editprint.likeness(np.broadcast_to(codes[i], codes.shape), codes) >= 0.8
        for j in np.flatnonzero(alike).tolist():
            a, b = root[docs[i][0]], root[docs[j][0]]
            if a != b:
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert np.mean([got[d] == root[d] for d in root]) >= 0.98 and all(got[d] >= root[d] for d in root)
