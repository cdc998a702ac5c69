"""Each operator against brute force on tricky tables; every one on empty tables."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import of_spark, of_sql

import corpus_pipeline
from evidencegraph.llm import bpe, decontaminate, editprint, linededup, pii, queries, simhash, suffixdedup, toxicity, urlfilter, wavelet

QUERIES = queries.queries()


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert of_spark(QUERIES[name](spark, folder)) == of_sql(con, queries.oracle_sql()[name])


def test_op1(spark, folder, documents):
    assert rows(suffixdedup.op1_suffix_dedup(spark, folder)) == sorted(suffixdedup.brute_force(documents), key=repr)


@pytest.mark.parametrize("bucket", [256, 2, 1])
@pytest.mark.parametrize("length", [12, 40])
def test_suffix_dedup_of_any_length(spark, bucket, length, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET", bucket)
    r = random.Random(length)
    some = lambda a, b: "".join(r.choice("abcd ") for _ in range(r.randint(a, b)))
    base = [some(30, 200) for _ in range(6)]
    docs = [(i, "".join(x if r.random() < 0.5 else x[r.randint(0, 9) : len(x) - r.randint(0, 9)] if r.random() < 0.5 else some(1, 80) for x in r.choices(base, k=r.randint(1, 5)))) for i in range(40)]
    docs += [(100, "a" * 300), (101, "ab" * 90), (102, docs[3][1]), (None, docs[3][1])]
    df = suffixdedup.with_spans(spark.createDataFrame(docs, "doc_id long, text string"), length)
    got = []
    table = df.select("doc_id", "_text", "_spans").toArrow().combine_chunks()
    for d, t, s in zip(table["doc_id"].to_pylist(), table["_text"].to_pylist(), table["_spans"].combine_chunks(), strict=True):
        left, removed, runs = suffixdedup.kept(t, s.values)
        got.append((d, len(t), removed, runs, hashlib.sha256(left).hexdigest()))
    assert sorted(got, key=repr) == sorted(suffixdedup.brute_force(docs, length), key=repr)


def test_suffix_dedup_of_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 1000)
    r = random.Random(1)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    a, b = some(1500), some(90)
    docs = [(1, some(2500) + a + some(300)), (2, a[100:1300] + some(2000)), (3, b + some(3000) + b)]
    # with the setting of this process: members is called here, not by a worker
    cells = suffixdedup.Cells(40)
    for _, t in docs:
        parts = list(suffixdedup._parts(len(t), 40))
        whole = {tuple(x) for x in zip(*(v.tolist() for v in cells.of(np.frombuffer(t.encode(), np.uint8), np.array([len(t)]), np.zeros((1, 2), bool))[1:]), strict=True)}
        pieces = set()
        for lo, hi in parts:
            got = cells.of(np.frombuffer(t[lo:hi].encode(), np.uint8), np.array([hi - lo]), np.array([[lo > 0, hi < len(t)]]))
            pieces |= {(g + lo, *x) for g, *x in zip(*(v.tolist() for v in got[1:]), strict=True)}
        assert len(parts) > 1 and pieces == whole


def test_suffix_array():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 7, 20, 300):
        for k in (1, 2, 3, 40):
            x = [r.randrange(k) for _ in range(n)]
            assert suffixdedup.suffix_array(np.array(x, np.int64)).tolist() == sorted(range(n), key=lambda i: x[i:])


def test_dedup_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = suffixdedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_op2(spark, documents):
    more = ["ann@a-b.example.com, x@y, a@b.c.d.e", "1.2.3.4 01.2.3.256 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112 0", "+1 (415) 555-2671; +12 3 +49.30.1234567 +1234567890123456", "a" * 3000 + "@b.c", "1" * 5000, "+1" * 500]
    docs = [*documents, *enumerate(more, 900)]
    got = pii.find(spark.createDataFrame(docs, "doc_id long, text string"))
    got = got.select("doc_id", "text", pii.listed(got["_base"]).alias("s")).collect()
    want = [(d, t, ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(t))) for d, t in docs]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_pii_adds_and_redacts(spark):
    texts = ["call 555-867-5309 now", 'the token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" leaked', "isbn 978-0-306-40615-7", "write john.doe [at] mail [dot] com", "password: required", None, "", "ann@b.com 1.2.3.4"]
    out = pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id")
    assert [r.text for r in out.collect()] == ["call [PHONE] now", "the [SECRET] leaked", "isbn 978-0-306-40615-7", "write [EMAIL]", "password: required", None, "", "[EMAIL] [IP]"]


def test_pii_features_agree(spark):
    kinds, x, _ = pii.examples(60)
    r = random.Random(0)
    cases = [(k, m, b) for k in ("phone", "email", "secret") for m, b in (("(415) 555-2671", "call "), ('token = "a1"', "x_"), ("a. b. c9", "Order no. "), ("", ""))]
    r.shuffle(cases)
    for kind, m, b in cases:
        row = spark.createDataFrame([(m, b)], "m string, b string")
        got = row.select(*[c.cast("double").alias(n) for n, c in pii.features(row["m"], row["b"], kind).items()]).first()
        assert [got[f] for f in pii.FEATURES] == pii.features_of(m, b, kind)
    assert x.shape[1] == len(pii.FEATURES)


def test_op3(spark, folder, documents):
    got = toxicity.op3_toxicity(spark, folder).collect()
    assert len(got) == len(documents)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_learns_pairs(spark):
    r = random.Random(4)
    words = ["river", "stone", "table", "window", "garden", "paper"]
    docs, labels = [], []
    for i in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5  # only both together are toxic
        text = r.sample(words, 4) + ["grumble"] * a + ["folkname"] * b
        r.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, int(a and b)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(d, lab)
    y = dict(labels)
    held = [(x.score >= 0.5, y[x.doc_id]) for x in toxicity.scored(d, machine).collect() if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert np.mean([p == t for p, t in held]) > 0.97
    kept = toxicity.reject_toxic(d, lab)
    assert kept.columns == d.columns and 0.6 * len(docs) < kept.count() < len(docs)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [x.score for x in toxicity.scored(d, toxicity.fit(d, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))).collect()] == [0.0, 0.0]


def test_urls_by_brute_force(spark):
    r = random.Random(5)
    label = ["a", "b", "c-", "0", "", "net", "org"]
    host = lambda n: ".".join(r.choice(label) for _ in range(r.randint(1, n)))
    rules = [(host(3), r.choice(["/", "/a", "/a/b", ""]), r.choice(["block", "allow"])) for _ in range(60)]
    urls = [f"s://{host(5)}{r.choice(['', '/', '/a', '/a/bc', '?q', '/a#x'])}" for _ in range(600)]
    pages, table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    for x in urlfilter.judge(pages, table).collect():
        url = urls[x.page_id].split("://", 1)[1]
        end = min([len(url), *(url.find(c) for c in "/?#" if c in url)])
        h, rest = url[:end], url[end:]
        path = rest[: min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])]
        fit = [(len(a) + len(p), v, a + p) for a, p, v in rules if (h == a or h.endswith("." + a)) and path.startswith(p)]
        assert (x.host, x.path) == (h, path)
        if fit:
            best = max(f[0] for f in fit)
            assert x.rule in {f[2] for f in fit if f[0] == best} and x.verdict in {f[1] for f in fit if f[0] == best}
        else:
            assert x.rule is None and x.verdict == "allow"


def test_op5(spark, folder, documents):
    got = editprint.op5_editprint(spark, folder).collect()
    assert len(got) == len(documents)
    by_text: dict[str, set] = {}
    texts = {(d, len(t or "")): t or "" for d, t in documents}
    for r in got:
        by_text.setdefault(texts[r.doc_id, r.n_chars], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    unique = [(d, t or "") for d, t in documents if d is not None and [x for x, _ in documents].count(d) == 1]
    order = sorted({d for d, _ in documents if d is not None}, reverse=True)
    for d, t in unique:
        at = order.index(d)
        following = dict(unique).get(order[at + 1]) if at + 1 < len(order) else None
        if following is not None:
            want = hashlib.sha256(editprint.edited(t, following).encode()).hexdigest()
            assert [r.edited_sha256 for r in got if r.doc_id == d] == [want]


def test_edit_fingerprints_tell_edits(spark):
    r = random.Random(2)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400))
    a, b = text(), text()
    c = list(a)
    for i in range(0, len(c), 300):
        c[i] = "z"
    fp = editprint.fingerprints([a, "".join(c), b, a, ""])
    near = editprint.likeness(fp[[0, 0, 0]], fp[[1, 2, 3]])
    assert near[0] > 0.6 and near[1] < 0.2 and near[2] == 1
    docs = [(1, a), (2, "".join(c)), (3, b), (4, a), (5, None)]
    classes = {x.doc_id: x.class_id for x in editprint.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 0.6).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_op6(spark, folder, documents):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in documents:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.op6_bpe(spark, folder)) == sorted(want, key=repr)


def test_bpe_streams_and_reads_back(spark, folder, documents):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    encoder, decoder = bpe.Encoder(ranks), bpe.Decoder(ranks)
    for _, t in documents:
        chunks = list(decoder.stream(np.frombuffer(encoder(t or ""), "<u4").tolist()))
        assert b"".join(chunks) == (t or "").encode()
        assert all(c.decode() is not None for c in chunks)  # whole characters only
    r = random.Random(8)
    for n in range(300):
        piece = bytes(r.choice(b"aeth in\xc3\xa9\xe6") for _ in range(n % 40 + 1))
        assert encoder.transducer.encode(piece) == encoder.transducer.merge(piece)
    back = bpe.decode(bpe.encode(spark.read.parquet(f"{folder}/documents.parquet")))
    assert rows(back) == sorted(((d, t or "") for d, t in documents), key=repr)


def test_op7(spark, folder, documents):
    assert rows(linededup.op7_line_dedup(spark, folder)) == sorted(linededup.brute_force(documents), key=repr)


def test_line_templates(spark):
    base = " ".join("word" + chr(97 + i) for i in range(20))
    docs = [(i, f"own line number of {'abcdefgh'[i]} only\nPage {i} of 9\n{base.replace('wordk', 'name' + 'xyz'[i % 3])}\n\nshort") for i in range(8)] + [(20, "Page 3 of 9"), (21, None)]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and out[5] == "own line number of f only\n\nshort" and 20 not in out and out[21] is None
    four = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs[:4], "doc_id long, text string")).collect()}
    assert four[0] == docs[0][1] and four[3] == "own line number of d only\nPage 3 of 9\n\nshort"  # the long one recurs from two documents on
    assert rows(linededup.dedup_lines(spark.createDataFrame(docs[:4], "doc_id long, text string"), long=None)) == sorted(docs[:4])


def test_op8(spark, folder, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(wavelet.VOCABULARY))
    want, start = [], 0
    got = wavelet.op8_wavelet(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, _ in documents), key=lambda d: -1 if d is None else d)
    coded = {(d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x in documents}
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want.append((r.doc_id, r.n_tokens, r.ids_crc32))
    have = sorted(((d, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for d, i in coded), key=repr)
    assert sorted(set(want), key=repr) == have and len(want) == len(documents)


def test_wavelet_matrix():
    r = np.random.default_rng(6)
    for n, top in ((0, 2), (1, 2), (1000, 50), (140_000, 7)):
        ids = r.integers(0, top, n).astype(np.uint16)
        m = wavelet.Matrix(wavelet.Matrix.build(ids, np.array([3, 4]), np.array([0, n // 2, n])))
        assert (m.ids() == ids).all() and m.doc_ids.tolist() == [3, 4]
        for i in r.integers(0, n, 20) if n else ():
            assert m.access(int(i)) == ids[i]
        for token in range(min(top, 6)):
            where = np.flatnonzero(ids == token)
            assert m.count(token) == len(where) and m.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
            for k in (0, len(where) // 2, len(where) - 1) if len(where) else ():
                assert m.locate(token, k) == where[k]
        with pytest.raises(IndexError):
            m.access(n)


def test_op9(spark, folder, documents):
    got = rows(simhash.op9_simhash(spark, folder))
    known = [x for x in documents if x[0] is not None]
    assert [x for x in got if x[0] is not None] == sorted(simhash.brute_force(known), key=repr)


def test_simhash_links_need_few_agreeing_bytes(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    for most in (1, 3, 7):
        from evidencegraph.llm.links import components

        got = {x.node: x.root for x in components(simhash.links(df, most)).collect()}
        root = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= most and root[i] != root[j]:
                    a, b = sorted((root[i], root[j]))
                    root = [a if x == b else x for x in root]
        assert [got.get(i, i) for i in range(len(fps))] == root


def test_keep_one(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    groups = {c for d, _, c in simhash.brute_force([x for x in documents if x[0] is not None])}
    assert sorted(ids) == sorted(groups)


def test_op10(spark, folder, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id is not null").collect()]
    assert rows(decontaminate.op10_decontaminate(spark, folder)) == sorted(decontaminate.brute_force(documents, items), key=repr)


def test_decontamination_by_brute_force(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items, docs = [(i, text(r.randint(0, 14))) for i in range(12)], [(i, text(r.randint(0, 60))) for i in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (3, 10):
        got = {x.doc_id: x for x in decontaminate.matches(df, bench, window).collect()}
        for d, n, hit, n_items, _, _ in decontaminate.brute_force(docs, items, window):
            s = got[d]["_spans"]
            assert (got[d]["_n_words"], sum(s[1::2]) - sum(s[::2]), len(got[d]["_items"])) == (n, hit, n_items)


def test_decontaminate_cuts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"clean words stand here before it, yes they do and more so: {item}! and clean ones after as well, quite many"), (2, item), (3, "nothing"), (4, None)]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {1, 3, 4} and "three" not in got[1] and "and clean ones" in got[1] and got[4] is None


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        docs = spark.createDataFrame(out.collect(), out.schema)
    got = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(got) == key(docs)
