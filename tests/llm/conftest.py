from __future__ import annotations

import random

import pytest


def tricky() -> list[tuple[int | None, str | None]]:
    """Nulls, empty, blank and long texts, ties, repeated rows, one id with two texts, copies and near copies, odd characters."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeß日é") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long = prose(4000)
    shared = prose(120)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "A"), (5, long), (6, long), (None, prose(30)), (None, None), (None, shared)]
    rows += [(10 + i, f"{prose(40)}\n{shared}\n{prose(60)}") for i in range(8)]
    rows += [(30, "x" * 900), (31, "xy" * 300), (32, "😀 \x00 \u2028 ​ tab\tx\r\n"), (33, "İSTANBUL ſ Å"), (40, shared), (40, prose(5)), (41, shared)]
    base = prose(300).split()
    for i in range(6):
        own = list(base)
        own[i * 7] = word()
        rows.append((50 + i, " ".join(own)))
    rows += [rows[4], rows[10]]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents() -> list[tuple[int | None, str | None]]:
    return tricky()


@pytest.fixture(scope="session")
def folder(spark, documents, tmp_path_factory) -> str:
    """The tricky documents with columns that clash with names that operators use, and small other tables."""
    at = tmp_path_factory.mktemp("tables")
    rows = [(d, t, "x", 7, "y", "z", None if t is None else len(t)) for d, t in documents]
    spark.createDataFrame(rows, "doc_id long, text string, key string, fp int, h1 string, _part string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(documents)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(1, " ".join((documents_text(documents)).split()[:40])), (2, "A"), (2, "A"), (3, None), (None, "x"), (4, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    urls = [None, "", "http", "http://", "HTTPS://Www.Example.NET/en/x?y#z", "a://net/", "a://.net/", "a://example.net?en/", "a://example.com/de/", "x://org/fr/a", "x://sub.org#fr/", "x://b.example.com/de", "x://notnet/", "a://net:80/"]
    spark.createDataFrame([(i // 2 * 2 if i else None, u, "x") for i, u in enumerate([*urls, *urls[:3], "h://a.net/" + "p" * 100_000])], "page_id long, url string, host string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def documents_text(documents: list) -> str:
    return next(t for d, t in documents if d == 10)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory) -> str:
    at = tmp_path_factory.mktemp("empty")
    for name, schema in {"documents": "doc_id long, text string, n_chars long", "labels": "doc_id long, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)
