"""The pipeline's line stage drops long lines of two documents, and short ones of five."""

from __future__ import annotations

import corpus_pipeline


def test_long_lines_recur_in_two_documents(spark):
    long = " ".join("word" + chr(97 + i) for i in range(20))
    fields = " ".join(["1"] * 10 + ["word" + chr(97 + i) for i in range(10)])
    docs = [(1, f"{long} 7\nown one\nshort line here\n{fields}"), (2, f"own two\n{long} 8\nshort line here\n{fields}"), (3, "own three\nshort line here")]
    out = corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: docs[0][1], 2: f"own two\nshort line here\n{fields}", 3: docs[2][1]}
