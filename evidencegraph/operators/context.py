"""Examples for prompts: the best cases of a task, refreshed from history, and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_cases(history: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """TOP-3: the k most confident successes of each task_type, in order of seq at ties, with `rank`."""
    w = Window.partitionBy("task_type").orderBy(F.col("confidence").desc(), "seq")
    return history.filter(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def refreshed(store: DataFrame, history: DataFrame, k: int = 3, most: int = 10) -> DataFrame:
    """TOP-4: `store` with the k best new cases of each task_type whose input it lacks; the `most` best stay."""
    new = best_cases(history, k=k).drop("rank")
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("task_type", "input").orderBy(F.col("confidence").desc(), "seq"))).filter("_n = 1").drop("_n")
    added = first.join(store.select("task_type", "input"), ["task_type", "input"], "left_anti")
    both = store.unionByName(added, allowMissingColumns=True)
    return best_cases(both, least=float("-inf"), k=most)


def examples(store: DataFrame, history: DataFrame, n: int = 5) -> DataFrame:
    """TOP-5: stored examples first, then cases of the history, n of each task_type."""
    both = store.withColumn("_from", F.lit(0)).unionByName(best_cases(history, k=n).drop("rank").withColumn("_from", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("task_type").orderBy("_from", F.col("confidence").desc(), "seq")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_from")


def prompts(chosen: DataFrame, instruction: str) -> DataFrame:
    """TOP-6: one text for each task_type: the instruction, then its examples by rank."""
    one = F.struct("rank", F.concat(F.lit("Input: "), "input", F.lit("\nOutput: "), "output").alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"])
    return chosen.groupBy("task_type").agg(F.concat_ws("\n\n", F.lit(instruction), F.array_join(texts, "\n\n")).alias("prompt"))


def triggers(cases: DataFrame, every: int, seq: str = "seq") -> DataFrame:
    """WIN-2: every n-th case of each task_type."""
    w = Window.partitionBy("task_type").orderBy(seq)
    return cases.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") % every == 0)


def statistics(cases: DataFrame) -> DataFrame:
    """AGG-23: cases, successes and success rate of each task_type."""
    return cases.groupBy("task_type").agg(F.count("*").alias("cases"), F.count_if("success").alias("successes"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"))


def failures(cases: DataFrame) -> DataFrame:
    """MSC-7."""
    return cases.filter(~F.col("success")).groupBy("error_type").agg(F.count("*").alias("n"))


#: Rows of a block of queries and of a block of the index, and numbers that a task scores at a time.
QUERIES, ROWS, SCORES = 2048, 8192, 1 << 21
#: What a product of matrices may differ by, of unit vectors, from sums in order; those so near the k-th are scored again, in order.
SLACK = 1e-9


def nearest(queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """UDF-15: the k rows of `index` (vec_id, embedding) of the greatest cosine to each query, the smaller id at ties; its own row doesn't count.

    Blocks of queries meet blocks of the index, as matrices; a block keeps its k best for each query before the few that are left meet. All
    queries are compared with all rows, so the work grows with their product.
    """

    def dealt(rows: DataFrame, size: int, tag: str) -> tuple[DataFrame, int]:
        n = rows.count() // size + 1
        return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(f"_{tag}")).agg(F.collect_list(F.struct(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))).alias(tag)), n

    # vectors of the most common length make matrices; others, and those with a null, meet as rows
    usual = index.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).agg(F.max_by("n", F.struct("c", "n"))).first()[0]
    plain = F.coalesce((F.size("embedding") == F.lit(usual)) & (F.size("embedding") > 0) & ~F.exists("embedding", lambda y: y.isNull()), F.lit(False))
    (q, n_q), (x, n_x) = dealt(queries.filter(plain), QUERIES, "q"), dealt(index.filter(plain), ROWS, "x")
    met = q.join(x.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))), "_q").repartition(min(n_q * n_x, 4096), "_q", "_x").select("q.i", "q.v", "x.i", "x.v").toDF("qi", "qv", "xi", "xv")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(vectors: pa.Array, n: int) -> np.ndarray:
            return vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

        def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Of rows of both, added from the first to the last."""
            return np.cumsum(a * b, axis=1)[:, -1]

        for batch in batches:
            for r in range(batch.num_rows):
                qi, qv, xi, xv = (batch.column(c)[r].values for c in range(4))
                qi, xi = (c.to_numpy(zero_copy_only=False) for c in (qi, xi))
                a, b = matrix(qv, len(qi)), matrix(xv, len(xi))
                na, nb = (np.sqrt(in_order(m, m)) for m in (a, b))
                with np.errstate(divide="ignore", invalid="ignore"):
                    ua, ub = a / na[:, None], b / nb[:, None]
                    step = max(1, SCORES // len(xi))
                    for at in range(0, len(qi), step):
                        s = slice(at, at + step)
                        rough = ua[s] @ ub.T
                        rough[qi[s][:, None] == xi[None, :]] = -np.inf
                        # a vector of length 0 has no cosine: nan, which is the greatest to Spark
                        rough = np.where(np.isnan(rough), np.inf, rough)
                        least = np.partition(rough, -k, axis=1)[:, -k] if len(xi) > k else np.full(len(rough), -np.inf)
                        i, j = np.nonzero((rough >= least[:, None] - SLACK) & (rough > -np.inf))
                        i = i + at
                        score = in_order(a[i], b[j]) / (na[i] * nb[j])
                        order = np.lexsort((xi[j], -np.where(np.isnan(score), np.inf, score), i))
                        i, j, score = i[order], j[order], score[order]
                        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
                        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                        kept = rank < k
                        yield pa.RecordBatch.from_arrays([pa.array(qi[i[kept]]), pa.array(xi[j[kept]]), pa.array(score[kept])], names=["query_id", "vec_id", "score"])

    kind = index.schema["vec_id"].dataType.simpleString()
    best = met.mapInArrow(work, f"query_id {kind}, vec_id {kind}, score double")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda v, w: v.cast("double") * w.cast("double")), F.lit(0.0), lambda t, v: t + v)
    for some, others in ((queries.filter(~plain), index), (queries.filter(plain), index.filter(~plain))):
        rows = some.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).join(others.select("vec_id", F.col("embedding").alias("v"))).filter("query_id <> vec_id")
        best = best.unionByName(rows.select("query_id", "vec_id", (product("q", "v") / (F.sqrt(product("q", "q")) * F.sqrt(product("v", "v")))).alias("score")))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("rank") <= k)


def function_results(turns: DataFrame, conversation: str = "conv_id", position: str = "turn") -> DataFrame:
    """UDF-14: what follows a call: each assistant turn after a user turn, with the call before it."""
    w = Window.partitionBy(conversation).orderBy(position)
    out = turns.withColumns({"call": F.lag("text").over(w), "caller": F.lag("role").over(w)})
    return out.filter("role = 'assistant' and caller = 'user'").select(conversation, position, "call", F.col("text").alias("result"))
