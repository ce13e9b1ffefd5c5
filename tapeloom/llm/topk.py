"""Exact top-k inner products by no-random-access aggregation.

Components become the integers floor(64 * x). A query grades every candidate
once per group of dimensions: the partial inner product. Each group's grades make
a list sorted from the best on; the lists are read in step, from the top, a
stretch at a time. What has been read of a candidate bounds its score from above
(the unread lists can give no more than where they stand) and from below (no
less than their ends). Reading stops once all candidates that can still reach the
k-th best lower bound are few; only their scores are resolved in full. Equal
scores count as reaching, so ties are settled by id.

Queries are a stated set: blocks of bounded size, each sent to all tasks. A task
works through its candidates in blocks of bounded size, keeps k per query, whose
last is a bound for later blocks, and sends k rows a query. The rows of a query
are ranked last.

Defined results: a vector that is null, holds a null or a component that is not
finite, or has no id takes no part; a shorter vector counts as padded by zeros;
of repeated ids the least vector is the query, and none of their rows is its
candidate; repeated candidates each count; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.base import query, table

SCALE, TOP, EVERY = 64, 20, 20
#: Lists per query, candidates graded at a time, queries sent to the tasks at a time.
LISTS, BLOCK, QUERIES_AT_ONCE = 4, 1 << 13, 4096
#: Shares of the lists after which the bounds are compared.
DEPTHS = (0.05, 0.15, 0.3, 0.5, 0.75, 1.0)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v array<double>`` of the rows that take part, scaled to whole numbers."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall(
        F.col(f"`{vector_col}`"),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & finite).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of the lists, cut or padded with zeros to ``width``."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values[offsets[0]:offsets[-1]].reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i, (a, n) in enumerate(zip(offsets, sizes)):
        out[i, :min(n, width)] = values[a:a + min(n, width)]
    return out


def exact_type(queries: np.ndarray, rows: np.ndarray):
    """The smallest type in which every partial and full score is exact."""
    reach = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object


def candidates(grades: np.ndarray, own: np.ndarray, k: int, bound) -> np.ndarray:
    """Places of all candidates that can be among the best ``k``, by reading the lists in step.

    ``grades`` has a row per list; ``own`` are places that do not count; ``bound``
    is a score known to be needed.
    """
    lists, n = grades.shape
    order = np.argsort(-grades, axis=1)
    total, unread = np.zeros(n, grades.dtype), np.ones(grades.shape, bool)
    ends = grades[np.arange(lists), order[:, -1]]
    at = 0
    for share in DEPTHS:
        upto = max(at + 1, int(np.ceil(n * share)))
        for i in range(lists):
            read = order[i, at:upto]
            total[read] += grades[i, read]
            unread[i, read] = False
        at = min(upto, n)
        stand = grades[np.arange(lists), order[:, at - 1]]
        low = total + ends @ unread
        low[own] = -np.inf
        if n > k:
            bound = max(bound, np.partition(low, n - k)[n - k])
        high = total + stand @ unread
        high[own] = -np.inf
        open_ = np.flatnonzero((high >= bound) & (high > -np.inf))
        if at >= n or len(open_) <= 4 * k and stand.sum() < bound:
            break
    return open_


class Best:
    """The best k of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0, object)] * n
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n

    def bound(self, q: int):
        return self.scores[q][-1] if len(self.scores[q]) >= self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.append(self.scores[q], scores)
        ids = np.append(self.ids[q], ids)
        keep = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[keep], ids[keep]


def grade_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Let a block of candidates meet all queries."""
    kind = exact_type(queries, rows)
    left, right = queries.astype(kind), rows.astype(kind)
    cuts = np.array_split(np.arange(queries.shape[1]), min(LISTS, max(1, queries.shape[1])))
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], query_ids, side="left")
    last = np.searchsorted(ids[order], query_ids, side="right")
    for start in range(0, len(queries), 64):
        part = np.stack([left[start:start + 64, c] @ right[:, c].T for c in cuts])
        for j in range(part.shape[1]):
            q = start + j
            own = order[first[q]:last[q]]
            found = candidates(part[:, j], own, best.k, best.bound(q))
            if len(found):
                scores = (right[found] @ left[q]).astype(object if kind is object else np.int64)
                best.add(q, scores, ids[found])


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id",
                       vector_col: str = "embedding", at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the best ``k`` rows for every query."""
    spark = rows.sparkSession
    everything = usable(rows, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // at_once))
    out = None
    for block in range(blocks):
        # about ``at_once`` queries, however many there are in all
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toPandas()
        width = int(mine["v"].map(len).max()) if len(mine) else 0
        data = np.zeros((len(mine), width))
        for i, v in enumerate(mine["v"]):
            data[i, :len(v)] = v
        shared = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(np.int64), data))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width):
            query_ids, data = shared.value
            best = Best(len(query_ids), k)
            waiting, n = [], 0

            def work():
                ids = np.concatenate([i for i, _ in waiting])
                values = np.concatenate([v for _, v in waiting])
                for a in range(0, len(ids), BLOCK):
                    grade_block(ids[a:a + BLOCK], values[a:a + BLOCK], query_ids, data, best)

            for batch in batches:
                if batch.num_rows and len(query_ids):
                    waiting.append((batch.column("vec_id").to_numpy(), matrix(batch.column("v"), width)))
                    n += batch.num_rows
                    if n >= BLOCK:
                        work()
                        waiting, n = [], 0
            if waiting:
                work()
            for q, i in enumerate(query_ids.tolist()):
                if len(best.ids[q]):
                    score = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in best.scores[q]]
                    yield pa.record_batch({
                        "query_id": pa.array([i] * len(score), pa.int64()), "vec_id": pa.array(best.ids[q], pa.int64()),
                        "score": pa.array(score, pa.int64())})

        part = everything.mapInArrow(run, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


@query("op6_exact_top_k", """
WITH v AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 20""")
def op6(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return top_inner_products(rows, rows.filter(F.col("vec_id") % EVERY == 0))
