"""Quality scores: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: every word has a fixed sparse vector of a few signs (its index
vector), and collects those of its neighbours over all documents (its context
vector). Words are hashed to a fixed number of rows, so the context matrix has a
bounded size however large the vocabulary; every task adds up its own, and the
sums are whole numbers, so the result does not depend on the order of tasks.
A word has a surface row and a row for its shape (small and capital letters,
digits, marks, each run once); words that repeat a run of words of the same text,
or the word before, add to rows of their own.

A document is the mean vector of its words. A network with one hidden layer is
trained in numpy on a bounded sample of labelled documents and its logits are
divided by a temperature fitted on a part kept aside, so scores can be read as
probabilities.

Defined results: a null or empty text has the zero vector and gets the
network's score for it; equal texts get equal scores; null ids are scored and
never held out; without two classes among the labels every score is the share of
label 1 (0.5 without labels); repeated labels of an id are averaged; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import words as w
from tapeloom.llm.base import chunks, kept_rows, query, table, texts, utf8
from tapeloom.session import written_once

#: Rows of the context matrix for surfaces, shapes and marks of repetition; its columns.
SURFACES, SHAPES, REPEATS, WIDTH = 1 << 14, 1 << 10, 2, 32
ROWS = SURFACES + SHAPES + REPEATS
#: Signs in an index vector.
SIGNS = 2
#: Labelled documents that the network is trained on, at most.
SAMPLE = 20_000
#: Blocks the matrix is summed in, and first-level sums of a block.
BLOCKS, SALTS = 16, 16
SEED = 7

_b = np.arange(256)
#: Classes of bytes for shapes: small or non-ASCII letter, capital, digit; marks stand for themselves.
_CLASS = np.where((_b >= 97) & (_b <= 122) | (_b >= 128), 1, np.where(
    (_b >= 65) & (_b <= 90), 2, np.where((_b >= 48) & (_b <= 57), 3, _b))).astype(np.uint8)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of every row's index vector."""
    random = np.random.default_rng(SEED)
    return random.integers(0, WIDTH, (ROWS, SIGNS)), random.choice(np.array([-1.0, 1.0]), (ROWS, SIGNS))


class Tokens(NamedTuple):
    """Rows of all words of a batch of texts, in order, and where each text begins."""

    surface: np.ndarray
    shape: np.ndarray
    #: per text: words that equal the one before, and words that begin a run seen before
    same: np.ndarray
    again: np.ndarray
    first: np.ndarray


def tokens(column) -> Tokens:
    data, offsets = utf8(column)
    found = w.find_words(data, offsets, w.NOT_SPACE)
    hashes = w.hash_words(data, found)
    n = len(offsets) - 1
    # a shape is the word with every byte replaced by its class and runs shortened to one
    classes = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = classes[1:] != classes[:-1]
    keep[found.starts] = True
    place = np.append(0, np.cumsum(keep))
    short = w.Words(place[found.starts], place[found.ends], found.first)
    shape = SURFACES + (w.hash_words(classes[keep], short) % np.uint64(SHAPES)).astype(np.int64)
    runs = w.hash_runs(hashes)
    same, again = np.zeros(n), np.zeros(n)
    for d in range(n):
        a, b = found.first[d], found.first[d + 1]
        if b - a > 1:
            same[d] = np.count_nonzero(hashes[a + 1:b] == hashes[a:b - 1])
            own = w.shingles(runs, hashes, a, b)
            again[d] = len(own) - len(np.unique(own))
    return Tokens((hashes % np.uint64(SURFACES)).astype(np.int64), shape, same, again, found.first)


def contexts(docs: DataFrame) -> np.ndarray:
    """The context matrix over all documents: ROWS x WIDTH whole numbers."""
    columns, signs = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(ROWS * WIDTH)
        for batch in chunks(batches):
            t = tokens(batch.column("text"))
            if len(t.surface) < 2:
                continue
            left = np.arange(len(t.surface) - 1)
            last = t.first[1:-1] - 1
            beside = np.ones(len(left), bool)
            beside[last[(last >= 0) & (last < len(left))]] = False
            left = left[beside]
            for own in (t.surface, t.shape):
                for other in (t.surface, t.shape):
                    for mine, its in ((own[left], other[left + 1]), (own[left + 1], other[left])):
                        for k in range(SIGNS):
                            total += np.bincount(
                                mine * WIDTH + columns[its, k], weights=signs[its, k], minlength=ROWS * WIDTH)
        task = TaskContext.get().partitionId() % SALTS
        parts = np.array_split(total.astype(np.int64), BLOCKS)
        yield pa.record_batch({
            "block": pa.array(range(BLOCKS), pa.int32()), "salt": pa.array([task] * BLOCKS, pa.int32()),
            "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(part, np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.record_batch({
                "block": pa.array(list(sums), pa.int32()),
                "sums": pa.array([p.tobytes() for p in sums.values()], pa.binary())})

    parts = docs.select("text").mapInArrow(gather, "block int, salt int, sums binary")
    for keys in (("block", "salt"), ("block",)):
        parts = parts.repartition(BLOCKS, *keys).mapInArrow(add, "block int, sums binary").withColumn("salt", F.lit(0))
    # BLOCKS rows, a few megabytes in all, whatever the input
    got = {r["block"]: np.frombuffer(r["sums"], np.int64) for r in parts.collect()}
    sizes = [len(p) for p in np.array_split(np.empty(ROWS * WIDTH), BLOCKS)]
    return np.concatenate([got.get(i, np.zeros(n, np.int64)) for i, n in enumerate(sizes)]).reshape(ROWS, WIDTH)


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Each row's index vector plus the direction of its context."""
    columns, signs = index_vectors()
    own = np.zeros((ROWS, WIDTH), np.float32)
    for k in range(SIGNS):
        own[np.arange(ROWS), columns[:, k]] += signs[:, k]
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return own + (context / np.maximum(length, 1.0)).astype(np.float32)


def pool(column, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean surface vector, mean shape vector, shares of repetition."""
    t = tokens(column)
    n = np.diff(t.first)
    out = np.zeros((len(n), 2 * WIDTH + 2), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        for k, rows in enumerate((t.surface, t.shape)):
            out[some, k * WIDTH:(k + 1) * WIDTH] = np.add.reduceat(vectors[rows], t.first[some], axis=0)
        out[some, -2], out[some, -1] = t.same[some], t.again[some]
        out[some] /= n[some, None]
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``doc_id, vector array<float>``, see :func:`pool`."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in chunks(batches):
            out = pool(batch.column("text"), vectors)
            values = pa.array(out.ravel(), pa.float32())
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(at, values)], names=["doc_id", "vector"])

    return docs.mapInArrow(run, "doc_id long, vector array<float>")


class Network(NamedTuple):
    """Standardisation, two layers and a temperature; ``prior`` stands in for an untrained one."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0.0)
        return z @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return sigmoid(self.logits(np.asarray(x, np.float64)) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128,
          rate: float = 2e-3, decay: float = 1e-4, seed: int = SEED) -> Network:
    """Adam on the cross entropy; every fifth row is kept aside for the temperature."""
    if len(np.unique(y)) < 2:
        none = np.zeros(0)
        return Network(none, none, none, none, none, 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    aside = np.arange(len(x)) % 5 == 4
    fit_x, fit_y = x[~aside], y[~aside]
    mean, scale = fit_x.mean(0), fit_x.std(0) + 1e-3
    random = np.random.default_rng(seed)
    sizes = x.shape[1]
    p = [random.normal(0, np.sqrt(2 / sizes), (sizes, hidden)), np.zeros(hidden),
         random.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, step = (fit_x - mean) / scale, 0
    for _ in range(epochs):
        order = random.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at:at + batch]
            a, t = z[rows], fit_y[rows]
            h = np.maximum(a @ p[0] + p[1], 0)
            error = (sigmoid(h @ p[2] + p[3]) - t) / len(rows)
            back = np.outer(error, p[2]) * (h > 0)
            grads = [a.T @ back + decay * p[0], back.sum(0), h.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, truth = (net.logits(x[aside]), y[aside]) if aside.any() else (net.logits(fit_x), fit_y)
    grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))

    def loss(temperature: float) -> float:
        s = np.clip(sigmoid(logits / temperature), 1e-9, 1 - 1e-9)
        return -float(np.mean(truth * np.log(s) + (1 - truth) * np.log(1 - s)))

    return net._replace(temperature=float(min(grid, key=loss)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> tuple[np.ndarray, DataFrame, Network]:
    """Word vectors of all ``doc_id, text``, the documents' vectors, and the network.

    The network sees labels only of ids that are not held out, ``sample`` of them
    at most, chosen by a hash of the id.
    """
    words = word_vectors(contexts(docs))
    vectors = written_once(pooled(docs, words), "pooled")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
             .filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label")))
    order = F.xxhash64("doc_id")
    rows = vectors.join(known, "doc_id").orderBy(order, "doc_id", "vector").limit(sample).toPandas()
    x = np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), 2 * WIDTH + 2)
    return words, vectors, train(x, rows["label"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; see :func:`fit`."""
    _, vectors, net = fit(texts(docs, id_col, text_col), labels, label, sample)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column("vector")
            values = column.flatten().to_numpy(zero_copy_only=False)
            score = net.scores(values.reshape(batch.num_rows, 2 * WIDTH + 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return vectors.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents, all columns, that the classifier gives at least an even chance.

    Each row is judged by its own text in the pass that yields it, whatever its id.
    """
    words, _, net = fit(texts(docs, id_col, text_col), labels, label, sample)
    shared = docs.sparkSession.sparkContext.broadcast((words, net))  # of fixed size

    def keep(column: pa.Array) -> np.ndarray:
        words, net = shared.value
        return net.scores(pool(column, words)) >= 0.5

    return kept_rows(docs, keep, text_col)


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
