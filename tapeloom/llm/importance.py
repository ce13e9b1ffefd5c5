"""Importance resampling towards a target distribution, by hashed n-grams.

A text's features are its runs of consecutive words, each hashed to the CRC-32
of its words joined by one space, modulo a number of buckets. Counts per bucket
over all documents and over the target give every bucket a gain; a document's
weight is the sum over its features. With Gumbel noise drawn from the document's
id, the highest scores are a sample without replacement in proportion to the
weights.

No run of words is hashed by itself. The words of a text, joined by single
spaces, are scanned once and the running CRC register is kept at every place. CRC
is linear over GF(2): the register after ``A + B`` is that after ``A``, shifted by
the length of ``B``, xor that of ``B`` alone. So the CRC of any run follows from
the registers at its two ends by cancelling the shifted first one. The scan takes
many lanes of equal length abreast; where a lane starts is found by the same rule.

Defined results: a null or empty text has no features, weight 0 and is not
drawn; a null id hashes as the empty word and loses ties; equal rows get
neighbouring ranks; an empty target gives gains towards nothing (its counts are
0); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import words as w
from tapeloom.llm.base import chunks, query, table, texts, utf8
from tapeloom.session import written_once

BUCKETS = 10_000
SEED = 2024
#: Words a document needs to be drawn, and the share drawn of those that have them.
LEAST_WORDS, PERCENT = 20, 10

#: CRC-32, reflected: the polynomial, and the value a register begins and ends with.
POLYNOMIAL, ENDS = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes of a lane; and of a stretch of words scanned at a time (a longer word alone).
LANE, STRETCH = 512, 1 << 20
SPACE = 32


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, k, v]``: the register with byte ``k`` equal to ``v``, ``n`` zero bytes on."""
    out = np.empty((LANE + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(LANE):
        out[n + 1] = _BYTE[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shift_tables()


def apply_shift(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """``register`` through the four tables of one length."""
    return (tables[0, register & 255] ^ tables[1, (register >> 8) & 255]
            ^ tables[2, (register >> 16) & 255] ^ tables[3, register >> 24])


def _doubled() -> list[np.ndarray]:
    """Tables of ``LANE * 2**k`` bytes, for every ``k`` that a text can need."""
    out = [_SHIFT[LANE]]
    for _ in range(31):
        out.append(apply_shift(out[-1], out[-1]))
    return out


_LANES = _doubled()


def shift(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each register, ``length`` zero bytes on."""
    rest = length % LANE
    out = (_SHIFT[rest, 0, register & 255] ^ _SHIFT[rest, 1, (register >> 8) & 255]
           ^ _SHIFT[rest, 2, (register >> 16) & 255] ^ _SHIFT[rest, 3, register >> 24])
    left, k = length // LANE, 0
    while left.any():
        at = np.flatnonzero(left & 1)
        if len(at):
            out[at] = apply_shift(_LANES[k], out[at])
        left, k = left >> 1, k + 1
    return out


def running_registers(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The register after the first ``places`` bytes of ``stream``, begun at 0."""
    lanes = -(-len(stream) // LANE)
    across = np.zeros((lanes, LANE), np.uint8)
    across.reshape(-1)[:len(stream)] = stream
    across = np.ascontiguousarray(across.T)
    local = np.empty((LANE, lanes), np.uint32)
    register = np.zeros(lanes, np.uint32)
    for i in range(LANE):
        register = _BYTE[(register ^ across[i]) & 255] ^ (register >> 8)
        local[i] = register
    # the register at each lane's end, from those of all lanes before it, by doubling
    start, k = register.copy(), 0
    while 1 << k < lanes:
        start[1 << k:] ^= apply_shift(_LANES[k], start[:-(1 << k)].copy())
        k += 1
    start = np.append(np.uint32(0), start)
    lane = np.maximum(places - 1, 0) // LANE
    inside = places - lane * LANE
    out = shift(start[lane], inside)
    some = inside > 0
    out[some] ^= local[inside[some] - 1, lane[some]]
    return out


def joined(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one space apart, and where each starts and ends then."""
    lengths = ends - starts
    last = np.cumsum(lengths + 1) - 1
    first = last - lengths
    stream = np.full(int(last[-1]) + 1, SPACE, np.uint8)
    word = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    stream[first[word] + place] = lower[starts[word] + place]
    return stream, first, last


def run_crcs(lower: np.ndarray, found: w.Words, longest: int) -> list[np.ndarray]:
    """For each length up to ``longest``: CRC-32 of the run of words that starts at each word.

    Runs that begin within ``length - 1`` words of the end are left out; those
    across two texts are for the caller to leave out.
    """
    n = len(found.starts)
    out = [np.empty(max(n - size + 1, 0), np.uint32) for size in range(1, longest + 1)]
    at = 0
    while at < n:
        # runs that start in this stretch end in it or in the few words after
        upto = max(at + 1, int(np.searchsorted(found.ends, found.starts[at] + STRETCH, side="right")))
        end = min(n, upto + longest - 1)
        stream, first, last = joined(lower, found.starts[at:end], found.ends[at:end])
        registers = running_registers(stream, np.concatenate([first, last]))
        begun, ended = registers[:len(first)] ^ ENDS, registers[len(first):]
        for size in range(1, longest + 1):
            count = min(upto, n - size + 1) - at
            if count > 0:
                length = last[size - 1:size - 1 + count] - first[:count]
                out[size - 1][at:at + count] = ended[size - 1:size - 1 + count] ^ shift(begun[:count], length) ^ ENDS
        at = upto
    return out


def text_features(column, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: the text and the bucket of every feature, and each text's number of words."""
    data, offsets = utf8(column)
    lower = w.LOWER[data]
    found = w.find_words(lower, offsets, w.ALNUM)
    n_words = np.diff(found.first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    owners, places = [], []
    for size, crcs in enumerate(run_crcs(lower, found, longest), 1):
        within = doc[:len(crcs)] == doc[size - 1:]
        owners.append(doc[:len(crcs)][within])
        places.append((crcs[within] % np.uint32(buckets)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(places), n_words


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches):
            total += np.bincount(text_features(batch.column("text"), longest, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, the same for an id in every run."""
    head = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8]
    return math.floor(-1000 * math.log(-math.log((int(head, 16) + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gains: np.ndarray, longest: int, seed: int) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]):
        gain = shared.value
        for batch in chunks(batches):
            owner, bucket, n_words = text_features(batch.column("text"), longest, len(gain))
            n = batch.num_rows
            weight = np.zeros(n, np.int64)
            np.add.at(weight, owner, gain[bucket])
            ids = batch.column("doc_id").to_pylist()
            drawn = weight + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.bincount(owner, minlength=n)), pa.array(n_words), pa.array(weight),
                 pa.array(drawn)], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.mapInArrow(score, "doc_id long, n_features long, n_words long, weight long, score long")


def ranked(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``rank`` from 1 by score descending, then id, nulls last.

    Ranges of the order are numbered by themselves and lifted by the sizes of
    those before them. Rows alike in score and id are dealt over ranges too.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("tie")]

    def number(batches: Iterator[pa.RecordBatch]):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            table_ = pa.Table.from_batches([batch]).append_column("part", pa.array(np.full(n, part, np.int32)))
            table_ = table_.append_column("place", pa.array(np.arange(at, at + n)))
            at += n
            yield from table_.to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = written_once(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order).drop("tie").mapInArrow(number, f"{fields}, part int, place long"), label)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # one row a range
    before = np.cumsum([0] + [n for _, n in sizes])[:-1]
    offsets = spark.createDataFrame(pd.DataFrame({
        "part": np.array([p for p, _ in sizes], np.int32), "before": before.astype(np.int64)}), "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop(
        "part", "place", "before")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      target_text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
                      least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null if it is not drawn.

    Features are runs of 1 to ``longest`` words.
    """
    docs = texts(docs, id_col, text_col)
    target = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(
        F.col(f"`{target_text_col}`").cast("string"), F.lit("")).alias("text"))
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = written_once(weighted(docs, gains, longest, seed), "importance-scores")
    fit = scored.filter(F.col("n_words") >= least_words)
    take = fit.count() * percent // 100
    placed = ranked(fit, "importance-ranks").withColumn("rank", F.expr(f"if(rank <= {take}, rank, null)"))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 bit by bit over the bytes of a word, as a DuckDB expression of its hexadecimal form.
_CRC_SQL = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(range(1, length(code) + 1, 2),
    lambda i: ('0x' || substr(code, i, 2))::BIGINT)),
  lambda r, b: """ + "STEP8" + """))"""


def _crc_step(register: str, times: int) -> str:
    for _ in range(times):
        register = f"list_transform([{register}], lambda v: xor(v >> 1, 3988292384 * (v & 1)))[1]"
    return register


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS line, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
spread AS (SELECT line, unnest(words) AS word FROM docs),
known AS (SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM spread UNION SELECT word FROM target)),
hashed AS (SELECT word, ({_CRC_SQL.replace("STEP8", _crc_step("xor(r, b)", 8))}) % {BUCKETS} AS bucket FROM known),
s AS (SELECT bucket, count(*) AS n FROM spread JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE
      * ((SELECT count(*) FROM spread) + {BUCKETS})::DOUBLE
      / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT line, sum(gain)::BIGINT AS weight FROM spread JOIN hashed USING (word) JOIN gains USING (bucket)
  GROUP BY line),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (line)),
placed AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (
    PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * fit // 100 THEN place END AS rank FROM placed
"""


@query("op11_importance_sample", ORACLE_SQL)
def op11(spark, sf_dir):
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
