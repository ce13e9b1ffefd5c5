"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal if they are the same bytes after every space, tab, line feed,
vertical tab, form feed and carriage return is deleted.

1. Every task folds the copies it reads itself into entries: the text once, the
   ids of its rows, and which of them is best. Entries go to shared files under
   the first 64 bits of the text's SHA-256. So a text that a third of all rows
   hold arrives as one entry per flush of a task.
2. A directory maps the leading bits of keys to buckets. It starts with as many
   bits as the entries' bytes ask for and doubles (takes in one more bit) while a
   bucket holds more than its capacity; only overfull buckets are split, the
   others are shared by both halves of the doubled directory. A bucket of a
   single key cannot be split and is chained.
3. Owner tasks take ranges of keys, read their entries in key order, and chain
   the different texts of one key by comparing bytes. They hold one key's chain
   at a time and give each entry its group.
4. Groups go back to rows by entry, so no group is ever gathered.

Defined results: null and empty texts are equal to each other and to texts of
white space alone; of equal texts the longest original (code points) stays, then
the smallest id, nulls last; of rows repeated whole one stays; a group without
any id keeps a null one; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import chunks, query, table, texts
from tapeloom.session import written_once

#: What normalising deletes.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of texts that a bucket holds; more only where that many buckets would pass ``BUCKETS``.
CAPACITY = 8 << 20
#: Bounds the directory: buckets are made larger before there are more of them.
BUCKETS = 1 << 20
#: Bits of the directory at most; keys alike in so many stay in one bucket, chained.
DEPTH = 22
#: Owner tasks at most; each then takes a longer range of buckets.
OWNERS = 1 << 14
#: A task hands on its entries once they hold so many bytes of text or so many rows.
FLUSH_BYTES, FLUSH_ROWS = 32 << 20, 1 << 17
#: Bytes of text in a batch that goes back to Spark.
BATCH_BYTES = 4 << 20

ENTRY = ("entry_id long, key long, sha string, size long, n long, best_length long, best_id long, best_at int, "
         "ids array<long>, text binary")


def fold_copies(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """One entry per different text of each flush of a task; see ``ENTRY``."""

    def fold(batches: Iterator[pa.RecordBatch]):
        # entries are written once and read from there, so a task that is run again may number them anew
        number = TaskContext.get().partitionId() << 33
        held: dict[bytes, list] = {}
        size = rows = 0
        for batch in chunks(batches):
            column = batch.column("text")
            lengths = pc.utf8_length(column).to_pylist()
            raw = column.cast(pa.large_binary()).to_pylist()
            for doc_id, length, data in zip(batch.column("doc_id").to_pylist(), lengths, raw):
                text = data.translate(None, WHITE)
                entry = held.get(text)
                if entry is None:
                    held[text] = [length, doc_id, 0, [doc_id]]
                    size += len(text)
                else:
                    if better(length, doc_id, entry[0], entry[1]):
                        entry[:3] = length, doc_id, len(entry[3])
                    entry[3].append(doc_id)
                rows += 1
                if size > FLUSH_BYTES or rows > FLUSH_ROWS:
                    for out in entry_batches(held, number, key_bits):
                        yield out
                    number += len(held)
                    held, size, rows = {}, 0, 0
        yield from entry_batches(held, number, key_bits)

    return docs.mapInArrow(fold, ENTRY)


def better(length: int, doc_id: int | None, than_length: int, than_id: int | None) -> bool:
    """Whether a row stays rather than another one: longer, then smaller id, nulls last."""
    if length != than_length:
        return length > than_length
    return doc_id is not None and (than_id is None or doc_id < than_id)


def entry_batches(held: dict[bytes, list], number: int, key_bits: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for k, (text, (length, doc_id, at, ids)) in enumerate(held.items()):
        digest = hashlib.sha256(text)
        key = int.from_bytes(digest.digest()[:8], "big") >> (64 - key_bits) << (64 - key_bits)
        rows.append((number + k, key - (key >> 63 << 64), digest.hexdigest(), len(text), len(ids), length, doc_id, at,
                     ids, text))
        size += len(text) + 8 * len(ids)
        if size > BATCH_BYTES:
            yield as_batch(rows)
            rows, size = [], 0
    if rows:
        yield as_batch(rows)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
             pa.list_(pa.int64()), pa.binary()]
    names = [field.split()[0] for field in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def grow_directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[list[tuple[int, int]], int]:
    """Buckets as (prefix, bits) in the order of keys, and the directory's bits.

    ``keys`` has ``key, size``. Each doubling counts the halves of overfull
    buckets only.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    capacity = max(capacity, -(-total // BUCKETS))
    depth = min(DEPTH, max(1, math.ceil(math.log2(max(total / capacity, 1)))))
    buckets, rows = [], keys
    while True:
        found = rows.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).agg(
            F.sum("size").alias("size"), (F.min("key") < F.max("key")).alias("several")).collect()
        full = [r["prefix"] for r in found if r["size"] > capacity and r["several"] and depth < DEPTH]
        split = set(full)
        buckets += [(r["prefix"], depth) for r in found if r["prefix"] not in split]
        if not full:
            return sorted(buckets, key=lambda b: b[0] << (64 - b[1])), depth
        parents = keys.sparkSession.createDataFrame(pd.DataFrame({"parent": np.array(full, np.int64)}))
        rows = keys.join(parents, F.shiftrightunsigned("key", 64 - depth) == F.col("parent"), "left_semi")
        depth += 1


def directory_slots(buckets: list[tuple[int, int]], depth: int) -> pd.DataFrame:
    """``slot, bucket``: each bucket stands in all slots that begin with its prefix."""
    prefix = np.array([b[0] for b in buckets], np.int64)
    spare = depth - np.array([b[1] for b in buckets], np.int64)
    copies = np.left_shift(np.int64(1), spare)
    bucket = np.repeat(np.arange(len(buckets)), copies)
    first = np.cumsum(copies) - copies
    slot = (prefix << spare)[bucket] + np.arange(len(bucket)) - first[bucket]
    return pd.DataFrame({"slot": slot, "bucket": bucket.astype(np.int64)})


def resolve_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in key order to ``entry_id, keep_entry, keep_at, keep_id, group_size``."""
    done: list[tuple] = []
    key, chain = None, []  # of each different text: text, entries, rows, best length, id, entry and place

    def close():
        for _, members, n, _, keep_id, keep_entry, keep_at in chain:
            done.extend((entry_id, keep_entry, keep_at, keep_id, n) for entry_id in members)

    def emit():
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
            names=["entry_id", "keep_entry", "keep_at", "keep_id", "group_size"])

    for batch in batches:
        named = [batch.column(c).to_pylist() for c in
                 ("entry_id", "key", "n", "best_length", "best_id", "best_at")]
        bodies = batch.column("text")
        for i, (entry_id, own, n, length, doc_id, at) in enumerate(zip(*named)):
            if own != key:
                close()
                key, chain = own, []
                if len(done) >= 20_000:
                    yield emit()
            text = bodies[i].as_py()
            link = next((c for c in chain if c[0] == text), None)
            if link is None:
                chain.append([text, [entry_id], n, length, doc_id, entry_id, at])
                continue
            link[1].append(entry_id)
            link[2] += n
            if better(length, doc_id, link[3], link[4]):
                link[3:] = length, doc_id, entry_id, at
    close()
    if done:
        yield emit()


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 key_bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    ``key_bits`` below 64 makes keys collide, which only lengthens chains.
    """
    entries = written_once(fold_copies(texts(docs, id_col, text_col), key_bits), "copies-entries")
    spark = entries.sparkSession
    buckets, depth = grow_directory(entries.select("key", F.greatest("size", F.lit(1)).alias("size")), capacity)
    slots = directory_slots(buckets, depth) if buckets else pd.DataFrame({"slot": [0], "bucket": [0]})
    directory = written_once(spark.createDataFrame(slots), "copies-directory")
    owners = max(1, min(OWNERS, len(buckets)))
    # at most 2**DEPTH slots of two numbers, whatever the input
    placed = entries.select("entry_id", "key", "n", "best_length", "best_id", "best_at", "text").join(
        F.broadcast(directory), F.shiftrightunsigned("key", 64 - depth) == directory["slot"]
    ).withColumn("owner", F.expr(f"cast(bucket * {owners} div {max(1, len(buckets))} AS int)"))
    groups = written_once(
        placed.repartitionById(owners, F.col("owner")).sortWithinPartitions("key", "entry_id")
        .select("entry_id", "key", "n", "best_length", "best_id", "best_at", "text")
        .mapInArrow(resolve_chains, "entry_id long, keep_entry long, keep_at int, keep_id long, group_size long"),
        "copies-groups")
    found = entries.select("entry_id", "sha", "ids").join(groups, "entry_id")
    return found.select(
        "entry_id", "sha", "keep_entry", "keep_at", "keep_id", "group_size", F.posexplode("ids").alias("at", "doc_id")
    ).select(
        "doc_id", "keep_id", "group_size",
        ((F.col("entry_id") == F.col("keep_entry")) & (F.col("at") == F.col("keep_at"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


@query("op12_exact_copies", r"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) AS long_as,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
ranked AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER best AS keep_id,
         row_number() OVER best = 1 AS kept,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM plain
  WINDOW best AS (PARTITION BY body ORDER BY long_as DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
""")
def op12(spark, sf_dir):
    return exact_copies(table(spark, sf_dir, "documents"))
