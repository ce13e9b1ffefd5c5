"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item is its multiset of five-word shingles (its whole sequence if it
has fewer words). A document is contaminated by an item if a window of it, as
long as the item, has a weighted Jaccard similarity (sum of minima over sum of
maxima of the shingles' counts) of at least 0.75 with it. A document shorter than
the item is the one window itself.

Windows that can reach this hold enough shingles of the benchmark at all, which
one running count per document shows; those get a 64-bit SimHash. Fingerprints
are cut into 21 blocks of 3 bits: two that differ in at most 20 bits agree in a
block, so a look-up per block finds all items within that radius. Candidates are
then compared exactly. At a similarity of 0.75 two fingerprints differ in 11 bits
on average, with a deviation of 3, so the radius lies three deviations beyond. A document shorter than
an item of which it holds enough is compared with it exactly, without fingerprints.

The benchmark is a stated set of bounded blocks: one block of items at a time is
read, sent to all tasks and given up again, and the documents are read once per
block, so neither driver nor task holds more than one.

Defined results: a null or empty text and an item without words match nothing;
equal items are reported under each of their ids; equal documents get equal
results; a null item id is skipped; an empty benchmark contaminates nothing; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import words as w
from tapeloom.llm.base import chunks, kept_rows, query, table, texts, utf8
from tapeloom.session import written_once

SIMILARITY = 0.75
BITS, BLOCK_BITS = 64, 3
BLOCKS = BITS // BLOCK_BITS
#: Fingerprints within so many bits are guaranteed to share a block.
RADIUS = BLOCKS - 1
#: Bytes of item texts in a block of the benchmark.
BLOCK_BYTES = 4 << 20


class Items(NamedTuple):
    """A block of benchmark items."""

    ids: list[int]
    #: sorted distinct shingles of each item and their counts
    shingles: list[np.ndarray]
    counts: list[np.ndarray]
    lengths: np.ndarray
    prints: np.ndarray
    #: all shingles of the block, sorted, and for each the items that hold it with their counts
    known: np.ndarray
    first: np.ndarray
    post_item: np.ndarray
    post_count: np.ndarray
    #: per block of bits and value: the items
    blocks: list[list[np.ndarray]]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums to 64-bit numbers."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def signs(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's 64 bits as +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(w.mix(shingles)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def pieces(prints: np.ndarray) -> np.ndarray:
    """The value of every block of bits."""
    return (prints[:, None] >> np.arange(0, BLOCKS * BLOCK_BITS, BLOCK_BITS, dtype=np.uint64)) & np.uint64(
        (1 << BLOCK_BITS) - 1)


def text_shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, five-word runs and word bounds of a column of texts."""
    data, offsets = utf8(column)
    lower = w.LOWER[data]
    found = w.find_words(lower, offsets, w.ALNUM)
    hashes = w.hash_words(lower, found)
    return hashes, w.hash_runs(hashes), found.first


def index_items(ids: list[int], item_texts: list[str]) -> Items | None:
    hashes, runs, first = text_shingles(pa.array(item_texts, pa.string()))
    kept, sets, counts, lengths, sums = [], [], [], [], []
    for d, i in enumerate(ids):
        own = w.shingles(runs, hashes, first[d], first[d + 1])
        if not len(own):
            continue
        distinct, n = np.unique(own, return_counts=True)
        kept.append(i)
        sets.append(distinct)
        counts.append(n)
        # an item with fewer words than a shingle is met by windows of its own number of words
        lengths.append(len(own) if first[d + 1] - first[d] >= w.SHINGLE else int(first[d] - first[d + 1]))
        sums.append(signs(own).sum(axis=0))
    if not kept:
        return None
    prints = fingerprints(np.stack(sums))
    values = pieces(prints)
    blocks = [[np.flatnonzero(values[:, b] == v) for v in range(1 << BLOCK_BITS)] for b in range(BLOCKS)]
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    known, start = np.unique(shingle[order], return_index=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    return Items(kept, sets, counts, np.array(lengths), prints, known, np.append(start, len(shingle)), owner,
                 np.concatenate(counts)[order], blocks)


def possible_items(held: np.ndarray, size: int, items: Items, need: float) -> np.ndarray:
    """Items of which a text of ``size`` shingles holds enough; ``held``: places in ``known`` of its shingles."""
    held = np.unique(held)
    n = items.first[held + 1] - items.first[held]
    post = np.repeat(items.first[held] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    common = np.bincount(items.post_item[post], items.post_count[post], len(items.lengths))
    # a window is as long as its item, or the whole text if that is shorter
    least = need / (1 + need) * (items.lengths + np.minimum(items.lengths, size))
    return np.flatnonzero((items.lengths > 0) & (common >= least - 1e-9))


def near(prints: np.ndarray, which: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (window, item) of equal length whose fingerprints are within the radius.

    ``which`` marks the items of the windows' length.
    """
    values = pieces(prints)
    found = []
    for b in range(BLOCKS):
        for v in np.unique(values[:, b]):
            group = items.blocks[b][int(v)]
            group = group[which[group]]
            if len(group):
                rows = np.flatnonzero(values[:, b] == v)
                found.append((np.repeat(rows, len(group)) * len(which) + np.tile(group, len(rows))))
    if not found:
        none = np.empty(0, np.int64)
        return none, none
    pairs = np.unique(np.concatenate(found))
    window, item = pairs // len(which), pairs % len(which)
    close = np.bitwise_count(prints[window] ^ items.prints[item]) <= RADIUS
    return window[close], item[close]


def similarity(window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item."""
    own, n = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
    both = shingles[at] == own
    common = int(np.minimum(n[both], counts[at[both]]).sum())
    return common / (len(window) + int(counts.sum()) - common)


def matches(own: np.ndarray, hits: np.ndarray, length: int, items: Items, need: float) -> dict[int, float]:
    """Best similarity per item among the windows of ``length`` shingles of one text, which has as many."""
    so_far = np.append(0, np.cumsum(hits))
    held = so_far[length:] - so_far[:-length]
    # similar windows share at least this many shingles with their item
    starts = np.flatnonzero(held >= math.ceil(2 * need / (1 + need) * length - 1e-9))
    best: dict[int, float] = {}
    # stretches of a long text, so that their sums stay small
    for part in np.split(starts, np.flatnonzero(np.diff(starts // 4096)) + 1) if len(starts) else ():
        low = part[0]
        sums = np.zeros((part[-1] + length - low + 1, BITS), np.int32)
        np.cumsum(signs(own[low:part[-1] + length]), axis=0, out=sums[1:])
        prints = fingerprints(sums[part - low + length] - sums[part - low])
        for window, item in zip(*near(prints, items.lengths == length, items)):
            start = part[window]
            value = similarity(own[start:start + length], items.shingles[item], items.counts[item])
            if value >= need and value > best.get(int(item), 0.0):
                best[int(item)] = value
    return best


def whole_matches(own: np.ndarray, possible: np.ndarray, items: Items, need: float) -> dict[int, float]:
    """Those of the ``possible`` items, all longer than the text, that the whole text is similar to."""
    found = ((int(item), similarity(own, items.shingles[item], items.counts[item])) for item in possible)
    return {item: value for item, value in found if value >= need}


def short_matches(text: np.ndarray, items: Items) -> dict[int, float]:
    """Items with fewer words than a shingle: their whole sequence stands in the text."""
    best = {}
    for length in np.unique(items.lengths[items.lengths < 0]):
        if len(text) >= -length:
            present = w.hash_runs(text, int(-length))
            for item in np.flatnonzero(items.lengths == length):
                if (present == items.shingles[item][0]).any():
                    best[int(item)] = 1.0
    return best


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark's items, indexed in blocks of about ``block_bytes`` of text, one at a time."""
    items = texts(benchmark, id_col, text_col).filter("doc_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).orderBy("doc_id", "text").collect()
        found = index_items([r["doc_id"] for r in rows], [r["text"] for r in rows])
        if found is not None:
            yield found


def held_items(column, items: Items, need: float) -> list[dict[int, float]]:
    """Per text the ids of the items it holds, each with its best similarity."""
    hashes, runs, first = text_shingles(column)
    at = np.minimum(np.searchsorted(items.known, runs), len(items.known) - 1)
    hit = items.known[at] == runs
    short = (items.lengths < 0).any()
    before = np.append(0, np.cumsum(hit))
    found: list[dict[int, float]] = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        best = short_matches(hashes[low:high], items) if short else {}
        end = high - w.SHINGLE + 1
        if end > low and before[end] > before[low]:
            own, own_hit = runs[low:end], hit[low:end]
            possible = possible_items(at[low:end][own_hit], end - low, items, need)
            longer = items.lengths[possible] > end - low
            best |= whole_matches(own, possible[longer], items, need)
            for length in np.unique(items.lengths[possible[~longer]]):
                best |= matches(own, own_hit, int(length), items, need)
        named: dict[int, float] = {}
        for item, value in best.items():
            named[items.ids[item]] = max(value, named.get(items.ids[item], 0.0))
        found.append(named)
    return found


def block_by_block(rows: DataFrame, blocks: Iterator[Items], scan) -> DataFrame:
    """``scan(rows, block)`` over every block; one block is in memory and sent at a time.

    All passes but the last are written, so that a block is done with before the next comes.
    """
    context, last = rows.sparkSession.sparkContext, None
    for block in blocks:
        if last is not None:
            rows = written_once(scan(rows, last), "decontamination")
            last.destroy()
        last = context.broadcast(block)
    return rows if last is None else scan(rows, last)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text",
                 need: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, similarity`` of every document.

    ``item_ids`` lists the matched items in ascending order; ``similarity`` is
    the best one, 0 if none.
    """

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in chunks(batches):
                found = held_items(batch.column("text"), shared.value, need)
                ids = [sorted({*old, *new}) for old, new in zip(batch.column("item_ids").to_pylist(), found)]
                best = np.maximum(batch.column("similarity").to_numpy(zero_copy_only=False),
                                  [max(f.values(), default=0.0) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int64())), pa.array(best)],
                    names=["doc_id", "text", "item_ids", "similarity"])

        return rows.mapInArrow(run, "doc_id long, text string, item_ids array<long>, similarity double")

    rows = texts(docs, id_col, text_col).withColumn("item_ids", F.array().cast("array<long>")).withColumn(
        "similarity", F.lit(0.0))
    out = block_by_block(rows, item_blocks(benchmark, item_id_col, item_text_col, block_bytes), scan)
    return out.select(
        "doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"),
        "item_ids", "similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text", need: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that hold no item; a row is judged by its own text, whatever its id."""

    def scan(rows: DataFrame, shared) -> DataFrame:
        return kept_rows(rows, lambda column: np.array([not f for f in held_items(column, shared.value, need)], bool),
                         text_col)

    return block_by_block(docs, item_blocks(benchmark, item_id_col, item_text_col, block_bytes), scan)


@query("op3_decontamination")
def op3(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
