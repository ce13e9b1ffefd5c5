"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters.

Documents are put in ranges of ascending ids, encoded, and written as one file a
range by Spark's ORC writer: ids are run-length encoded integers, every stripe
has row indexes with minima and maxima, and document ids have a Bloom filter
besides. Readers split files at stripes; a filter on ids skips files, stripes
and row groups by metadata alone.

Each row also names its file's place among the files (``part``) and its place in
the file (``row``), so that the stream of all ids can be addressed: a document
starts where the ids of the files before and of the rows before end.

Defined results: a null or empty text has the end id alone; equal document ids
stand next to each other, ordered by text; null ids come first; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tapeloom.llm.base import chunks, query, table, texts
from tapeloom.llm.bpe import vocabulary_path
from tapeloom.llm.presplit import PATTERN, byte_letters
from tapeloom.session import scratch_path, written_once

#: Appended to each document.
END = 2
#: Characters of whole texts on which a worker compares its ids with the library's own.
COMPARED = 1 << 16
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "2000",
}
SCHEMA = "doc_id long, part int, row long, ids array<int>"


class Encoder:
    """The ids that the tokenizers library gives with a byte-level BPE file.

    The library reads the file; its vocabulary then goes to tiktoken, whose merges
    give the same ids several times as fast and as one array. Each worker first
    compares the two on whole texts, and stops if they ever differ.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i
                 for token, i in self.library.get_vocab(with_added_tokens=False).items()
                 if token not in self.special}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.compared = 0

    def encode(self, text: str) -> np.ndarray:
        ids = self.fast.encode_to_numpy(text, allowed_special="all").astype("<i4", copy=False)
        if self.compared < COMPARED and len(text) <= COMPARED:
            self.compared += len(text) + 1
            if ids.tolist() != self.library.encode(text, add_special_tokens=False).ids:
                raise ValueError("the vocabulary's merges give other ids than the tokenizers library")
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = END, id_col: str = "doc_id",
                 text_col: str = "text", options: dict[str, str] | None = None) -> None:
    """Encode the documents and write them to ``path`` in ascending id order.

    Texts, not ids, are shuffled: they are smaller, and finding the ranges then
    costs no encoding.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own, part, row = encoder(vocabulary), TaskContext.get().partitionId(), 0
        stop = np.array([end], "<i4")
        for batch in chunks(batches):
            ids = [own.encode(text) for text in batch.column("text").to_pylist()]
            sizes = [len(a) + 1 for a in ids]
            values = np.concatenate([x for a in ids for x in (a, stop)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(row, row + n)),
                pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values)),
            ], names=["doc_id", "part", "row", "ids"])
            row += n

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**(OPTIONS | (options or {}))).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids``, only those, skipping what metadata rules out."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids before the row, over all files. Expects ``n_tokens``.

    Files are numbered through one at a time on their own; only one total per
    file is summed in one place.
    """
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = files.select(
        "part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    return rows.join(before, "part").withColumn("start", F.col("__before") + F.col("__inside")).drop(
        "__before", "__inside")


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, part, row, n_tokens, ids_crc32`` of rows read from the files."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "part", "row")),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")


@query("op5_token_files")
def op5(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path())
    read = written_once(checksums(read_tokens(spark, path)), "checksums")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
