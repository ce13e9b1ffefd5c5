"""What the operators share: session settings, input columns, registration."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import prepare, written_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows that Spark hands a Python task at a time, and the bytes of text a kernel works on at once.
BATCH_ROWS = 2000
CHUNK_BYTES = 2 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The package's settings, with small Arrow batches: texts are long and uneven."""
    prepare(spark)
    # Python workers import this package; where it is not installed they find it beside the driver's
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string`` and nothing else; a null text counts as empty.

    Every operator starts here, so further columns of the input, whatever their
    names, never meet the operator's own.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin over the same tables."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


#: What this Python worker keeps from task to task, by its key: one operator's at a time.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """Something large that an operator makes once per worker; another operator's goes."""
    release(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def release(but: object = None) -> None:
    """Drop what the worker keeps, unless it is ``but``: workers live on from one operator to the next."""
    if _kept and but not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def chunks(batches: Iterable[pa.RecordBatch], text_col: str = "text",
           limit: int = CHUNK_BYTES, keeps: object = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least.

    ``keeps`` is the key of what the operator itself keeps in the worker.
    """
    release(keeps)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text_col))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose texts ``keep`` says yes to; it is given texts, bounded in bytes, nulls as empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts_ = batch.column(at).fill_null("")
            for part in chunks([pa.RecordBatch.from_arrays([texts_, pa.array(range(len(texts_)))], ["text", "row"])]):
                first = part.column("row")[0].as_py()
                yield batch.slice(first, part.num_rows).filter(pa.array(keep(part.column("text"))))

    return docs.mapInArrow(run, docs.schema)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long of its own for every row, the same whenever it is computed.

    The key is the number of the row's file among all files, which the driver
    lists anyway, and the row's place in it. A frame that is not read from files
    is written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = written_once(docs, "keyed")
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "__file long, __path string")
    own = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
    return own.join(F.broadcast(files), "__path").withColumn(
        name, F.shiftleft("__file", 40).bitwiseOR(F.col("__at"))).select(*docs.columns, name)
