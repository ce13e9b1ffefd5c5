"""Sharding along a Hilbert curve, with DataFrame operations only.

Several metadata dimensions are quantised to a few bits each by their quantiles
over all rows, the resulting cells are put in the order of a Hilbert curve, and
the ordered rows are cut into runs of equal length. Rows that are close in all
dimensions land in few shards, so readers can skip shards by any of them.

Defined results: null metadata counts as the smallest value; a null text has no
bytes; equal rows get neighbouring places, in either order; a null document id
sorts first within its cell; an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.llm.base import query, table

#: Bits kept of each dimension; three dimensions make 4,096 cells at most.
BITS = 4
#: A cell is numbered in parts of about so many rows, and in this many parts at least.
PART_ROWS, PARTS = 1 << 16, 256


def ordered_key(column: Column, kind: T.DataType) -> Column:
    """A long that keeps the column's order: numbers as they are, text by its first 7 bytes."""
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0")
        key = F.conv(head, 16, 10).cast("long")
    else:
        key = column.cast("double").cast("long")
    return F.coalesce(key, F.lit(-(1 << 62)))


def quantise(rows: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Replace every key by the number of its quantile cuts that lie below it.

    The cuts come from one aggregate over all rows: ``2**bits - 1`` numbers a key.
    """
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(k, shares, 10_000).alias(k) for k in keys]).first()
    out = {}
    for key in keys:
        level = F.lit(0)
        for cut in sorted(set(cuts[key] or [])):
            level = level + (F.col(key) > cut).cast("int")
        out[key] = level
    return rows.withColumns(out)


def hilbert_index(cells: DataFrame, axes: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """Position of each cell on the Hilbert curve over the given integer axes.

    Works from the highest bit down: a set bit reflects the first axis, a clear
    one swaps it with the axis at hand; then the axes are Gray-coded and their
    bits interleaved.
    """
    x = [f"__x{i}" for i in range(len(axes))]
    cells = cells.withColumns({c: F.col(a).cast("int") for c, a in zip(x, axes)})
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, c in enumerate(x):
            is_set = F.col(c).bitwiseAND(1 << level) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(c)).bitwiseAND(low)
            first = F.when(is_set, F.col(x[0]).bitwiseXOR(F.lit(low)))
            if i == 0:
                cells = cells.withColumn(c, first.otherwise(F.col(c)))
            else:
                cells = cells.withColumns({
                    x[0]: first.otherwise(F.col(x[0]).bitwiseXOR(swap)),
                    c: F.when(is_set, F.col(c)).otherwise(F.col(c).bitwiseXOR(swap)),
                })
    for a, b in zip(x, x[1:]):
        cells = cells.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    flip = F.lit(0)
    for level in range(bits - 1, 0, -1):
        part = F.when(F.col(x[-1]).bitwiseAND(1 << level) != 0, (1 << level) - 1).otherwise(0)
        flip = flip.bitwiseXOR(part)
    cells = cells.withColumn("__flip", flip)
    index = F.lit(0)
    for level in range(bits - 1, -1, -1):
        for c in x:
            bit = F.shiftright(F.col(c).bitwiseXOR(F.col("__flip")), level).bitwiseAND(1)
            index = index * 2 + bit
    return cells.withColumn(name, index.cast("int")).drop(*x, "__flip")


def curve_order(rows: DataFrame, axes: list[str], ties: list[str], bits: int = BITS,
                part_rows: int = PART_ROWS, parts: int = PARTS) -> DataFrame:
    """Adds ``position`` (from 0) of each row along the curve, and ``total``, the number of rows.

    Rows are never sorted in one task: a cell is dealt into parts by a hash of
    the tie columns, each part is numbered on its own, and the parts' counts,
    summed along the curve, give its first position. ``parts`` grows with the
    input, so a cell that holds a third of all rows is numbered by many tasks.
    """
    parts = max(parts, -(-rows.count() // part_rows))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*ties), F.lit(parts)).cast("int"))
    counts = rows.groupBy(*axes, "__part").agg(F.count(F.lit(1)).alias("__n"))
    within = Window.partitionBy(*axes).orderBy("__part")
    counts = counts.withColumn("__before", F.sum("__n").over(within) - F.col("__n"))
    cells = hilbert_index(counts.groupBy(*axes).agg(F.sum("__n").alias("__cell_n")), axes, bits)
    # at most 2**(bits * axes) rows, whatever the input
    along = Window.orderBy("curve")
    cells = cells.select(
        *axes,
        (F.sum("__cell_n").over(along) - F.col("__cell_n")).alias("__cell_before"),
        F.sum("__cell_n").over(Window.partitionBy()).alias("total"),
    )
    first = counts.join(cells, axes).select(
        *axes, "__part", (F.col("__before") + F.col("__cell_before")).alias("__first"), "total")
    numbered = rows.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*axes, "__part").orderBy(*ties)))
    return (numbered.join(first, [*axes, "__part"])
            .withColumn("position", F.col("__first") + F.col("__rank") - 1)
            .drop("__part", "__rank", "__first"))


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
               dimensions: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Shard and slot of every document under the law ``rows``.

    Dimensions are the named columns and the text's size. Shard s holds the
    positions from ``ceil(s * n / shards)``, so counts differ by one at most.
    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    kinds = {f.name: f.dataType for f in docs.schema}
    axes = [f"__axis{i}" for i in range(len(dimensions) + 1)]
    keys = [ordered_key(F.col(f"`{d}`"), kinds[d]).alias(a) for d, a in zip(dimensions, axes)]
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        *keys,
    ).withColumn(axes[-1], F.col("size"))
    placed = curve_order(quantise(rows, axes), axes, ["doc_id", "text_crc32", "size"])
    shard = F.floor(F.col("position") * shards / F.col("total"))
    exact = F.expr(f"(position * {shards}L) div total")
    placed = placed.withColumn("__shard", F.coalesce(exact, shard))
    start = F.expr(f"(__shard * total + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("position") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id",
                 text_col: str = "text", dimensions: tuple[str, ...] = ("source", "lang"),
                 rows_per_file: int = 200_000) -> None:
    """Write the documents as one folder per shard, each in the order of its slots.

    Document ids must be unique here. A shard is cut into files at multiples of
    ``rows_per_file`` slots, so files too are runs of the curve.
    """
    placed = shard_rows(docs, shards, id_col, text_col, dimensions).select(
        F.col("doc_id").alias("__id"), "shard", "slot",
        F.expr(f"slot div {rows_per_file}L").alias("__file"))
    out = docs.drop("shard", "slot").join(placed, F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))).drop("__id")
    # enough buckets that files seldom share a task; a shared one still writes them apart
    (out.repartition("shard", "__file").sortWithinPartitions("shard", "__file", "slot")
     .withColumnRenamed("__file", "run").write.partitionBy("shard", "run").parquet(path))


@query("op10_hilbert_sharding")
def op10(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))
