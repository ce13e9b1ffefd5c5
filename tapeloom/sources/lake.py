"""The lake: date-partitioned Parquet tables under one root.

All paths go through Spark or the Hadoop file system of the session, so a root
on shared storage works the same as a local one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom import contracts
from tapeloom.config import ROW_CAP, RetentionRules
from tapeloom.operators.research import holdout_cutoff
from tapeloom.session import written_once

TARGET_FILE_BYTES = 256 * 1024 * 1024
_SPLIT_AT = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Ends the name of a day that a swap has set aside.
_ASIDE = "-replaced"


def table_path(root: str, table: str) -> str:
    contracts.declared(table)
    return f"{root.rstrip('/')}/{table}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def entries(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder, none if it does not exist."""
    fs, target = _fs(spark, path)
    return {f.getPath().getName() for f in fs.listStatus(target)} if fs.exists(target) else set()


def _swap(spark: SparkSession, fresh: str, current: str) -> None:
    """Move a staged day into place; the old one is removed last.

    A driver lost between the renames leaves the old day set aside; see
    :func:`recover`.
    """
    fs, target = _fs(spark, current)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside = path(f"{fresh}{_ASIDE}")
    if not fs.rename(target, aside):
        raise OSError(f"cannot set {current} aside")
    if not fs.rename(path(fresh), target):
        fs.rename(aside, target)
        raise OSError(f"cannot move {fresh} into place")
    fs.delete(aside, True)


def recover(spark: SparkSession, root: str, table: str) -> list[str]:
    """Finish what a lost job left half done; returns the days put back.

    A day set aside whose place is empty returns to it, then the job's staging
    folder goes. One job at a time may rewrite a table.
    """
    staging = f"{root.rstrip('/')}/_staging"
    if not exists(spark, staging):
        return []
    fs, folder = _fs(spark, staging)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    back = []
    for job in fs.listStatus(folder):
        if not job.getPath().getName().startswith(f"{table}-"):
            continue
        for entry in fs.listStatus(job.getPath()):
            name = entry.getPath().getName()
            if not name.endswith(_ASIDE):
                continue
            day = name[:-len(_ASIDE)]
            target = path(f"{table_path(root, table)}/{day}")
            if not fs.exists(target):
                fs.rename(entry.getPath(), target)
                back.append(day.removeprefix("date="))
        fs.delete(job.getPath(), True)
    return sorted(back)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The whole table; one that was never written reads as empty."""
    path, schema = table_path(root, table), contracts.schema(table)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    columns = [field.name for field in schema]
    return spark.read.schema(schema).parquet(path).select(*columns)


def read_day(spark: SparkSession, root: str, table: str, day: date) -> DataFrame:
    """One day: the filter prunes every other partition."""
    return read_table(spark, root, table).where(F.col("date") == F.lit(day))


def read_days(spark: SparkSession, root: str, table: str, days: Sequence[date]) -> DataFrame:
    """Only the given days; the filter prunes every other partition."""
    return read_table(spark, root, table).where(F.col("date").isin(list(days)))


def stamp(df: DataFrame, source: str) -> DataFrame:
    """Provenance, where the rows do not carry it yet."""
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(source))
    if "schema_version" not in df.columns:
        df = df.withColumn("schema_version", F.lit(contracts.SCHEMA_VERSION))
    return df


def _by_day(df: DataFrame, table: str) -> DataFrame:
    """Rows rebalanced by date: a day lands in few well-sized files, a heavy day is split over several tasks.

    Comes before the contract adds columns, so that those which are NULL or the same in all rows do
    not travel; a bad row still fails before the write begins.
    """
    return contracts.filled(df, table).hint("rebalance", "date")


def _write(df: DataFrame, path: str, mode: str) -> None:
    """Date-partitioned write of rows that :func:`_by_day` or a repartition laid out.

    A rebalanced day is split by its shuffled size, several times that of its
    files: split at Spark's 64 MB it would be small files again, which
    :func:`compact` then has to merge.
    """
    conf = df.sparkSession.conf
    usual = conf.get(_SPLIT_AT)
    conf.set(_SPLIT_AT, str(2 * TARGET_FILE_BYTES))
    try:
        (
            df.write.mode(mode).partitionBy("date")
            .option("compression", "zstd")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(path)
        )
    finally:
        conf.set(_SPLIT_AT, usual)


def append(df: DataFrame, root: str, table: str, source: str) -> None:
    """Checked append. A bad row fails the job before anything is committed."""
    _write(contracts.conform(stamp(_by_day(df, table), source), table), table_path(root, table), "append")


def replace_days(df: DataFrame, root: str, table: str, source: str) -> None:
    """Re-running a day replaces it: days present in ``df`` are swapped whole.

    The dynamic overwrite stages the new rows and swaps at commit, so ``df``
    may read the very partitions it replaces, and a failed job changes nothing.
    """
    _write(contracts.conform(stamp(_by_day(df, table), source), table), table_path(root, table), "overwrite")


def set_days(df: DataFrame, root: str, table: str, days: Sequence[date], source: str) -> None:
    """Make the given days hold exactly ``df``: a day without rows is removed.

    Rows of other days are an error. A day whose files are the same afterwards
    got no rows, so ``df`` runs once and only those folders are listed. For
    tables whose days are results of a job; see :func:`rewrite_days` for
    collected ones.
    """
    spark, path = df.sparkSession, table_path(root, table)
    stray = F.raise_error(F.concat(F.lit(f"{table}: a row of a day not asked for: "), F.col("date").cast("string")))
    checked = df.withColumn("date", F.when(F.col("date").isin(list(days)), F.col("date")).otherwise(stray))
    before = {day: entries(spark, f"{path}/date={day}") for day in days}
    replace_days(checked, root, table, source)
    for day in sorted(before):
        if before[day] and entries(spark, f"{path}/date={day}") == before[day]:
            _delete(spark, f"{path}/date={day}")


def rewrite_days(df: DataFrame, root: str, table: str, days: Sequence[date], source: str) -> None:
    """:func:`set_days` for a table that holds what cannot be fetched again."""
    contracts.refuse_protected(table)
    set_days(df, root, table, days, source)


def files(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``(date, path, bytes)`` per file, from the listing alone."""
    path = table_path(root, table)
    if not exists(spark, path):
        return spark.createDataFrame([], "date date, path string, bytes bigint")
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "false").load(path)
    )
    return listed.select(
        F.col("date").cast("date").alias("date"), "path", F.col("length").alias("bytes"))


def coverage(spark: SparkSession, root: str) -> DataFrame:
    """Size, days and first and last day of every declared table."""
    out = None
    for table in sorted(contracts.TABLES):
        one = files(spark, root, table).agg(
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
            F.count_distinct("date").alias("days"),
            F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        ).withColumn("table_name", F.lit(table))
        out = one if out is None else out.unionByName(one)
    return out


def row_counts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows per day; no column is read."""
    return read_table(spark, root, table).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def compact(spark: SparkSession, root: str, table: str,
            target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Merge the small files of every day that has several, all in one job.

    A day becomes one file, or as many files of ``target_bytes`` as its size
    needs, so a large day is never forced through one task. Counts are
    verified on the staged copy before the swap. Returns files before and
    planned per day.
    """
    sizes = files(spark, root, table).groupBy("date").agg(
        F.count(F.lit(1)).alias("files_before"), F.sum("bytes").alias("bytes"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)).cast("int")
    plan = sizes.withColumn("files_after", wanted).where(
        F.col("files_before") > F.col("files_after"))
    recover(spark, root, table)
    plan = written_once(plan, f"plan-{table}")
    total = plan.agg(F.coalesce(F.sum("files_after"), F.lit(0))).first()[0]
    if not total:
        return plan.select("date", "files_before", "files_after", F.lit(0).cast("long").alias("rows"))
    target = table_path(root, table)
    staging = f"{root.rstrip('/')}/_staging/{table}-{uuid.uuid4().hex}"
    rows = read_table(spark, root, table)
    key = [c for c, _k, required in contracts.declared(table) if required and c != "date"]
    spread = rows.join(plan.select("date", "files_after"), "date").withColumn(
        "_file", F.pmod(F.xxhash64(*key), F.col("files_after")))
    columns = [f.name for f in contracts.schema(table)]
    laid_out = spread.repartition(int(total), "date", "_file").select(*columns)
    _write(laid_out, staging, "overwrite")
    staged = spark.read.schema(contracts.schema(table)).parquet(staging)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("date").agg(F.count(F.lit(1)).alias(name))

    before = counted(rows.join(plan.select("date"), "date", "left_semi"), "rows")
    check = before.join(counted(staged, "staged"), "date", "full_outer")
    check = written_once(check, f"check-{table}")
    lost = check.where(~F.col("rows").eqNullSafe(F.col("staged"))).limit(1).collect()
    if lost:
        raise contracts.SchemaDrift(f"{table}: compaction would change {lost[0]}")
    for row in plan.select("date").toLocalIterator():
        _swap(spark, f"{staging}/date={row['date']}", f"{target}/date={row['date']}")
    _delete(spark, staging)
    return plan.join(check, "date").select("date", "files_before", "files_after", "rows")


def drop_days(spark: SparkSession, root: str, table: str, cutoff: Column) -> DataFrame:
    """Remove whole days before ``cutoff``; returns what each of them held."""
    contracts.refuse_protected(table)
    old = row_counts(spark, root, table).where(F.col("date") < cutoff).select(
        F.lit(table).alias("table_name"), "date", F.col("rows").alias("rows_before"),
        F.lit(0).cast("long").alias("rows_after"))
    report = written_once(old, f"dropped-{table}")
    for row in report.select("date").toLocalIterator():
        _delete(spark, f"{table_path(root, table)}/date={row['date']}")
    return report


def register_views(spark: SparkSession, root: str, cutoff: Column | None = None) -> list[str]:
    """A view per table that exists, days from ``cutoff`` on hidden."""
    names = []
    for table in sorted(contracts.TABLES):
        if not exists(spark, table_path(root, table)):
            continue
        rows = read_table(spark, root, table)
        if cutoff is not None:
            rows = rows.where(F.col("date") < cutoff)
        rows.createOrReplaceTempView(table)
        names.append(table)
    return names


def run_sql(spark: SparkSession, root: str, sql: str, row_cap: int | None = None,
            holdout: str | None = None, fraction: float = 0.30,
            allow_holdout: bool = False) -> DataFrame:
    """Read-only SQL over the lake views.

    The statement runs as a subquery, which only a query can be. ``holdout``
    names the table whose collected days define the held-back slice. All rows
    come back unless a cap is given; see :func:`capped` for telling whether one
    was reached.
    """
    cutoff = None
    if holdout is not None and not allow_holdout:
        cutoff = holdout_cutoff(read_table(spark, root, holdout), fraction).scalar()
    if not register_views(spark, root, cutoff):
        raise LookupError("the lake is empty")
    rows = spark.sql(f"SELECT * FROM ({sql.strip().rstrip(';')}) AS q")
    return rows if row_cap is None else rows.limit(int(row_cap))


class Capped(NamedTuple):
    rows: DataFrame
    truncated: bool


def capped(spark: SparkSession, root: str, sql: str, row_cap: int = ROW_CAP, **guard) -> Capped:
    """At most ``row_cap`` rows, and whether the answer has more."""
    return Capped(run_sql(spark, root, sql, row_cap, **guard),
                  not run_sql(spark, root, sql, **guard).offset(int(row_cap)).isEmpty())


def to_csv(df: DataFrame, path: str) -> None:
    """All rows as CSV files with a header, written by as many tasks as hold them."""
    df.write.option("header", True).csv(path)


def size_warning(sizes: DataFrame, rules: RetentionRules) -> DataFrame:
    """``(total_gb, limit_gb, used_share, largest)`` once the lake nears its limit, no row before that.

    ``sizes`` is ``(table_name, size_bytes)``, one row per declared table;
    ``largest`` names the three largest, the largest first.
    """
    gib = 1024.0**3
    limit = rules.max_lake_gb * gib
    folded = sizes.agg(
        F.sum("size_bytes").alias("total"),
        F.slice(F.sort_array(F.collect_list(F.struct("size_bytes", "table_name")), asc=False), 1, 3).alias("top"))
    return folded.where(F.col("total") >= limit * rules.warn_fraction).select(
        (F.col("total") / gib).alias("total_gb"), F.lit(float(rules.max_lake_gb)).alias("limit_gb"),
        (F.col("total") / limit).alias("used_share"), F.transform("top", lambda x: x["table_name"]).alias("largest"))
