"""Scratch space: shared where executors are apart, gone once used up."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tapeloom import session
from tapeloom.operators.bars import build_bars
from tapeloom.sources import adapters as src


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        apart = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default),
                                sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.scratch_root(apart)


def test_scope_deletes_what_was_written(spark):
    with session.scratch_scope(spark):
        rows = session.written_once(spark.range(5).withColumn("x", F.lit(1)), "scoped")
        path = Path(rows.inputFiles()[0].removeprefix("file://")).parent
        assert rows.count() == 5 and path.exists()
    assert not path.exists()


def test_bars_are_hashed_not_sorted(spark, sf):
    plan = build_bars(src.ticks(spark, sf), 15)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
