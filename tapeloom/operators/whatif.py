"""What a threshold change would have caught, and what it would have cost."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.config import PillarThresholds
from tapeloom.functions import rules

Change = Callable[[PillarThresholds], PillarThresholds]


def looser(**changes) -> Change:
    """A variation that replaces some thresholds."""
    return lambda base: replace(base, **changes)


def sweep(records: DataFrame, baseline: PillarThresholds,
          variations: Mapping[str, Change]) -> DataFrame:
    """Seven counts per variation, both the gain and the price, unranked.

    All variations are judged in one pass: a flag per variation is OR-ed over
    the polls of a ticker-day, then every counter is one conditional count.
    """
    def hit(th: PillarThresholds) -> Column:
        return F.bool_or(rules.passes(
            F.col("gap_pct"), F.col("rvol"), F.col("price"), F.col("float_shares"),
            F.col("had_news"), th))

    labels = list(variations)
    flags = [hit(variations[label](baseline)).alias(f"c{i}") for i, label in enumerate(labels)]
    days = records.groupBy("ticker", "date").agg(
        F.bool_or("was_runner").alias("ran"), hit(baseline).alias("base"), *flags)
    ran, base = F.col("ran"), F.col("base")

    def counters(i: int, label: str) -> Column:
        cand = F.col(f"c{i}")
        extra = cand & ~base
        return F.struct(
            F.lit(label).alias("label"),
            F.count_if(ran & cand).alias("runners_caught"),
            F.count_if(ran & ~cand).alias("runners_missed"),
            F.count_if(extra & ran).alias("extra_runners_caught"),
            F.count_if(extra & ran).alias("extra_alerts_that_ran"),
            F.count_if(extra & ~ran).alias("extra_alerts_that_did_not"),
            F.count_if(base).alias("baseline_alerts"),
            F.count_if(cand).alias("candidate_alerts"),
        )

    folded = days.agg(F.array(*[counters(i, x) for i, x in enumerate(labels)]).alias("_all"))
    return folded.select(F.inline("_all")).withColumn("summary", F.concat(
        F.col("label"), F.lit(": +"), F.col("extra_runners_caught").cast("string"),
        F.lit(" runners caught, +"), F.col("extra_alerts_that_did_not").cast("string"),
        F.lit(" extra alerts that did not run")))
