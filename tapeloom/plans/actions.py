"""Corporate actions job: record the day's actions, drop stale baselines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import baseline, integrity
from tapeloom.sources import feeds, lake


class ActionsDone(NamedTuple):
    rejected: DataFrame
    affected: DataFrame
    baselines: DataFrame
    payloads: DataFrame


def run_actions(payloads: DataFrame, root: str, stored_baselines: DataFrame, day: Column,
                now: Column) -> ActionsDone:
    """Append the parsed actions and invalidate the baselines splits touched.

    Runs before any move metric of the day, so that a split is known first.
    """
    records = feeds.action_records(payloads)
    actions = feeds.valid_actions(records)
    lake.append(feeds.action_rows(actions, day, now), root, "corporate_actions", "actions_feed")
    affected = integrity.baselines_to_recompute(actions)
    kept = baseline.invalidate(stored_baselines, affected)
    return ActionsDone(records.where(~F.col("valid")), affected, kept, feeds.payload_counts(payloads, "actions"))
