"""Push decisions: de-duplication, upgrades and a budget per window.

Only two rows of a ticker can ever be pushed in a window (its first pushable
row, and its first A row after a B), so those two are found by a map-side
combined aggregate and the budget by a limited ranking. No window of the data
is ever walked row by row, and rows of a tier that never pushes, the bulk, are
passed through without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.config import PushRules
from tapeloom.operators.scan import top_rows


def decide_pushes(
    df: DataFrame,
    rules: PushRules,
    window: str = "window_start",
    ticker: str = "ticker",
    tier: str = "tier",
    score: str = "rank_score",
    poll: str = "poll_ts",
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add ``pushed`` and ``push_reason``, a code with the value it turns on.

    ``SENT_BEFORE`` and ``UPGRADE`` name the tier sent earlier in the window,
    ``BUDGET_SPENT`` the window's budget.

    Rows compete in order of poll, then score (NULL last), then ticker, then
    ``ties``; that order must be total for the outcome to be deterministic.
    """
    place = F.struct(
        F.col(poll).alias("poll"),
        (-F.coalesce(F.col(score), F.lit(-1.0))).alias("score"),
        F.col(ticker).alias("ticker"),
        *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)],
    )
    levels = {"A": 3, "B": 2} if rules.tier_b_enabled else {"A": 3}
    is_loud = F.col(tier).isin(*levels)
    level = F.when(F.col(tier) == "A", 3).otherwise(2)
    loud = df.where(is_loud).withColumns({"_level": level, "_place": place})
    firsts = loud.groupBy(window, ticker).agg(
        F.min_by("_level", "_place").alias("first_level"),
        F.min("_place").alias("first_place"),
        F.min(F.when(F.col("_level") == 3, F.col("_place"))).alias("a_place"),
    )
    candidates = firsts.select(
        window, ticker,
        F.explode(F.array_compact(F.array(
            F.struct(F.col("first_place").alias("place"), F.col("first_level").alias("level")),
            F.when(
                (F.col("first_level") == 2) & F.col("a_place").isNotNull(),
                F.struct(F.col("a_place").alias("place"), F.lit(3).alias("level")),
            ),
        ))).alias("c"),
    ).select(window, ticker, "c.*")
    sent = top_rows(candidates, [window], [F.col("place")], rules.max_pushes)
    history = sent.groupBy(window, ticker).agg(
        F.min(F.when(F.col("level") == 2, F.col("place"))).alias("_sent_b"),
        F.min(F.when(F.col("level") == 3, F.col("place"))).alias("_sent_a"),
    )
    seen = loud.join(history, [window, ticker], "left")
    place, level = F.col("_place"), F.col("_level")
    earlier = F.when(F.col("_sent_a") < place, "A").when(F.col("_sent_b") < place, "B")
    earlier_level = F.when(earlier == "A", 3).when(earlier == "B", 2)
    no = F.lit(False)
    pushed = F.coalesce(place == F.col("_sent_a"), no) | F.coalesce(place == F.col("_sent_b"), no)
    reason = (
        F.when(earlier_level >= level, F.concat(F.lit("SENT_BEFORE:"), earlier))
        .when(pushed & earlier.isNotNull(), F.concat(F.lit("UPGRADE:"), earlier))
        .when(pushed, "FIRST")
        .otherwise(f"BUDGET_SPENT:{rules.max_pushes}")
    )
    decided = seen.select(*df.columns, pushed.alias("pushed"), reason.alias("push_reason"))
    quiet = df.where(~is_loud).select(
        *df.columns, no.alias("pushed"),
        F.when(F.col(tier) == "B", "TIER_B_OFF").otherwise("TIER_NOT_SENT").alias("push_reason"))
    return decided.unionByName(quiet)
