"""Registered queries, each beside its SQL twin."""

from tapeloom.suite import q_asof, q_bars, q_lake, q_nightly, q_plans, q_rules, q_runners, q_streaming  # noqa: F401
from tapeloom.suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
