"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "v17_exposure_report"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorator that registers ``fn(spark, sf_dir)`` under ``name``."""

    def keep(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn

    return keep


def _load() -> None:
    from atrisk.plans import clip_queries, exposure_queries, inventory_queries, landed_queries, merge_queries, perimeter_queries, register_queries, report_queries, rule_queries, scan_queries, snapshot_queries, stateful_queries, whole_report_queries  # noqa: F401  its decorators register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
