"""Registered queries: each pairs a Spark plan with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from functools import cache

from plantscope.plans.registry import Query

SECTIONS: tuple[str, ...] = (
    "control_charts",
    "anomalies",
    "tables",
    "frames",
    "timeseries",
    "distributions",
    "models",
    "forecast",
)


@cache
def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for section in SECTIONS:
        for query in importlib.import_module(f"plantscope.plans.{section}").QUERIES:
            if query.name in out:
                raise ValueError(f"duplicate query {query.name}")
            out[query.name] = query
    return out
