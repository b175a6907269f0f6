"""The registered queries of the library: its operators bound to the test tables, each with SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bound_context, bound_detection, bound_mechanisms, bound_models, bound_molding, bound_reports, bound_series, bound_status, bound_stream, bound_tables

BINDINGS = (bound_context, bound_series, bound_reports, bound_detection, bound_mechanisms, bound_models, bound_molding, bound_status, bound_stream, bound_tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in BINDINGS for name, f in m.BOUND.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in BINDINGS for name, sql in m.BOUND.sql.items()}
