"""Every query of the engine by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, more, portable
from .sources.tables import run_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {k: partial(run_sql, text=v) for k, v in (portable.SQL | more.PORTABLE | portable.BETTER).items()} | analytics.QUERIES | more.QUERIES
ORACLE: dict[str, str] = portable.ORACLE | more.PORTABLE_ORACLE | analytics.ORACLE | more.ORACLE
