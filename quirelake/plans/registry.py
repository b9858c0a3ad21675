"""Every registered query of the library proper, with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.plans import analytics, extensions, parity, service, streams

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return parity.QUERIES | service.QUERIES | extensions.QUERIES | streams.QUERIES | analytics.QUERIES


def all_oracles() -> dict[str, str]:
    return parity.ORACLES | service.ORACLES | extensions.ORACLES | streams.ORACLES | analytics.ORACLES
