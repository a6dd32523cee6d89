"""The list of queries: each name with its Spark job and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workload.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of its name, checked by ``sql`` if given."""

    def register(job: Query) -> Query:
        QUERIES[job.__name__] = job
        if sql is not None:
            CHECKS[job.__name__] = with_views(sql)
        return job

    return register


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order in the last digits."""
    return frame.select(
        *[
            F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
            for c in frame.schema.fields
        ]
    )
