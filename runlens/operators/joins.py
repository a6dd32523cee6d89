"""Look-ups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that may go to one part, and how many keys may be split at most.
PART_ROWS = 1_000_000
MOST_SPLIT = 10_000


def _part(spread: str, parts: Column) -> Column:
    """Part of a row. A hash, unlike a random number, is the same when a task runs again."""
    return F.pmod(F.xxhash64(spread), parts)


def split_lookup(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: str,
    rows: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Left join ``facts`` to a table with one row per key, keys of many rows split up.

    Rows are counted per key, and a key goes to as many parts as ``part_rows`` fits into its
    count. Facts are spread over the parts of their key by ``spread``, a column that differs within
    a key, and only the table rows of split keys are repeated, once per part. Facts without
    a key match nothing and are spread like a key of their own.

    ``rows`` is a column of the table with the number of facts per key (the null key
    included), where that is known already. So that the list of split keys may be broadcast, a key is only
    split if it also holds more than 1/``MOST_SPLIT`` of all rows, which as many keys can do at most.
    """
    on = list(on)
    counts = table.select(*on, F.col(rows).alias("_count")) if rows else facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_count"))
    total = counts.agg(F.sum("_count")).scalar()
    limit = F.greatest(F.lit(part_rows).cast("double"), total / MOST_SPLIT)
    many = counts.where(F.col("_count") > limit).select(
        *[F.col(key).alias(f"_split_{key}") for key in on], F.ceil(F.col("_count") / limit).cast("bigint").alias("_parts")
    )
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_split_{key}")) for key in on])
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    left = facts.join(F.broadcast(many), same, "left").select(*facts.columns, _part(spread, parts).alias("_part"))
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_part")
    right = table.drop(rows) if rows else table
    right = right.join(F.broadcast(many), same, "left").select(*right.columns, numbers)
    return left.join(right, [*on, "_part"], "left").drop("_part")
