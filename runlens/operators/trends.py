"""Scores over time: recent runs and the trend between the halves of a history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import is_completed
from runlens.sources.logs import seq_chunk

# --- fixed values -----------------------------------------------------------
RECENT_EVALUATIONS = 10
RECENT_RUNS = 5
MIN_RUNS_FOR_HISTORY = 2
MIN_RUNS_FOR_TREND = 3
# ----------------------------------------------------------------------------

# Scores as exact numbers, whose sums do not depend on their order, and sums of them. A sum
# times half the number of runs (up to 10**11) still fits into 38 digits.
SCORE, SUM, RUNS = "decimal(16,12)", "decimal(26,12)", "decimal(11,0)"


def _completed(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Completed runs with their sort key; a missing time sorts first, a missing score is 0."""
    return runs.where(is_completed(F.col("evaluation_status"))).select(
        *by,
        F.coalesce("timestamp", F.lit("")).alias("at"),
        "seq",
        F.coalesce("evaluation_score", F.lit(0.0)).alias("score"),
        F.coalesce("num_instances", F.lit(0)).alias("instances"),
        F.substring(F.coalesce("timestamp", F.lit("Unknown")), 1, 10).alias("date"),
    )


def recent_evaluations(
    runs: DataFrame, by: Sequence[str] = (), n: int = RECENT_EVALUATIONS
) -> DataFrame:
    """The last ``n`` completed runs in time order, per group if asked.

    Groups with fewer than two completed runs give no rows. Spark applies the limit
    inside each input partition first, so large groups shrink before the shuffle.
    """
    done = _completed(runs, by)
    newest_first = [F.col("at").desc(), F.col("seq").desc()]
    if by:
        ranked = done.withColumn(
            "back", F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first))
        ).where(F.col("back") <= n)
    else:
        newest = done.orderBy(*newest_first).limit(n)
        ranked = newest.withColumn("back", F.row_number().over(Window.orderBy(*newest_first)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return (
        ranked.withColumn("_size", size)
        .where(F.col("_size") >= MIN_RUNS_FOR_HISTORY)
        .select(*by, (F.col("_size") - F.col("back") + 1).alias("position"), "date", "score", "instances")
    )


_CARRIED = ("_runs", "_all", "_needed", "_first")


def _narrowed(sums: DataFrame, by: Sequence[str], keys: Sequence[str], bucket: str) -> DataFrame:
    """Per group, the bucket that the last run of the earlier half falls into.

    ``sums`` has rows ``_n`` and scores ``_score`` per bucket. ``_needed`` becomes the
    number of runs needed from that bucket, ``_first`` includes all buckets before it.
    """
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda column: F.coalesce(F.sum(column).over(before), F.lit(0))
    placed = sums.withColumns({"_n_before": earlier("_n"), "_score_before": earlier("_score")})
    left = F.col("_needed") - F.col("_n_before")
    return placed.where((left > 0) & (left <= F.col("_n"))).select(
        *keys,
        bucket,
        "_runs",
        "_all",
        left.alias("_needed"),
        (F.col("_first") + F.col("_score_before")).cast(SUM).alias("_first"),
    )


def _within(rows: DataFrame, split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each group's bucket; a missing group key is a key like any other."""
    renamed = split.withColumnsRenamed({key: f"_s{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_s{key}")) for key in keys]
    return rows.join(renamed, reduce(and_, same)).drop(*[f"_s{key}" for key in keys])


def score_trend(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average score of the later half of the completed runs minus that of the earlier half.

    The earlier half holds floor(n/2) runs; runs of equal time keep log order. Fewer
    than three runs give no trend; groups with fewer than two are left out.

    No group is ever sorted in one task. Runs are summed up per second and chunk of
    log positions, which combines before the shuffle. Over these sums, the end of the
    earlier half is narrowed down from the day to the second to the chunk; each step
    sees one group's days, seconds of a day, or chunks of a second. Only the runs of
    that last chunk, at most 2**20 per group, are looked at one by one.

    Scores are added as decimals of twelve digits behind the point, and the direction is that of the exact
    difference. A score that is no number below 10,000 counts as 0.
    """
    by = list(by)
    done = _completed(runs, by)
    rows = done.select(
        *by,
        F.substring("at", 1, 10).alias("_day"),
        F.col("at").alias("_second"),
        seq_chunk(F.col("seq"), done.schema["seq"].dataType).alias("_chunk"),
        F.col("seq").alias("_row"),
        F.lit(1).alias("_n"),
        F.coalesce(F.col("score").try_cast(SCORE), F.lit(0).cast(SCORE)).alias("_score"),
    )
    total = [F.sum("_n").alias("_n"), F.sum("_score").cast(SUM).alias("_score")]
    sums = rows.groupBy(*by, "_day", "_second", "_chunk").agg(*total)

    group = Window.partitionBy(*by)
    days = sums.groupBy(*by, "_day").agg(*total).withColumns(
        {"_runs": F.sum("_n").over(group), "_all": F.sum("_score").over(group).cast(SUM), "_first": F.lit(0).cast(SUM)}
    )
    days = days.withColumn("_needed", F.floor(F.col("_runs") / 2))
    keys = [*by, "_day"]
    split = _narrowed(days, by, by, "_day")
    seconds = _within(sums, split, keys).groupBy(*keys, "_second", *_CARRIED).agg(*total)
    split = _narrowed(seconds, by, keys, "_second")
    keys.append("_second")
    split = _narrowed(_within(sums, split, keys), by, keys, "_chunk")
    keys.append("_chunk")
    place = F.row_number().over(group.orderBy("_row"))
    last = _within(rows, split, keys).withColumn("_place", place)

    n, half = F.col("runs"), F.floor(F.col("runs") / 2)
    halves = last.where(F.col("_place") <= F.col("_needed")).groupBy(*by).agg(
        F.first("_runs").alias("runs"),
        F.first("_all").alias("_all"),
        (F.first("_first") + F.sum("_score")).cast(SUM).alias("_first"),
    )
    enough = n >= MIN_RUNS_FOR_TREND
    second = (F.col("_all") - F.col("_first")).cast(SUM)
    averages = halves.where(n >= MIN_RUNS_FOR_HISTORY).select(
        *by,
        "runs",
        F.when(enough, F.col("_first").cast("double") / half).alias("first_avg"),
        F.when(enough, second.cast("double") / (n - half)).alias("second_avg"),
        # Both averages times both numbers of runs.
        F.when(enough, second * half.cast(RUNS)).alias("_second_share"),
        F.when(enough, F.col("_first") * (n - half).cast(RUNS)).alias("_first_share"),
    )
    first, second = F.col("_first_share"), F.col("_second_share")
    direction = F.when(second > first, "improving").when(second < first, "declining").when(second == first, "stable")
    return averages.select(
        *by, "runs", "first_avg", "second_avg", (F.col("second_avg") - F.col("first_avg")).alias("trend"), direction.alias("direction")
    )


def recent_runs(runs: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """The last ``n`` log lines, labelled ``real`` where there is an evaluation score."""
    real = is_completed(F.col("evaluation_status")) & F.col("evaluation_score").isNotNull()
    return (
        runs.orderBy(F.col("seq").desc())
        .limit(n)
        .select(
            "seq",
            "timestamp",
            F.coalesce("generation_score", F.lit(0.0)).alias("generation_score"),
            F.when(real, F.col("evaluation_score")).alias("evaluation_score"),
            F.when(real, "real")
            .otherwise(F.coalesce("evaluation_status", F.lit("unknown")))
            .alias("label"),
        )
    )
