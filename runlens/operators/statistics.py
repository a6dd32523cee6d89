"""Statistics over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import is_completed


def run_counts(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    done = is_completed(F.col("evaluation_status"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(done).alias("evaluated"),
        F.count_if(~done).alias("pending"),
    )


def score_statistics(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, scores and times of runs, over all or per group, in one aggregation.

    Generation scores count over all completed runs, a missing one as 0; evaluation
    scores only where there is one. Times of 0 count as not taken. The success rate
    is null if no patches were generated.
    """
    done = is_completed(F.col("evaluation_status"))
    generation = F.when(done, F.coalesce("generation_score", F.lit(0.0)))
    evaluation = F.when(done, F.col("evaluation_score"))
    generation_time = F.when(F.col("generation_time") != 0, F.col("generation_time"))
    evaluation_time = F.when(done & (F.col("evaluation_time") != 0), F.col("evaluation_time"))
    base = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(done).alias("evaluated"),
        F.count_if(~done).alias("pending"),
        F.avg(generation).alias("generation_avg"),
        F.min(generation).alias("generation_min"),
        F.max(generation).alias("generation_max"),
        F.avg(evaluation).alias("evaluation_avg"),
        F.min(evaluation).alias("evaluation_min"),
        F.max(evaluation).alias("evaluation_max"),
        F.avg(generation_time).alias("generation_time_avg"),
        F.sum(generation_time).alias("generation_time_total"),
        F.avg(evaluation_time).alias("evaluation_time_avg"),
        F.sum(evaluation_time).alias("evaluation_time_total"),
    )
    return base.withColumns(
        {
            "average_drop": F.col("generation_avg") - F.col("evaluation_avg"),
            "success_rate": F.try_divide("evaluation_avg", "generation_avg") * 100,
        }
    )
