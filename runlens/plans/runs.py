"""Generating and logging runs: prompts, predictions and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.diffs import parse_patch, patch_problem
from runlens.functions.text import prompt
from runlens.operators import scoring, selection, status
from runlens.sources.templates import DEFAULT_TEMPLATE


def prompts(
    instances: DataFrame,
    template: str = DEFAULT_TEMPLATE,
    limit: int | None = None,
    instance_id: str | None = None,
    order: str = "ord",
    **options,
) -> DataFrame:
    """Prompts of one instance, of the first ``limit`` ones, or of all."""
    if instance_id is not None:
        chosen = selection.instance_by_id(instances, instance_id)
    else:
        chosen = selection.first_instances(instances, limit, order)
    return chosen.select("instance_id", prompt(template, **options).alias("prompt"))


def predictions(results: DataFrame, backend: Column, alias: Column | None = None) -> DataFrame:
    """Predictions from raw results; patches that are not well formed become empty."""
    checked = results.withColumn("_parsed", parse_patch("extracted_patch")).withColumn(
        "_problem", patch_problem(F.col("extracted_patch"), F.col("_parsed"))
    )
    return status.assemble_predictions(checked, backend, alias, F.col("_problem"))


def finished_runs(
    runs: DataFrame,
    predictions: DataFrame,
    reports: DataFrame,
    texts: DataFrame,
    on: str = "run_id",
) -> DataFrame:
    """Log records of runs, scored for generation and, where wanted, for evaluation.

    ``runs`` has the key, ``prediction_file``, ``limit``, ``evaluate``, ``harness``,
    times and descriptive fields.
    """
    counted = scoring.score_runs(runs, predictions, [on])
    sized = counted.withColumnsRenamed({"instances": "num_instances"}).withColumn(
        "predictions", F.col("num_instances")
    )
    scored = scoring.evaluation_scores(sized, reports, texts, on=on, after_run=True)
    used = ("generated", "predictions", "resolved", "total", "update_log")
    return status.run_outcomes(scored.withColumnRenamed("score", "scored").drop(*used))
