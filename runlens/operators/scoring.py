"""Generation scores, submissions and evaluation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import has_text, result_cases, result_score
from runlens.operators.joins import split_lookup
from runlens.operators.status import DEFAULT_SUBMISSION_MODEL, MODEL_SUFFIX


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, 0 for an empty whole, null where either is unknown."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.when(whole == 0, F.when(part.isNotNull(), 0.0)).otherwise(share)


def score_columns(frame: DataFrame) -> DataFrame:
    """Add the generation score to counts of instances and of generated ones."""
    return frame.withColumn("generation_score", percent(F.col("generated"), F.col("instances")))


def generation_scores(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per prediction file: instances, non-blank predictions and their share in percent.

    Counts combine before the shuffle, so the size of a single file does not matter.
    """
    counted = predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("instances"),
        F.count_if(has_text(F.col("prediction"))).alias("generated"),
    )
    return score_columns(counted)


def score_runs(runs: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    """Runs with the generation score of their file; a run without predictions gets 0 of 0."""
    scored = generation_scores(predictions, on)
    joined = runs.join(scored, list(on), "left")
    return joined.na.fill(0, ["instances", "generated"]).na.fill(0.0, ["generation_score"])


def file_sizes(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("instances"))


def _submission(predictions: DataFrame, model: Column, keep: Sequence[str]) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    return predictions.select(
        *keep,
        text("instance_id").alias("instance_id"),
        model.alias("model_name_or_path"),
        text("prediction").alias("model_patch"),
    )


def submissions(predictions: DataFrame, by: Sequence[str], seq: str = "seq") -> DataFrame:
    """Submission rows of past files: all rows of a file carry its first row's model."""
    first = F.min_by(F.coalesce("model", F.lit(DEFAULT_SUBMISSION_MODEL)), seq)
    models = predictions.groupBy(*by).agg(first.alias("_model"), F.count(F.lit(1)).alias("_rows"))
    named = split_lookup(predictions, models, by, spread=seq, rows="_rows")
    return _submission(named, F.col("_model"), by)


def run_submissions(predictions: DataFrame, backend: Column, by: Sequence[str]) -> DataFrame:
    """Submission rows right after a run: the model is named after the backend."""
    return _submission(predictions, F.concat(backend, F.lit(MODEL_SUFFIX)), by)


def stated_in_lines(lines: DataFrame, on: str, after_run: bool = False) -> DataFrame:
    """What harness output states, from its lines (``line``, and ``seq`` in their order).

    Each line is matched by itself, and a run keeps the first hit of each pattern, combined before
    the shuffle; so output of any length is read by many tasks and never becomes one row.
    """
    cases = result_cases(F.col("line"), with_resolved_line=after_run)
    names = [f"_case_{i}" for i in range(len(cases))]
    hits = lines.select(on, "seq", *[case.alias(name) for case, name in zip(cases, names)])
    hits = hits.where(F.coalesce(*names).isNotNull())
    first = [F.min_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name) for name in names]
    return hits.groupBy(on).agg(*first).select(on, F.coalesce(*names).alias("_text"))


def evaluation_scores(
    runs: DataFrame,
    reports: DataFrame,
    texts: DataFrame,
    on: str = "run_id",
    after_run: bool = False,
) -> DataFrame:
    """Evaluation score per run from its report or, failing that, the harness output.

    ``runs`` has the run's key and ``predictions``, its number of predictions, which
    stands in where a report has no total. ``texts`` has the output as one text per run
    (``output``), or as its lines (``line`` and ``seq``). Adds ``resolved``, ``total``, ``score``
    and ``update_log``; the latter is false where nothing is to be logged: without a
    score, or for a bare percentage found when a past file is evaluated.
    ``after_run`` selects the rules of scoring right after a run.
    """
    # Output texts are long: only what they state goes through the join.
    if "line" in texts.columns:
        stated = stated_in_lines(texts, on, after_run)
    else:
        stated = texts.select(on, result_score(F.col("output"), with_resolved_line=after_run).alias("_text"))
    reported = reports.select(on, "resolved_instances", "total_instances")
    parsed = runs.join(reported, on, "left").join(stated, on, "left")
    report_total = F.coalesce(F.nullif("total_instances", F.lit(0)), F.col("predictions"))
    use_report = F.col("resolved_instances").isNotNull() & report_total.isNotNull()
    text_total = F.when(F.col("_text.no_total"), F.col("predictions")).otherwise(F.col("_text.total"))
    resolved = F.when(use_report, F.col("resolved_instances")).otherwise(F.col("_text.resolved"))
    total = F.when(use_report, report_total).otherwise(text_total)
    percentage = F.when(~use_report, F.col("_text.percent"))
    scored = parsed.withColumns({"resolved": resolved.cast("bigint"), "total": total.cast("bigint")})
    score = F.coalesce(percent(F.col("resolved"), F.col("total")), percentage)
    scored = scored.withColumn("score", score)
    logged = F.col("score").isNotNull() & (F.lit(after_run) | percentage.isNull())
    return scored.select(*runs.columns, "resolved", "total", "score", logged.alias("update_log"))


def batch_summary(evaluated: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Files scored in a batch, their unweighted average score and the total time.

    Average and total are null for fewer than two files, as there is nothing to sum up.
    """
    several = F.count("score") > 1
    return evaluated.agg(
        F.count("score").alias("files"),
        F.when(several, F.avg("score")).alias("average_score"),
        F.when(several, F.sum(F.when(F.col("score").isNotNull(), F.col(seconds)))).alias("total_seconds"),
    )
