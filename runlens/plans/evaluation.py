"""Evaluating past prediction files: select, submit, score, log and sum up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators import scoring, selection, status


def select_files(
    files: DataFrame,
    runs: DataFrame | None = None,
    file: str | None = None,
    date: str | None = None,
    date_range: tuple[str, str] | None = None,
    last: int | None = None,
    pattern: str | None = None,
    numbers: str | None = None,
    by_name: bool = True,
) -> DataFrame:
    """Prediction files by one of the selection modes.

    ``numbers`` takes ``1,3-5``, ``all`` or ``pending``; the latter needs the log.
    """
    if file:
        return selection.file_named(files, file, by_name)
    if date:
        return selection.files_on(files, date)
    if date_range:
        return selection.files_between(files, *date_range)
    if last:
        return selection.newest_files(files, last)
    if pattern:
        return selection.files_like(files, pattern)
    if numbers is None:
        raise ValueError("name a file, a date, a range, a count, a pattern or numbers")
    if numbers.strip().lower() == "pending":
        if runs is None:
            raise ValueError("'pending' needs the score log")
        return status.unevaluated_files(files, runs)
    return selection.files_by_ordinal(files, numbers).select(*files.columns)


@dataclass(frozen=True)
class Evaluation:
    """What an evaluation gives; all parts are lazy DataFrames."""

    selected: DataFrame
    totals: DataFrame
    submissions: DataFrame | None = None
    scored: DataFrame | None = None
    updates: DataFrame | None = None
    summary: DataFrame | None = None


def files_to_evaluate(selected: DataFrame, runs: DataFrame, force: bool = False) -> DataFrame:
    """Completed files are left out unless forced."""
    return selected if force else status.unevaluated_files(selected, runs)


def evaluate(
    selected: DataFrame,
    runs: DataFrame,
    predictions: DataFrame,
    reports: DataFrame,
    texts: DataFrame,
    times: DataFrame,
    evaluated_at: Column | str,
    force: bool = False,
    dry_run: bool = False,
    update_log: bool = True,
    on: str = "path",
) -> Evaluation:
    """Score the selected files from the harness's reports and output.

    ``predictions``, ``reports``, ``texts`` and ``times`` (with ``seconds``) are keyed
    by the file's path, or another column ``on`` of the selected files; files of one name in two folders are
    two files. Running the harness itself lies between the submissions and
    these inputs. ``evaluated_at`` is the time to log. ``updates`` goes by name, as the log does, and is ready for
    :func:`runlens.operators.status.apply_updates`.
    """
    overview = status.evaluation_status(selected, runs)
    totals = selection.selected_instances(selected)
    if dry_run:
        return Evaluation(overview, totals)
    todo = files_to_evaluate(selected, runs, force)
    rows = predictions.join(todo.select(on), on, "left_semi")
    sized = todo.withColumnRenamed("instances", "predictions")
    scored = scoring.evaluation_scores(sized, reports, texts, on=on).join(times, on, "left")
    stamp = F.lit(evaluated_at) if isinstance(evaluated_at, str) else evaluated_at
    updates = scored.where(F.col("update_log")).select("name", "score", "seconds", stamp.alias("evaluated_at"))
    return Evaluation(
        selected=overview,
        totals=totals,
        submissions=scoring.submissions(rows, [on]),
        scored=scored,
        updates=updates if update_log else updates.where(F.lit(False)),
        summary=scoring.batch_summary(scored),
    )
