"""Writers for run logs, predictions, submissions and score tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame

from runlens import schemas
from runlens.functions.jsonl import object_line

# --- fixed values -----------------------------------------------------------
EXPORT_COLUMNS = (
    "timestamp",
    "dataset",
    "num_instances",
    "generation_score",
    "evaluation_score",
    "evaluation_status",
    "generation_time",
    "evaluation_time",
    "notes",
)
# ----------------------------------------------------------------------------


def append_runs(runs: DataFrame, path: str, batch: str | None = None) -> str:
    """Append run records to a log folder; returns the folder of this batch.

    Each append gets a folder named by its time, so that file order is log order.
    """
    batch = batch or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    names = [f.name for f in schemas.RUN.fields if f.name in runs.columns]
    target = f"{path.rstrip('/')}/append={batch}"
    runs.select(*names).write.option("ignoreNullFields", "false").json(target)
    return target


def append_predictions(predictions: DataFrame, path: str, file: str = "prediction_file") -> None:
    """Append predictions, one folder ``<file>=<name>`` per prediction file.

    Rows are gathered by file before writing, so that no task has many files open.
    The hint lets adaptive execution split a very large file over several tasks.
    """
    names = [f.name for f in schemas.PREDICTION.fields if f.name in predictions.columns]
    (
        predictions.select(file, *names)
        .hint("rebalance", file)
        .write.mode("append")
        .option("ignoreNullFields", "false")
        .partitionBy(file)
        .json(path)
    )


def write_submissions(submissions: DataFrame, path: str, run: str = "run_id") -> None:
    """Submission rows as JSON lines, one folder per run; large runs are split over tasks."""
    names = [f.name for f in schemas.SUBMISSION.fields]
    (
        submissions.select(run, *names)
        .hint("rebalance", run)
        .write.mode("append")
        .option("ignoreNullFields", "false")
        .partitionBy(run)
        .json(path)
    )


def export_rows(runs: DataFrame) -> DataFrame:
    return runs.select(*EXPORT_COLUMNS)


def export_csv(runs: DataFrame, path: str, single_file: bool = False) -> bool:
    """Export scores as CSV with a header; writes nothing and returns False if there are none.

    ``single_file`` is for exports that one task can write; by default every
    task writes its own part.
    """
    if runs.isEmpty():
        return False
    rows = export_rows(runs)
    if single_file:
        rows = rows.coalesce(1)
    rows.write.options(
        header="true",
        escape='"',
        nullValue="",
        emptyValue="",
        ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)
    return True


def write_lines(lines: DataFrame, path: str, in_order: bool = False) -> None:
    """Write log lines in the order of ``seq`` to a new folder; ``in_order`` says that they come in it."""
    (lines if in_order else lines.orderBy("seq")).select("line").write.text(path)


def run_lines(runs: DataFrame) -> DataFrame:
    """Run records as log lines, next to the columns that are no record fields."""
    names = [f.name for f in schemas.RUN.fields if f.name in runs.columns]
    others = [c for c in runs.columns if c not in names]
    return runs.select(*others, object_line(*names).alias("line"))
