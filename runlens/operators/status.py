"""Evaluation status of prediction files, log updates, and decisions on outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas
from runlens.functions.jsonl import json_value, parse_objects, with_members
from runlens.functions.text import COMPLETED, base_name, failure_kind, is_completed, strip
from runlens.operators.joins import split_lookup

# --- fixed values -----------------------------------------------------------
SETUP_ERROR = "Failed to set up repository"
EXECUTION_ERROR = "Execution failed: "
GENERATION_NOTE = "Failed to generate predictions. "
MODEL_SUFFIX = "-code"
DEFAULT_SUBMISSION_MODEL = "claude-code"
NO_FILE = "None"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# ----------------------------------------------------------------------------


def _logged_name() -> Column:
    return base_name(F.col("prediction_file"))


def _first_status(runs: DataFrame) -> DataFrame:
    """Status on the first log line of each file name."""
    return runs.groupBy(_logged_name().alias("name")).agg(
        F.min_by("evaluation_status", "seq").alias("status")
    )


def evaluation_status(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Add each file's status from its first log line; ``unknown`` without one."""
    return files.join(_first_status(runs), "name", "left").withColumn(
        "status", F.coalesce("status", F.lit("unknown"))
    )


def unevaluated_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose first log line is not ``completed``, unlogged files included."""
    completed = _first_status(runs).where(is_completed(F.col("status")))
    return files.join(completed.select("name"), "name", "left_anti")


def latest_updates(updates: DataFrame) -> DataFrame:
    """One update (name, score, seconds, evaluated_at) per file: the last one wins."""
    newest = F.max_by(
        F.struct("score", "seconds", "evaluated_at"), F.struct("evaluated_at", "score", "seconds")
    )
    return updates.groupBy("name").agg(newest.alias("_update"))


def _updated_fields() -> dict[str, Column]:
    """Log fields that an update sets, from its row."""
    return {
        "evaluation_score": F.col("_update.score"),
        "evaluation_time": F.col("_update.seconds"),
        "evaluation_status": F.lit(COMPLETED),
        "evaluation_timestamp": F.col("_update.evaluated_at"),
    }


def apply_updates(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Set score, time, status and evaluation time on every run of an updated file.

    Runs without a file (null or ``"None"``) have none to update.
    """
    named = runs.withColumn("name", F.nullif(_logged_name(), F.lit(NO_FILE)))
    joined = split_lookup(named, latest_updates(updates), ["name"], spread="seq")
    hit, new = F.col("_update").isNotNull(), _updated_fields()
    old = lambda name: F.col(name) if name in runs.columns else F.lit(None)
    merged = {name: F.when(hit, value).otherwise(old(name)) for name, value in new.items()}
    columns = list(dict.fromkeys([*runs.columns, *new]))
    return joined.select(*[merged.get(name, F.col(name)).alias(name) for name in columns])


def update_log_lines(lines: DataFrame, updates: DataFrame, in_order: bool = False) -> DataFrame:
    """The whole log as lines, updated; input columns ``line`` and ``seq``.

    Lines without an update are passed on as they are, faulty ones included (only
    stripped). In updated lines four values change and nothing else: numbers keep their
    spelling, keys their order, and what is nested or unknown stays.

    ``in_order`` sorts the lines by ``seq``. They are sorted before they are changed: Spark
    works out twice what it sorts, the first time to find the ranges.
    """
    # Names that begin alike are slow to sort; with their hash in front few are compared. Null names match nothing.
    keyed = lambda named: named.withColumn("_hash", F.xxhash64("name"))
    parsed = parse_objects(lines, "struct<prediction_file:string>", "_entry")
    named = parsed.select(
        "seq",
        F.when(F.col("_entry").isNull(), strip(F.col("line"))).otherwise(F.col("line")).alias("line"),
        F.nullif(base_name(F.col("_entry.prediction_file")), F.lit(NO_FILE)).alias("name"),
    )
    joined = split_lookup(keyed(named), keyed(latest_updates(updates)), ["_hash", "name"], spread="seq").select("seq", "line", "_update")
    rows = joined.orderBy("seq") if in_order else joined
    hit = F.col("_update").isNotNull()
    kinds = {"evaluation_score": T.DoubleType(), "evaluation_time": T.DoubleType()}
    new = {key: json_value(value, kinds.get(key, T.StringType())) for key, value in _updated_fields().items()}
    updated = F.when(hit, with_members("_text", new)).otherwise(F.col("line"))
    return rows.withColumn("_text", F.when(hit, strip(F.col("line")))).select("seq", updated.alias("line"))


def assemble_predictions(
    results: DataFrame, backend: Column, alias: Column | None, problem: Column
) -> DataFrame:
    """Predictions from raw results.

    ``results`` has ``instance_id``, ``claude_output`` (null where the repository
    could not be set up) and ``extracted_patch``; ``problem`` tells what is wrong
    with the patch, null if nothing is. A patch with a problem becomes empty but is
    no error.
    """
    ran = F.col("claude_output").isNotNull()
    succeeded = F.coalesce(F.col("claude_output.success"), F.lit(False))
    generic = F.concat(backend, F.lit(MODEL_SUFFIX))
    named = generic if alias is None else F.coalesce(F.nullif(alias, F.lit("")), generic)
    stderr = F.col("claude_output.stderr")
    good = ran & succeeded & problem.isNull()
    return results.select(
        "instance_id",
        F.when(ran, named).otherwise(generic).alias("model"),
        F.when(good, F.col("extracted_patch")).otherwise("").alias("prediction"),
        F.when(~ran, SETUP_ERROR)
        .when(~succeeded, F.concat(F.lit(EXECUTION_ERROR), F.coalesce(stderr, F.lit(""))))
        .alias("error"),
        F.when(ran, failure_kind(F.col("claude_output.success"), stderr)).alias("failure"),
    )


def prediction_rows(
    patches: DataFrame, patch: str = "patch", model: Column | str = DEFAULT_SUBMISSION_MODEL
) -> DataFrame:
    """Prediction records from patches of task instances."""
    named = F.lit(model) if isinstance(model, str) else model
    return patches.select("instance_id", named.alias("model"), F.col(patch).alias("prediction"))


def run_outcomes(runs: DataFrame) -> DataFrame:
    """Log records of finished runs.

    ``runs`` has ``prediction_file`` (null if none came out), ``limit`` (instances
    asked for), ``num_instances``, ``generation_score``, ``evaluate`` and
    ``harness`` (whether evaluation was wanted and possible), ``scored`` (the
    evaluation's score, null if it gave none), ``generation_time``,
    ``evaluation_time`` and ``notes``. Other columns are kept.
    """
    made = F.col("prediction_file").isNotNull()
    evaluated = F.col("evaluate") & F.col("harness")
    scored = F.col("scored").isNotNull()
    used = ("limit", "evaluate", "harness", "scored")
    status = (
        F.when(~made, "failed")
        .when(~evaluated, "skipped")
        .when(scored, COMPLETED)
        .otherwise("failed")
    )
    notes = F.coalesce("notes", F.lit(""))
    columns = {
        "prediction_file": F.coalesce("prediction_file", F.lit(NO_FILE)),
        "num_instances": F.when(made, F.col("num_instances")).otherwise(F.col("limit")),
        "generation_score": F.when(made, F.col("generation_score")).otherwise(0.0),
        "evaluation_score": F.when(made & evaluated, F.coalesce("scored", F.lit(0.0))),
        "evaluation_status": status,
        "evaluation_time": F.when(made & evaluated, F.col("evaluation_time")).otherwise(0.0),
        "notes": F.when(made, notes).otherwise(F.concat(F.lit(GENERATION_NOTE), notes)),
    }
    return runs.select(
        *[c for c in runs.columns if c not in used and c not in columns],
        *[value.alias(name) for name, value in columns.items()],
    )


def log_records(runs: DataFrame) -> DataFrame:
    """Runs cut and ordered to the fields of the score log."""
    present = set(runs.columns)
    return runs.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.RUN.fields
        ]
    )
