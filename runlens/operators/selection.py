"""Choosing runs, prediction files and task instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.text import (
    base_name,
    glob_regex,
    is_completed,
    status_label,
)

# --- fixed values -----------------------------------------------------------
SIZE_PRESETS = {"quick": 10, "standard": 50, "full": 300}
DEFAULT_SIZE = 300
# ----------------------------------------------------------------------------


# -- runs ---------------------------------------------------------------------


def last_runs(runs: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` runs by log position; 0 and None mean all."""
    return runs.orderBy(F.col("seq").desc()).limit(n) if n else runs


def runs_with_status(runs: DataFrame, which: str = "all") -> DataFrame:
    """Runs that are ``evaluated`` or ``pending`` (everything not completed), or ``all``."""
    done = is_completed(F.col("evaluation_status"))
    return {"all": runs, "evaluated": runs.where(done), "pending": runs.where(~done)}[which]


def score_table(runs: DataFrame) -> DataFrame:
    """The columns of the score overview; scores stay unrounded."""
    return runs.select(
        "seq",
        F.substring(F.coalesce("timestamp", F.lit("Unknown")), 1, 19).alias("timestamp"),
        F.coalesce("num_instances", F.lit(0)).alias("instances"),
        F.coalesce("generation_score", F.lit(0.0)).alias("generation_score"),
        F.col("evaluation_score"),
        F.when(F.col("evaluation_score").isNull(), "-")
        .otherwise(F.format_string("%.1f%%", "evaluation_score"))
        .alias("evaluation_text"),
        status_label(F.col("evaluation_status")).alias("status"),
        F.substring(F.coalesce("notes", F.lit("")), 1, 30).alias("notes"),
    )


def pending_runs(runs: DataFrame) -> DataFrame:
    """What is still to be evaluated: time, file name and size of each run."""
    return runs_with_status(runs, "pending").select(
        "seq",
        F.substring(F.coalesce("timestamp", F.lit("Unknown")), 1, 19).alias("timestamp"),
        F.coalesce(base_name(F.col("prediction_file")), F.lit("Unknown")).alias("file_name"),
        F.coalesce("num_instances", F.lit(0)).alias("instances"),
    )


# -- prediction files -----------------------------------------------------------


def files_on(files: DataFrame, date: str) -> DataFrame:
    return files_between(files, date, date)


def files_between(files: DataFrame, first: str, last: str) -> DataFrame:
    """Files dated from ``first`` to ``last``, both whole days included.

    Bounds on the time stamp itself reach the scan of a stored catalog.
    """
    start, end = F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 1)
    ts = F.col("ts")
    return files.where((ts >= start.cast("timestamp_ntz")) & (ts < end.cast("timestamp_ntz")))


def files_like(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose whole name matches a shell glob; case counts."""
    return files.where(F.col("name").rlike(glob_regex(pattern)))


def file_named(files: DataFrame, wanted: str, by_name: bool = True) -> DataFrame:
    """The newest file with this path or, if ``by_name``, this name."""
    hit = F.col("path") == wanted
    if by_name:
        hit = hit | (F.col("name") == wanted)
    return files.where(hit).orderBy(*_newest_first()).limit(1)


def _newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("path").asc()]


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(*_newest_first())


def newest_files(files: DataFrame, n: int | None) -> DataFrame:
    """The ``n`` newest files; 0 and None mean all."""
    return newest_first(files).limit(n) if n else newest_first(files)


def latest_file(files: DataFrame) -> DataFrame:
    """The file whose name sorts last, which for well-formed names is the newest."""
    return files.orderBy(F.col("name").desc(), F.col("path").desc()).limit(1)


def parse_ordinals(text: str) -> list[tuple[int, int]]:
    """Ranges of a selection such as ``1,3-5``; a malformed text selects nothing."""
    ranges = []
    for part in text.split(","):
        ends = part.split("-") if "-" in part else [part, part]
        if len(ends) != 2:
            return []
        try:
            ranges.append((int(ends[0]), int(ends[1])))
        except ValueError:
            return []
    return ranges


def numbered(files: DataFrame) -> DataFrame:
    """Number files from 1, newest first, without sorting them all in one task.

    Files are counted per day and per minute; running sums over those counts give
    each minute its first number, and only files of one minute are sorted together.
    Names carry whole seconds, so a minute holds at most 60 files per folder.
    """
    shown = F.col("ts").cast("string")
    day, minute = F.substring(shown, 1, len("2025-01-31")), F.substring(shown, 1, len("2025-01-31 23:59"))
    dated = files.withColumns({"_day": day, "_minute": minute})
    per_minute = dated.groupBy("_day", "_minute").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_minute.groupBy("_day").agg(F.sum("_n").alias("_n"))

    def earlier(window) -> Column:
        total = F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0))

    days = per_day.select(
        F.col("_day").alias("_d"), earlier(Window.orderBy(F.col("_day").desc())).alias("_days")
    )
    minutes = per_minute.select(
        F.col("_day").alias("_of_day"),
        F.col("_minute").alias("_m"),
        earlier(Window.partitionBy("_day").orderBy(F.col("_minute").desc())).alias("_minutes"),
    )
    starts = minutes.join(days, F.col("_of_day").eqNullSafe(F.col("_d"))).select(
        "_m", (F.col("_days") + F.col("_minutes")).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("_minute").orderBy(*_newest_first()))
    ranked = dated.withColumn("_within", within)
    return ranked.join(starts, F.col("_minute").eqNullSafe(F.col("_m"))).select(
        (F.col("_start") + F.col("_within")).alias("ordinal"), *files.columns
    )


def files_by_ordinal(files: DataFrame, selection: str) -> DataFrame:
    """Files picked by number from the list that is sorted newest first.

    Takes ``all`` or numbers and ranges such as ``1,3-5``. Numbers beyond the list
    are passed over, repeated ones repeat the file, and ``pick`` keeps the order.
    """
    wanted = selection.strip().lower()
    listed = numbered(files)
    if wanted == "all":
        return listed.withColumn("pick", F.lit(0))
    ranges = [(i, *ends) for i, ends in enumerate(parse_ordinals(wanted)) if ends[0] <= ends[1]]
    picks = [
        F.when(F.col("ordinal").between(low, high), F.lit(i)) for i, low, high in ranges
    ]
    if not picks:
        return listed.withColumn("pick", F.lit(0)).where(F.lit(False))
    return listed.withColumn("pick", F.explode(F.array_compact(F.array(*picks))))


def selected_instances(files: DataFrame) -> DataFrame:
    """Number of files chosen and of instances in them."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("instances"), F.lit(0)).alias("instances"),
    )


# -- task instances -------------------------------------------------------------


def instance_info(instances: DataFrame) -> DataFrame:
    """The nine fields of a task instance, empty text where one is missing."""
    present = set(instances.columns)
    return instances.select(
        *[
            (F.coalesce(F.col(name), F.lit("")) if name in present else F.lit("")).alias(name)
            for name in schemas.INSTANCE.names
        ]
    )


def instance_by_id(instances: DataFrame, instance_id: str, must_exist: bool = True) -> DataFrame:
    """The instance with this id; fails if there is none and ``must_exist`` is set."""
    found = instances.where(F.col("instance_id") == instance_id).limit(1)
    if must_exist and found.isEmpty():
        raise ValueError(f"no instance {instance_id!r}")
    return found


def run_size(limit: int | None = None, preset: str | None = None) -> int:
    """Instances to run: an explicit limit, else the preset's, else the full set."""
    return limit or SIZE_PRESETS.get(preset, DEFAULT_SIZE)


def first_instances(instances: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first ``n`` instances in dataset order; 0 and None mean all."""
    return instances.orderBy(order).limit(n) if n else instances


def in_cohort(rows: DataFrame, cohort: DataFrame, key: str = "instance_id") -> DataFrame:
    return rows.join(cohort.select(key), key, "left_semi")


def valid_models(rows: DataFrame, model: str = "model") -> DataFrame:
    return rows.where(F.col(model) != "")
