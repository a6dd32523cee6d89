"""Score logs, evaluation reports, harness output, raw results and cohort lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.jsonl import as_text, not_objects, only_objects, parse_objects, typed


def _file_order(path: Column) -> Column:
    """Sort key of a path in which numbers count by value: ``part-99999`` before ``part-100000``.

    Numbers are padded to 20 digits. Paths that differ in leading zeros only are told
    apart by their text.
    """
    padded = F.regexp_replace(path, r"\d+", "0" * 19 + "$0")
    return F.concat_ws("\n", F.regexp_replace(padded, r"0{0,19}(\d{20,})", "$1"), path)


def read_lines(
    spark: SparkSession, path: str | list[str], wanted: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Lines of text files with their position; ``wanted`` tells by a file's path whether to open it.

    ``seq`` orders lines by file, block and line, files by the numbers in their names.
    A block is read by one task from top to bottom, so the order holds however Spark
    spreads blocks over tasks.
    """
    file = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .where(F.lit(True) if wanted is None else wanted(file))
        .select(
            F.col("value").alias("line"),
            file.alias("path"),
            F.struct(
                _file_order(file).alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("seq"),
        )
    )


def seq_chunk(seq: Column, kind) -> Column:
    """Coarse position: at most 2**20 lines share one, since every line has its own ``seq``."""
    if hasattr(kind, "fieldNames"):
        *outer, last = kind.fieldNames()
        chunk = F.shiftright(seq.getField(last).cast("bigint"), 20)
        return F.struct(*[seq.getField(name).alias(name) for name in outer], chunk.alias(last))
    return F.shiftright(seq.cast("bigint"), 20)


def parse_score_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Run records from log lines; lines that hold no JSON object are left out.

    Other columns (such as ``seq``) are kept. Missing and null fields both become null.
    """
    kept = [c for c in lines.columns if c not in (line, "path")]
    parsed = only_objects(lines, as_text(schemas.RUN), "_run", line)
    return parsed.select(*kept, *typed("_run", schemas.RUN))


def read_score_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_score_log(read_lines(spark, path))


def faulty_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """The lines that :func:`parse_score_log` leaves out, for reporting."""
    return not_objects(lines, as_text(schemas.RUN), line)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as one text each, with their path and name."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(
            F.col("value").alias("text"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
        )
    )


def parse_reports(documents: DataFrame) -> DataFrame:
    """Evaluation reports named ``<model>.<run id>.json``; unreadable ones keep null counts."""
    named = r"^(.*)\.([^.]+)\.json$"
    parsed = parse_objects(documents, as_text(schemas.REPORT), "_report", "text")
    return parsed.select(
        F.regexp_extract("name", named, 2).alias("run_id"),
        F.regexp_extract("name", named, 1).alias("model"),
        *typed("_report", schemas.REPORT),
    )


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_reports(read_documents(spark, path))


def read_result_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Harness output, one text per run; the run id is the file's name without its ending."""
    return read_documents(spark, path).select(
        F.regexp_replace("name", r"\.[^.]*$", "").alias("run_id"), F.col("text").alias("output")
    )


def read_result_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Harness output by lines, for files of any length; the run id is the file's name without its ending."""
    run_id = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return read_lines(spark, path).select(run_id.alias("run_id"), "seq", "line")


def parse_raw_results(documents: DataFrame) -> DataFrame:
    """Raw model runs, one JSON document each; documents that are no JSON object are left out."""
    return only_objects(documents, schemas.RAW_RESULT.simpleString(), "_raw", "text").select("_raw.*")


def faulty_results(documents: DataFrame) -> DataFrame:
    """The documents that :func:`parse_raw_results` leaves out, for reporting."""
    return not_objects(documents, schemas.RAW_RESULT.simpleString(), "text")


def read_raw_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_raw_results(read_documents(spark, path))


def parse_cohort(lines: DataFrame, line: str = "line") -> DataFrame:
    """Instance ids of a cohort list; comments and blank lines are left out."""
    return lines.where(F.col(line).rlike(r"^\s*[^#\s]")).select(F.trim(line).alias("instance_id"))


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    return parse_cohort(read_lines(spark, path))
