"""Prediction files, the catalog of them, and task instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.jsonl import array_elements, as_text, is_value, not_objects, only_objects, parse_objects, typed
from runlens.functions.text import RUN_NAME_PATTERN, name_timestamp
from runlens.sources.logs import read_documents, read_lines

# A prediction file is a plain file, or a folder of part files written by Spark,
# which may be a partition folder ``column=<name>``. Only the last two parts of a path are matched:
# the pattern tries the name from every letter, which on a long path costs more than parsing a line.
_FILE_IN_PATH = r"^(.*?([^/=]*\.jsonl))(?:/[^/]*)?$"


def _tail(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def _file_path(path: Column) -> Column:
    """The path up to the prediction file's name, or an empty text."""
    found = F.regexp_extract(_tail(path), _FILE_IN_PATH, 1)
    folder = F.left(path, F.length(path) - F.length(_tail(path)))
    return F.when(found == "", found).otherwise(F.concat(folder, found))


def file_name(path: Column) -> Column:
    """Name of the prediction file that a path lies in or names, or an empty text."""
    return F.regexp_extract(_tail(path), _FILE_IN_PATH, 2)


def _decoded(path: Column) -> Column:
    # Spark spells paths as URIs, in which a plus sign stands for itself.
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), plain).otherwise(path)


def _with_file(rows: DataFrame) -> DataFrame:
    # Spark's file index and its row metadata spell local paths differently.
    path = F.regexp_replace(_decoded(F.col("path")), "^file:/+", "file:/")
    return rows.withColumns({"name": file_name(_decoded(_tail(F.col("path")))), "path": _file_path(path)})


def read_prediction_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of all prediction files below a path, with each file's path and name."""
    return _with_file(read_lines(spark, path))


def parse_predictions(lines: DataFrame, line: str = "line") -> DataFrame:
    """Predictions from lines; a line that holds no JSON object gives no row."""
    kept = [c for c in lines.columns if c != line]
    parsed = only_objects(lines, as_text(schemas.PREDICTION), "_prediction", line)
    return parsed.select(*kept, *typed("_prediction", schemas.PREDICTION))


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_predictions(read_prediction_lines(spark, path))


def parse_prediction_arrays(documents: DataFrame) -> DataFrame:
    """Predictions from whole files that hold one JSON array each, with their position; other elements are left out."""
    kept = [c for c in documents.columns if c != "text"]
    found = array_elements(documents).drop("element")
    return only_objects(found, as_text(schemas.PREDICTION), "_prediction").select(
        *kept, "ordinal", *typed("_prediction", schemas.PREDICTION)
    )


def faulty_elements(documents: DataFrame) -> DataFrame:
    """What :func:`parse_prediction_arrays` leaves out, for reporting: elements that are no object, text outside an array."""
    return not_objects(array_elements(documents), as_text(schemas.PREDICTION)).drop("line")


def checked_prediction_arrays(documents: DataFrame) -> DataFrame:
    """Every element of such files in one pass: a prediction and a null ``fault``, or the faulty text and null fields."""
    kept = [c for c in documents.columns if c != "text"]
    parsed = parse_objects(array_elements(documents), as_text(schemas.PREDICTION), "_prediction")
    fault = F.when(F.col("_prediction").isNull(), F.col("element"))
    return parsed.select(*kept, "ordinal", *typed("_prediction", schemas.PREDICTION), fault.alias("fault"))


def read_prediction_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_prediction_arrays(read_documents(spark, path))


def _dated(path: Column, first: str | None, last: str | None) -> Column:
    """Whether the day in a file's name lies between two days, ends included."""
    day = F.regexp_extract(file_name(path), RUN_NAME_PATTERN, 1)
    after = F.lit(True) if first is None else day >= first.replace("-", "")
    return after if last is None else after & (day <= last.replace("-", ""))


def listed_files(
    spark: SparkSession, path: str | list[str], first: str | None = None, last: str | None = None
) -> DataFrame:
    """Path and name of every prediction file, empty ones included, if given only those dated from ``first`` to ``last``.

    An empty file yields no line, so it can only be seen in Spark's own file
    index, whose names are on the driver already. Where the listing itself is too
    long for that, pass a table of files to :func:`file_catalog` instead.
    """
    found = spark.read.option("recursiveFileLookup", "true").text(path).inputFiles()
    files = spark.createDataFrame([(name,) for name in found], "path string").where(_dated(F.col("path"), first, last))
    return _with_file(files).select("path", "name").distinct()


_COUNTS = ("instances", "_lines")


def _counted(lines: DataFrame, *by: str) -> DataFrame:
    return lines.groupBy(*by).agg(F.count_if(is_value("line")).alias("instances"), F.count(F.lit(1)).alias("_lines"))


def _named() -> Column:
    whole_name = F.col("name").rlike(r"^predictions_.*\.jsonl$")
    return whole_name & F.col("name").rlike(RUN_NAME_PATTERN) & ~F.col("path").contains("_eval.jsonl")


def _catalog(counted: DataFrame, files: DataFrame | None) -> DataFrame:
    if files is not None:
        counted = files.where(_named()).join(counted, ["path", "name"], "left").na.fill(0, list(_COUNTS))
    return counted.where(F.col("instances") == F.col("_lines")).select(
        "path", "name", name_timestamp(F.col("name")).alias("ts"), "instances"
    )


def file_catalog(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Catalog of prediction files: path, name, time stamp and number of instances.

    A line counts if it holds one JSON value other than null. Submission copies
    (``_eval``) and files with another line are left out. A name
    whose digits are no date keeps a null time stamp. ``files`` (path, name) adds
    files that have no lines.
    """
    return _catalog(_counted(lines.where(_named()), "path", "name"), files)


def _may_be_listed(file: Column) -> Column:
    """False for submission copies and what is no prediction file, told by the path as Spark gives it, without decoding."""
    copy = file.contains("_eval.jsonl/") | (file.endswith("_eval.jsonl") & ~file.contains(".jsonl/"))
    return file.contains("predictions_") & file.contains(".jsonl") & ~copy


def read_file_catalog(
    spark: SparkSession, path: str | list[str], first: str | None = None, last: str | None = None
) -> DataFrame:
    """The catalog of a folder, or of its files dated from ``first`` to ``last`` (such as ``2025-09-02``).

    Files outside these days are never opened: Spark drops them from its listing by the day in their path.
    Lines are counted by the path that Spark gives, so that paths are taken apart once per file and not per line.
    """
    lines = read_lines(spark, path, lambda file: _may_be_listed(file) & _dated(file, first, last))
    # An explode in between, or Spark would move what is asked of a file's name below the counting.
    by_path = _counted(lines, "path").select(F.explode(F.array(F.struct("path", *_COUNTS))).alias("_file")).select("_file.*")
    counted = _with_file(by_path).groupBy("path", "name").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    found = _catalog(counted, listed_files(spark, path, first, last))
    if first is None and last is None:
        return found
    return found.where(F.col("ts").isNotNull())


def read_instances(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Task instances exported as Parquet or JSON lines, all nine fields present.

    ``split`` selects rows by a column or partition folder of that name.
    """
    if path.rstrip("/").endswith((".json", ".jsonl")):
        raw = spark.read.schema(schemas.INSTANCE).json(path)
    else:
        raw = spark.read.parquet(path)
    if split is not None and "split" in raw.columns:
        raw = raw.where(F.col("split") == split)
    return raw
