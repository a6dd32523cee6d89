"""Generation scores kept up to date while predictions arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens import schemas
from runlens.functions.jsonl import as_text, only_objects, typed
from runlens.operators.scoring import generation_scores, score_columns
from runlens.sources.predictions import file_name


def prediction_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Predictions as they are appended; each append must be a new file."""
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("value").alias("line"),
            file_name(F.col("_metadata.file_path")).alias("name"),
        )
    )
    parsed = only_objects(lines, as_text(schemas.PREDICTION), "_prediction")
    return parsed.select("name", *typed("_prediction", schemas.PREDICTION))


def keep_scores(
    predictions: DataFrame, by: Sequence[str], path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start a query that keeps the counts of every run up to date after each batch.

    State is a table of two counts per run, so it grows with runs and not with predictions.
    Batch ``n`` merges its own counts into generation ``n - 1`` and writes generation ``n``;
    older ones than these two are dropped. A repeated batch starts from the same generation
    again and replaces its own, so it adds nothing. A new checkpoint begins anew.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        counts = generation_scores(batch, by).select(*by, *_COUNTS)
        if number:
            before = spark.read.schema(counts.schema).parquet(_generation(path, number - 1))
            both = before.unionByName(counts)
            counts = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _COUNTS])
        counts.write.mode("overwrite").parquet(_generation(path, number))
        files, folder = _folder(spark, path)
        for other in _generations(files, folder):
            if other not in (number - 1, number):
                files.delete(_child(folder, other), True)

    return (
        predictions.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(merge)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """The scores of every run from the newest whole generation that :func:`keep_scores` has written.

    One generation is read, however many batches there were. A reader may take its time for as
    long as one more batch, since the generation before the newest is kept.
    """
    files, folder = _folder(spark, path)
    whole = [n for n in _generations(files, folder) if files.exists(_child(folder, f"{n}/_SUCCESS"))]
    if not whole:
        raise ValueError(f"no scores have been written to {path}")
    return score_columns(spark.read.parquet(_generation(path, max(whole))))


_COUNTS = ("instances", "generated")


def _generation(path: str, number: int | str) -> str:
    return f"{path}/generation={number}"


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, as Spark sees it, and the path in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), folder


def _child(folder, number: int | str):
    return folder.suffix(_generation("", number))


def _generations(files, folder) -> list[int]:
    """The numbers of the generations there are, whole or not; at most three."""
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return [int(name.removeprefix("generation=")) for name in names if name.startswith("generation=")]
