"""Queries that write with the library's sinks, read back with its sources and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.jsonl import object_line
from runlens.operators import scoring, status
from runlens.session import scratch_path
from runlens.sinks import writers
from runlens.sources import logs, predictions
from runlens.streaming.generation import current_scores, keep_scores, prediction_stream
from workload.adapters import view
from workload.catalog import query, rounded

_RUN = """
    timestamp, prediction_file, dataset, num_instances, generation_score, round(evaluation_score, 4) AS evaluation_score,
    evaluation_status, round(generation_time, 4) AS generation_time, round(evaluation_time, 4) AS evaluation_time,
    model, backend, notes"""


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The runs as log lines, some of them damaged in the ways a log can be."""
    runs = view(spark, sf, "runs", ("orders",))
    lines = writers.run_lines(runs.withColumn("_status", F.col("evaluation_status")))
    kind, line = F.col("_status"), F.col("line")
    damaged = (
        F.when(kind == "failed", F.concat(line, F.lit(" and more")))
        .when(kind == "interrupted by hand", F.translate(line, '"', "'"))
        .when(kind.isNull(), F.col("seq").cast("string"))
        .otherwise(F.concat(F.lit("  "), line, F.lit("\t")))
    )
    return lines.select("seq", damaged.alias("line"))


@query(f"""
    SELECT seq, {_RUN}, cast(NULL AS varchar) AS evaluation_timestamp FROM {{runs}}
    WHERE evaluation_status IN ('completed', 'pending', 'skipped')""")
def score_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(logs.parse_score_log(_log_lines(spark, sf)))


@query("""
    SELECT seq, CASE evaluation_status WHEN 'failed' THEN 'failed' WHEN 'interrupted by hand' THEN 'interrupted by hand'
                END AS status
    FROM {runs} WHERE coalesce(evaluation_status, '') NOT IN ('completed', 'pending', 'skipped')""")
def faulty_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract("line", "[\"']evaluation_status[\"']:[\"']([a-z ]+)[\"']", 1)
    return logs.faulty_lines(_log_lines(spark, sf)).select("seq", F.nullif(found, F.lit("")).alias("status"))


@query(f"SELECT {_RUN}, cast(NULL AS varchar) AS evaluation_timestamp FROM {{runs}}")
def score_log_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "log")
    runs = view(spark, sf, "runs")
    pending = F.col("evaluation_status").eqNullSafe("pending")
    writers.append_runs(runs.where(~pending), path)
    writers.append_runs(runs.where(pending), path)
    return rounded(logs.read_score_log(spark, path).select(*schemas.RUN.names))


@query("""
    WITH latest AS (
      SELECT name, max(score) AS score, arg_max(seconds, score) AS seconds, any_value(evaluated_at) AS evaluated_at
      FROM {updates} GROUP BY name),
    entries AS (
      SELECT r.*, u.score, u.seconds, u.evaluated_at FROM {runs} r
      LEFT JOIN latest u ON u.name = regexp_extract(r.prediction_file, '[^/]*$')
                        AND r.evaluation_status IN ('completed', 'pending', 'skipped'))
    SELECT seq, prediction_file, notes, coalesce(evaluation_status, '') IN ('completed', 'pending', 'skipped') AS readable,
           CASE WHEN evaluated_at IS NULL THEN evaluation_status ELSE 'completed' END AS evaluation_status,
           round(coalesce(score, evaluation_score), 4) AS evaluation_score,
           round(coalesce(seconds, evaluation_time), 4) AS evaluation_time, evaluated_at AS evaluation_timestamp,
           true AS spelt_as_before
    FROM entries WHERE evaluation_status IN ('completed', 'pending', 'skipped')
    UNION ALL
    SELECT count(*), NULL, NULL, false, NULL, NULL, NULL, NULL, NULL FROM entries
    WHERE coalesce(evaluation_status, '') NOT IN ('completed', 'pending', 'skipped')""")
def score_log_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """The updated log written as text and read again; faulty lines are only counted here.

    Each line also has unknown fields with numbers spelt in their own ways and a nested one,
    which an update must leave as they are, and its key.
    """
    odd = '"odd":33.0,"big":1e5,"none":NaN,"nested":{"evaluation_score":[1.0, "}"]},'
    path = scratch_path(spark, "rewritten")
    start = F.concat(F.lit('{"order":'), F.col("seq").cast("string"), F.lit(f",{odd}"))
    keyed = _log_lines(spark, sf).withColumn(
        "line", F.when(F.col("line").startswith("  {"), F.concat(start, F.substring("line", 4, 1_000_000))).otherwise(F.col("line"))
    )
    writers.write_lines(status.update_log_lines(keyed, view(spark, sf, "updates"), in_order=True), path, in_order=True)
    back = logs.read_lines(spark, path)
    order = F.regexp_extract("line", r'"order":(\d+),', 1).try_cast("bigint")
    spelt = F.contains("line", F.lit(f",{odd}")).alias("spelt_as_before")
    good = logs.parse_score_log(back.select(order.alias("key"), spelt, "line"))
    shown = ("prediction_file", "notes", "evaluation_status", "evaluation_score", "evaluation_time", "evaluation_timestamp")
    rows = good.select(F.col("key").alias("seq"), *shown, F.lit(True).alias("readable"), "spelt_as_before")
    faulty = logs.faulty_lines(back).agg(F.count(F.lit(1)).alias("seq")).select(
        "seq", *[F.lit(None).cast(schemas.RUN[c].dataType).alias(c) for c in shown], F.lit(False).alias("readable"),
        F.lit(None).cast("boolean").alias("spelt_as_before"),
    )
    return rounded(rows.unionByName(faulty))


@query("""
    SELECT concat('predictions_', strftime(l_shipdate, '%Y%m'), '01_000000.jsonl') AS name,
           strftime(l_shipdate, '%Y-%m-01 00:00:00') AS ts, count(*) AS instances
    FROM lineitem GROUP BY 1, 2""")
def prediction_append(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions appended twice to one file per month, then listed as a catalog."""
    path = scratch_path(spark, "predictions")
    month = F.date_format("l_shipdate", "yyyyMM")
    rows = view(spark, sf, "lineitem").select(
        F.concat(F.lit("predictions_"), month, F.lit("01_000000.jsonl")).alias("prediction_file"),
        F.concat(F.lit("task__task-"), F.col("l_partkey").cast("string")).alias("instance_id"),
        F.lit("claude-code").alias("model"),
        F.col("l_returnflag").alias("prediction"),
    )
    blank = F.col("prediction") == "N"
    writers.append_predictions(rows.where(blank), path)
    writers.append_predictions(rows.where(~blank), path)
    catalog = predictions.read_file_catalog(spark, path)
    return catalog.select("name", F.col("ts").cast("string").alias("ts"), "instances")


@query("""
    WITH first AS (
      SELECT run, coalesce(model, 'claude-code') AS model_name_or_path,
             row_number() OVER (PARTITION BY run ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
      FROM {predictions})
    SELECT o.o_orderpriority AS run_id, p.instance_id, f.model_name_or_path, coalesce(p.prediction, '') AS model_patch
    FROM {predictions} p JOIN first f ON f.run = p.run AND f.place = 1 JOIN orders o ON o.o_orderkey = p.run""")
def submission_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "submissions")
    position = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = scoring.submissions(view(spark, sf, "predictions").withColumn("seq", position), ["run"])
    groups = view(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("run_id"))
    writers.write_submissions(rows.join(groups, "run"), path)
    return spark.read.schema(f"{schemas.SUBMISSION.toDDL()}, run_id string").json(path)


@query("""
    SELECT timestamp, dataset, num_instances, generation_score, round(evaluation_score, 4) AS evaluation_score,
           evaluation_status, round(generation_time, 4) AS generation_time, round(evaluation_time, 4) AS evaluation_time,
           notes
    FROM {runs}""")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "export")
    writers.export_csv(view(spark, sf, "runs"), path)
    fields = ", ".join(f"{c} {schemas.RUN[c].dataType.simpleString()}" for c in writers.EXPORT_COLUMNS)
    read = spark.read.options(header="true", escape='"', nullValue="").schema(fields)
    return rounded(read.csv(path))


@query("""
    SELECT concat('task__task-', cast(patch_id AS string)) AS instance_id, success, stderr,
           CASE WHEN success THEN 0 ELSE 1 END AS returncode, extracted_patch
    FROM {results} WHERE success IS NOT NULL""")
def raw_result_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Raw results as JSON documents; the ones that never ran are documents cut short."""
    rows = view(spark, sf, "results")
    output = F.struct(
        "success",
        F.lit("").alias("stdout"),
        "stderr",
        F.when(F.col("success"), 0).otherwise(1).alias("returncode"),
    )
    full = F.to_json(
        F.struct("instance_id", F.lit("20240101_000000").alias("timestamp"), output.alias("claude_output"), "extracted_patch")
    )
    documents = rows.select(F.when(F.col("success").isNotNull(), full).otherwise(F.concat(full, F.lit(","))).alias("text"))
    parsed = logs.parse_raw_results(documents)
    return parsed.select(
        "instance_id", "claude_output.success", "claude_output.stderr", "claude_output.returncode", "extracted_patch"
    )


@query("""
    SELECT instance_id, cast(0 AS int) AS ordinal, repo AS model, problem_statement AS prediction, NULL AS error
    FROM {instances}
    UNION ALL
    SELECT instance_id, 1, NULL, '', hints_text FROM {instances}""")
def prediction_array_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an array of two predictions each."""
    rows = view(spark, sf, "instances", ("documents",))
    full = F.struct("instance_id", F.col("repo").alias("model"), F.col("problem_statement").alias("prediction"))
    failed = F.struct("instance_id", F.lit("").alias("prediction"), F.col("hints_text").alias("error"))
    text = F.concat(F.lit("[\n"), F.to_json(full), F.lit(",\n"), F.to_json(failed), F.lit("\n]"))
    return predictions.parse_prediction_arrays(rows.select(text.alias("text")))


@query("""
    SELECT concat('eval_', cast(run_id AS string)) AS run_id, 'gpt-4.1' AS model,
           CASE WHEN has_report THEN resolved_instances END AS resolved_instances,
           CASE WHEN has_report THEN total_instances END AS total_instances
    FROM {evaluated}""")
def report_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "evaluated")
    body = object_line("resolved_instances", "total_instances", "seconds")
    documents = rows.select(
        F.concat(F.lit("gpt-4.1.eval_"), F.col("run_id").cast("string"), F.lit(".json")).alias("name"),
        F.when(F.col("has_report"), body).otherwise(F.col("output")).alias("text"),
    )
    return logs.parse_reports(documents)


@query("""
    SELECT run, count(*) AS instances, count(*) FILTER (WHERE regexp_matches(prediction, '\\S')) AS generated,
           round(count(*) FILTER (WHERE regexp_matches(prediction, '\\S')) * 100e0 / count(*), 4) AS generation_score
    FROM {responses_by_user} GROUP BY run""")
def streaming_generation_score(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a stream of predictions; scores must come out as in one batch."""
    schema = view(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    arriving = events.select(
        F.col("user_id").alias("run"),
        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("prediction"),
    )
    path = scratch_path(spark, "scores")
    keep_scores(arriving, ["run"], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return rounded(current_scores(spark, f"{path}/out"))


@query("""
    SELECT concat('predictions_', strftime(l_shipdate, '%Y%m'), '01_000000.jsonl') AS name, count(*) AS instances,
           count(*) FILTER (WHERE l_returnflag <> 'N') AS generated,
           round(count(*) FILTER (WHERE l_returnflag <> 'N') * 100e0 / count(*), 4) AS generation_score
    FROM lineitem GROUP BY 1""")
def streamed_file_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of prediction files that grow by one append per return flag, read as JSON lines in several batches."""
    path = scratch_path(spark, "arriving")
    flag = F.col("l_returnflag")
    rows = view(spark, sf, "lineitem").select(
        F.concat(F.lit("predictions_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("01_000000.jsonl")).alias("prediction_file"),
        F.concat(F.lit("task__task-"), F.col("l_partkey").cast("string")).alias("instance_id"),
        F.when(flag != "N", flag).otherwise(" ").alias("prediction"),
    )
    for part in ("A", "R", " "):
        writers.append_predictions(rows.where(F.col("prediction") == part), f"{path}/in")
        arriving = prediction_stream(spark, f"{path}/in", files_per_batch=60)
        keep_scores(arriving, ["name"], f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return rounded(current_scores(spark, f"{path}/out"))


@query("""
    SELECT concat('predictions_', strftime(l_shipdate, '%Y%m'), '01_000000.jsonl') AS name,
           concat('task__task-', cast(l_partkey AS varchar)) AS instance_id, 'claude-code' AS model,
           CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS prediction FROM lineitem""")
def prediction_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions read back from the JSON lines of one file per month, broken lines left out."""
    path = scratch_path(spark, "prediction-files")
    flag = F.col("l_returnflag")
    rows = view(spark, sf, "lineitem").select(
        F.concat(F.lit("predictions_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("01_000000.jsonl")).alias("file"),
        F.concat(F.lit("task__task-"), F.col("l_partkey").cast("string")).alias("instance_id"),
        F.lit("claude-code").alias("model"),
        F.when(flag != "N", flag).alias("prediction"),
        (F.col("l_linenumber") == 1).alias("_broken"),
    )
    whole = rows.withColumn("value", object_line("instance_id", "model", "prediction")).select("file", "_broken", "value")
    broken = whole.where("_broken").select("file", F.expr("substr(value, 1, length(value) - 1)").alias("value"))
    whole.select("file", "value").unionByName(broken).repartition("file").write.partitionBy("file").text(path)
    found = predictions.read_predictions(spark, path)
    return found.select("name", "instance_id", "model", "prediction")


@query("""
    WITH named AS (
      SELECT *, concat('predictions_', strftime(l_shipdate, '%Y%m'), '01_000000.json') AS name FROM lineitem)
    SELECT name, concat('task__task-', cast(l_partkey AS varchar)) AS instance_id,
           concat('a], {"b":[', l_linestatus, '\\') AS prediction, cast(NULL AS varchar) AS fault FROM named
    UNION ALL SELECT name, NULL, NULL, cast(l_orderkey AS varchar) FROM named WHERE l_linenumber = 1
    UNION ALL SELECT DISTINCT name, NULL, NULL, CASE WHEN name LIKE '%_1994%' THEN '{"instance_id":' ELSE '0' END FROM named""")
def prediction_array_files(spark: SparkSession, sf: str) -> DataFrame:
    """One array document per month, over many lines, with numbers among the predictions; those of 1994 have no end."""
    path = scratch_path(spark, "array-files")
    rows = view(spark, sf, "lineitem").select(
        F.concat(F.lit("predictions_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("01_000000.json")).alias("file"),
        F.concat(F.lit("task__task-"), F.col("l_partkey").cast("string")).alias("instance_id"),
        F.concat(F.lit('a], {"b":['), "l_linestatus", F.lit("\\")).alias("prediction"),
        "l_linenumber", "l_orderkey",
    )
    element = F.concat(object_line("instance_id", "prediction"), F.lit(","))
    number = F.when(F.col("l_linenumber") == 1, F.concat(F.col("l_orderkey").cast("string"), F.lit(",")))
    pieces = rows.select("file", F.lit(1).alias("place"), F.explode(F.array_compact(F.array(element, number))).alias("value"))
    last = F.when(F.col("file").contains("_1994"), F.lit('{"instance_id":')).otherwise(F.lit("0]"))
    ends = rows.select("file").distinct().select(
        "file", F.explode(F.create_map(F.lit(0), F.lit("["), F.lit(2), last)).alias("place", "value")
    )
    lines = pieces.unionByName(ends).repartition("file").sortWithinPartitions("file", "place")
    lines.select("file", "value").write.partitionBy("file").text(path)
    documents = logs.read_documents(spark, path).select(F.regexp_extract("path", "file=([^/]*)/", 1).alias("name"), "text")
    return predictions.checked_prediction_arrays(documents).select("name", "instance_id", "prediction", "fault")


@query("""
    SELECT concat('predictions_', strftime(l_shipdate, '%Y%m'), '01_000000.jsonl') AS name,
           strftime(l_shipdate, '%Y-%m-01 00:00:00') AS ts, count(*) AS instances
    FROM lineitem WHERE l_shipdate >= date '1995-03-01' AND l_shipdate < date '1996-07-01'
    GROUP BY 1, 2 HAVING min(l_shipdate) <> date '1995-05-01'""")
def dated_file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog of some months' files; bare numbers count, and a null line spoils its file."""
    path = scratch_path(spark, "dated-files")
    value = F.when(F.col("l_linenumber") == 1, F.col("l_orderkey").cast("string")).otherwise(
        F.to_json(F.struct(F.col("l_partkey").cast("string").alias("instance_id")))
    )
    rows = view(spark, sf, "lineitem").select(
        F.concat(F.lit("predictions_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("01_000000.jsonl")).alias("file"),
        "l_shipdate",
        value.alias("value"),
    )
    first_days = rows.groupBy("file").agg(F.min("l_shipdate").cast("date").alias("first"))
    spoilt = first_days.where(F.col("first") == F.lit("1995-05-01").cast("date")).select("file", F.lit("null").alias("value"))
    whole = rows.select("file", "value").unionByName(spoilt)
    whole.repartition("file").write.partitionBy("file").text(path)
    catalog = predictions.read_file_catalog(spark, path, "1995-03-01", "1996-06-30")
    return catalog.select("name", F.col("ts").cast("string").alias("ts"), "instances")


@query("SELECT instance_id, repo, problem_statement FROM {instances} WHERE length(repo) % 2 = 0")
def instance_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Task instances exported as Parquet with their splits as folders, one split read."""
    path = scratch_path(spark, "instances")
    rows = view(spark, sf, "instances")
    split = F.when(F.length("repo") % 2 == 0, "test").otherwise("dev")
    rows.withColumn("split", split).write.partitionBy("split").parquet(path)
    return predictions.read_instances(spark, path, split="test").select("instance_id", "repo", "problem_statement")
