"""Queries on prediction files: catalog, selection, status, submissions, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.jsonl import object_line
from runlens.functions.text import name_timestamp
from runlens.operators import scoring, selection, status
from runlens.plans import evaluation
from runlens.plans.runs import finished_runs
from runlens.sources.predictions import file_catalog
from workload.adapters import view
from workload.catalog import query, rounded

_TS = "try_strptime(regexp_extract(name, '\\d{8}_\\d{6}'), '%Y%m%d_%H%M%S')"
_FILES = f"(SELECT path, name, instances, {_TS} AS ts FROM {{files}})"
_OUT = "path, name, cast(ts AS string) AS ts, instances"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The file catalog with time stamps taken from the names."""
    return view(spark, sf, "files").withColumn("ts", name_timestamp(F.col("name")))


def _shown(files: DataFrame) -> DataFrame:
    return files.withColumn("ts", F.col("ts").cast("string"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions as the JSON lines of their files, some lines broken off."""
    rows = view(spark, sf, "file_lines", ("lineitem",)).withColumn(
        "instance_id", F.concat(F.lit("task__task-"), F.col("l_partkey").cast("string"))
    )
    whole = object_line("instance_id")
    return rows.select("path", "name", F.when(F.col("faulty"), F.concat(whole, F.lit("}"))).otherwise(whole).alias("line"))


@query("""
    WITH counted AS (
      SELECT f.path, f.name, count(l.run) AS instances, coalesce(bool_or(l.faulty), false) AS faulty
      FROM {files} f LEFT JOIN {file_lines} l ON l.path = f.path GROUP BY f.path, f.name)
    SELECT path, name, cast(try_strptime(regexp_extract(name, '\\d{8}_\\d{6}'), '%Y%m%d_%H%M%S') AS string) AS ts,
           instances
    FROM counted WHERE NOT faulty""")
def prediction_file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    listed = view(spark, sf, "files").select("path", "name")
    return _shown(selection.newest_first(file_catalog(_lines(spark, sf), listed)))


@query(f"SELECT {_OUT} FROM {_FILES} WHERE cast(ts AS date) = date '1998-10-03'")
def files_on_date(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evaluation.select_files(_files(spark, sf), date="1998-10-03"))


@query(f"SELECT {_OUT} FROM {_FILES} WHERE cast(ts AS date) BETWEEN date '1996-02-01' AND date '1997-03-31'")
def files_in_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evaluation.select_files(_files(spark, sf), date_range=("1996-02-01", "1997-03-31")))


@query(f"SELECT {_OUT} FROM {_FILES} WHERE regexp_full_match(name, 'predictions_.99[67]..0[^1-4]_0.*3[.]jsonl')")
def files_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evaluation.select_files(_files(spark, sf), pattern="predictions_?99[67]??0[!1-4]_0*3.jsonl"))


@query(f"""
    SELECT {_OUT} FROM {_FILES} WHERE name = (SELECT max(name) FROM {{files}})
    ORDER BY path DESC LIMIT 1""")
def latest_file(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(selection.latest_file(_files(spark, sf)))


@query(f"""
    SELECT {_OUT} FROM {_FILES} WHERE name = 'predictions_19970528_000001.jsonl'
    ORDER BY ts DESC NULLS LAST, path LIMIT 1""")
def file_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evaluation.select_files(_files(spark, sf), file="predictions_19970528_000001.jsonl"))


@query(f"SELECT {_OUT} FROM {_FILES} ORDER BY ts DESC NULLS LAST, path LIMIT 25")
def newest_files(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(evaluation.select_files(_files(spark, sf), last=25))


@query(f"""
    WITH listed AS (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, path) AS ordinal FROM {_FILES})
    SELECT ordinal, {_OUT} FROM listed""")
def numbered_files(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(selection.numbered(_files(spark, sf)))


@query(f"""
    WITH listed AS (SELECT *, row_number() OVER (ORDER BY ts DESC NULLS LAST, path) AS ordinal FROM {_FILES}),
    picks(pick, low, high) AS (VALUES (0, 2, 2), (1, 5, 9), (2, 7, 7), (4, 900, 900), (5, 0, 1))
    SELECT ordinal, pick, {_OUT} FROM listed JOIN picks ON ordinal BETWEEN low AND high""")
def files_by_number(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(selection.files_by_ordinal(_files(spark, sf), " 2,5-9,7,9-5,900,0-1"))


@query(f"""
    SELECT count(*) AS files, coalesce(cast(sum(instances) AS bigint), 0) AS instances
    FROM {_FILES} WHERE cast(ts AS date) BETWEEN date '1996-02-01' AND date '1997-03-31'""")
def selected_instances(spark: SparkSession, sf: str) -> DataFrame:
    chosen = evaluation.select_files(_files(spark, sf), date_range=("1996-02-01", "1997-03-31"))
    return selection.selected_instances(chosen)


_FIRST_STATUS = """
    (SELECT regexp_extract(prediction_file, '[^/]*$') AS name, arg_min(coalesce(evaluation_status, 'unknown'), seq) AS status
     FROM {runs} GROUP BY 1)"""


@query(f"""
    SELECT f.path, f.name, f.instances, coalesce(s.status, 'unknown') AS status
    FROM {{files}} f LEFT JOIN {_FIRST_STATUS} s ON s.name = f.name""")
def evaluation_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.evaluation_status(view(spark, sf, "files"), view(spark, sf, "runs"))


@query(f"""
    SELECT f.path, f.name, f.instances
    FROM {{files}} f LEFT JOIN {_FIRST_STATUS} s ON s.name = f.name
    WHERE s.status IS DISTINCT FROM 'completed'""")
def unevaluated_files(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.select_files(view(spark, sf, "files"), view(spark, sf, "runs"), numbers="pending")


@query("""
    WITH latest AS (
      SELECT name, arg_max(score, score) AS score, arg_max(seconds, score) AS seconds, any_value(evaluated_at) AS evaluated_at
      FROM {updates} GROUP BY name)
    SELECT r.* EXCLUDE (evaluation_score, evaluation_time, evaluation_status),
           CASE WHEN u.name IS NULL THEN r.evaluation_status ELSE 'completed' END AS evaluation_status,
           round(CASE WHEN u.name IS NULL THEN r.evaluation_score ELSE u.score END, 4) AS evaluation_score,
           round(CASE WHEN u.name IS NULL THEN r.evaluation_time ELSE u.seconds END, 4) AS evaluation_time,
           u.evaluated_at AS evaluation_timestamp
    FROM {runs} r LEFT JOIN latest u ON u.name = regexp_extract(r.prediction_file, '[^/]*$')""")
def updated_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(status.apply_updates(view(spark, sf, "runs"), view(spark, sf, "updates")))


_SUBMITTED = "coalesce(p.instance_id, '') AS instance_id, coalesce(p.prediction, '') AS model_patch"


@query(f"""
    WITH first AS (
      SELECT run, coalesce(model, 'claude-code') AS model_name_or_path,
             row_number() OVER (PARTITION BY run ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
      FROM {{predictions}})
    SELECT p.run, f.model_name_or_path, {_SUBMITTED}
    FROM {{predictions}} p JOIN first f ON f.run = p.run AND f.place = 1""")
def submissions(spark: SparkSession, sf: str) -> DataFrame:
    position = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return scoring.submissions(view(spark, sf, "predictions").withColumn("seq", position), ["run"])


@query(f"""
    SELECT p.run, concat(lower(r.backend), '-code') AS model_name_or_path, {_SUBMITTED}
    FROM {{predictions}} p JOIN {{runs}} r ON r.seq = p.run""")
def run_submissions(spark: SparkSession, sf: str) -> DataFrame:
    backends = view(spark, sf, "runs").select(F.col("seq").alias("run"), F.lower("backend").alias("backend"))
    joined = view(spark, sf, "predictions").join(backends, "run")
    return scoring.run_submissions(joined, F.col("backend"), ["run"])


def _scores(after_run: bool) -> str:
    first = (
        "WHEN regexp_matches(output, 'Instances resolved: \\d+') THEN "
        "[try_cast(regexp_extract(output, 'Instances resolved: (\\d+)', 1) AS double), cast(predictions AS double), NULL]"
    )
    pair = lambda p: (
        f"WHEN regexp_matches(output, '{p}') THEN [try_cast(regexp_extract(output, '{p}', 1) AS double), "
        f"try_cast(regexp_extract(output, '{p}', 2) AS double), NULL]"
    )
    rate = "Success Rate: (\\d+\\.?\\d*)%"
    return f"""
    (SELECT run_id, predictions, seconds,
            CASE WHEN found[2] = 0 THEN 0 WHEN found[3] IS NOT NULL THEN found[3]
                 ELSE found[1] / found[2] * 100 END AS score,
            cast(found[1] AS bigint) AS resolved, cast(found[2] AS bigint) AS total, found[3] IS NOT NULL AS bare
     FROM (SELECT run_id, predictions, seconds,
                  CASE WHEN has_report AND resolved_instances IS NOT NULL THEN
                           [cast(resolved_instances AS double),
                            cast(coalesce(nullif(total_instances, 0), predictions) AS double), NULL]
                       {first if after_run else ''}
                       {pair('(\\d+) of (\\d+) instances')}
                       {pair('(\\d+)/(\\d+) resolved')}
                       {pair('resolved (\\d+) of (\\d+)')}
                       WHEN regexp_matches(output, '{rate}') THEN
                           [NULL, NULL, try_cast(regexp_extract(output, '{rate}', 1) AS double)] END AS found
           FROM {{evaluated}}) AS f)"""


def _evaluated(spark: SparkSession, sf: str, after_run: bool) -> DataFrame:
    rows = view(spark, sf, "evaluated")
    return scoring.evaluation_scores(
        rows.select("run_id", "predictions", "seconds"),
        rows.where("has_report"),
        rows.select("run_id", "output"),
        after_run=after_run,
    )


@query(f"""
    SELECT run_id, predictions, seconds, resolved, total, round(score, 4) AS score,
           score IS NOT NULL AND NOT bare AS update_log
    FROM {_scores(False)}""")
def evaluation_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_evaluated(spark, sf, False))


@query(f"""
    SELECT run_id, predictions, seconds, resolved, total, round(score, 4) AS score,
           score IS NOT NULL AS update_log
    FROM {_scores(True)}""")
def evaluation_scores_after_run(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_evaluated(spark, sf, True))


@query(f"""
    SELECT count(*) AS files, CASE WHEN count(*) > 1 THEN round(avg(score), 4) END AS average_score,
           CASE WHEN count(*) > 1 THEN round(sum(seconds), 4) END AS total_seconds
    FROM {_scores(False)} WHERE score IS NOT NULL""")
def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.batch_summary(_evaluated(spark, sf, False)))


@query(f"""
    SELECT f.run_id, coalesce(f.prediction_file, 'None') AS prediction_file,
           CASE WHEN f.prediction_file IS NULL THEN 300 ELSE g.n END AS num_instances,
           CASE WHEN f.prediction_file IS NULL THEN 0 ELSE round(g.score, 4) END AS generation_score,
           CASE WHEN f.prediction_file IS NULL OR NOT (f.evaluate AND f.harness) THEN NULL
                ELSE round(coalesce(e.score, 0), 4) END AS evaluation_score,
           CASE WHEN f.prediction_file IS NULL THEN 'failed' WHEN NOT (f.evaluate AND f.harness) THEN 'skipped'
                WHEN e.score IS NULL THEN 'failed' ELSE 'completed' END AS evaluation_status,
           CASE WHEN f.prediction_file IS NULL OR NOT (f.evaluate AND f.harness) THEN 0
                ELSE round(f.evaluation_time, 4) END AS evaluation_time,
           concat(CASE WHEN f.prediction_file IS NULL THEN 'Failed to generate predictions. ' ELSE '' END, f.notes)
               AS notes
    FROM {{finished}} f
    JOIN {_scores(True)} e ON e.run_id = f.run_id
    LEFT JOIN (SELECT run, count(*) AS n,
                      count(*) FILTER (WHERE regexp_matches(prediction, '\\S')) * 100e0 / count(*) AS score
               FROM {{predictions}} GROUP BY run) g ON g.run = f.run_id""")
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "finished").withColumnRenamed("limit_n", "limit")
    rows = view(spark, sf, "evaluated")
    predictions = view(spark, sf, "predictions").withColumnRenamed("run", "run_id")
    outcome = finished_runs(
        runs, predictions, rows.where("has_report"), rows.select("run_id", "output")
    )
    return rounded(outcome)


@query(f"""
    SELECT run_id, predictions, seconds, resolved, total, round(score, 4) AS score,
           score IS NOT NULL AS update_log
    FROM {_scores(True)}""")
def evaluation_scores_from_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from harness output that comes as lines, with others in between."""
    rows = view(spark, sf, "evaluated")
    lines = F.concat(F.array(F.lit("loading")), F.split("output", "\n"), F.array(F.lit(""), F.lit("bye")))
    output = rows.select("run_id", F.posexplode(lines).alias("seq", "line"))
    runs = rows.select("run_id", "predictions", "seconds")
    return rounded(scoring.evaluation_scores(runs, rows.where("has_report"), output, after_run=True))


def _evaluation(spark: SparkSession, sf: str, **options) -> evaluation.Evaluation:
    """All files evaluated at once: a report, a stated score or a bare percentage, by their sizes."""
    files, kind = _files(spark, sf), F.col("instances") % 3
    sizes, none = F.col("instances"), F.lit(None).cast("bigint")
    reports = files.where(kind == 0).select("path", (sizes % 7).alias("resolved_instances"), none.alias("total_instances"))
    stated = F.concat((sizes % 5).cast("string"), F.lit(" of "), sizes.cast("string"), F.lit(" instances"))
    texts = files.select("path", F.when(kind == 1, stated).otherwise("Success Rate: 12.5%").alias("output"))
    times = files.select("path", (sizes * 2.0).alias("seconds"))
    lines = view(spark, sf, "file_lines", ("lineitem",)).select(
        "path",
        F.struct("l_linenumber", "l_partkey").alias("seq"),
        F.col("l_partkey").cast("string").alias("instance_id"),
        F.lit(None).cast("string").alias("model"),
        F.lit("x").alias("prediction"),
    )
    runs = view(spark, sf, "runs")
    return evaluation.evaluate(files, runs, lines, reports, texts, times, "2025-01-01 00:00:00", **options)


_FILE_SCORES = f"""
    (SELECT f.path, f.name, f.instances, 2e0 * f.instances AS seconds, coalesce(s.status, 'unknown') AS status,
            f.instances % 3 < 2 AS update_log,
            CASE WHEN f.instances % 3 = 2 THEN 12.5 WHEN f.instances = 0 THEN 0
                 WHEN f.instances % 3 = 0 THEN (f.instances % 7) * 100e0 / f.instances
                 ELSE (f.instances % 5) * 100e0 / f.instances END AS score
     FROM {{files}} f LEFT JOIN {_FIRST_STATUS} s ON s.name = f.name)"""


@query(f"""
    SELECT path, name, instances, seconds, round(score, 4) AS score, update_log
    FROM {_FILE_SCORES} WHERE status <> 'completed'""")
def evaluated_files(spark: SparkSession, sf: str) -> DataFrame:
    scored = _evaluation(spark, sf).scored
    return rounded(scored.select("path", "name", F.col("predictions").alias("instances"), "seconds", "score", "update_log"))


@query(f"SELECT path, name, instances, seconds, round(score, 4) AS score, update_log FROM {_FILE_SCORES}")
def evaluated_files_forced(spark: SparkSession, sf: str) -> DataFrame:
    scored = _evaluation(spark, sf, force=True).scored
    return rounded(scored.select("path", "name", F.col("predictions").alias("instances"), "seconds", "score", "update_log"))


@query(f"SELECT name, round(score, 4) AS score, seconds FROM {_FILE_SCORES} WHERE status <> 'completed' AND update_log")
def evaluation_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Updates for the log; an evaluation that must not update it adds none."""
    updates = _evaluation(spark, sf).updates.unionByName(_evaluation(spark, sf, update_log=False).updates)
    return rounded(updates.select("name", "score", "seconds"))


@query(f"""
    SELECT l.path, cast(l.l_partkey AS varchar) AS instance_id, 'claude-code' AS model_name_or_path, 'x' AS model_patch
    FROM {{file_lines}} l JOIN {_FILE_SCORES} f ON f.path = l.path WHERE f.status <> 'completed'""")
def evaluation_submissions(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf).submissions


@query("SELECT cast(patch_id AS varchar) AS instance_id, 'claude-code' AS model, patch AS prediction FROM {patches}")
def prediction_records(spark: SparkSession, sf: str) -> DataFrame:
    patches = view(spark, sf, "patches", ("documents",))
    return status.prediction_rows(patches.select(F.col("patch_id").cast("string").alias("instance_id"), "patch"))
