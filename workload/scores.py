"""Queries on the score log: statistics, history, table, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import score_band
from runlens.operators import scoring, selection, statistics, trends
from runlens.plans.scores import check, score_report
from workload.adapters import view
from workload.catalog import query, rounded

_DONE = "evaluation_status IS NOT DISTINCT FROM 'completed'"

_STATISTICS = f"""
    count(*) AS total_runs,
    count(*) FILTER (WHERE {_DONE}) AS evaluated,
    count(*) FILTER (WHERE NOT ({_DONE})) AS pending,
    round(avg(coalesce(generation_score, 0)) FILTER (WHERE {_DONE}), 4) AS generation_avg,
    min(coalesce(generation_score, 0)) FILTER (WHERE {_DONE}) AS generation_min,
    max(coalesce(generation_score, 0)) FILTER (WHERE {_DONE}) AS generation_max,
    round(avg(evaluation_score) FILTER (WHERE {_DONE}), 4) AS evaluation_avg,
    round(min(evaluation_score) FILTER (WHERE {_DONE}), 4) AS evaluation_min,
    round(max(evaluation_score) FILTER (WHERE {_DONE}), 4) AS evaluation_max,
    round(avg(generation_time) FILTER (WHERE generation_time <> 0), 4) AS generation_time_avg,
    round(sum(generation_time) FILTER (WHERE generation_time <> 0), 4) AS generation_time_total,
    round(avg(evaluation_time) FILTER (WHERE {_DONE} AND evaluation_time <> 0), 4) AS evaluation_time_avg,
    round(sum(evaluation_time) FILTER (WHERE {_DONE} AND evaluation_time <> 0), 4) AS evaluation_time_total,
    round(avg(coalesce(generation_score, 0)) FILTER (WHERE {_DONE})
          - avg(evaluation_score) FILTER (WHERE {_DONE}), 4) AS average_drop,
    round(avg(evaluation_score) FILTER (WHERE {_DONE})
          / nullif(avg(coalesce(generation_score, 0)) FILTER (WHERE {_DONE}), 0) * 100, 4) AS success_rate"""


@query("""
    SELECT o_orderkey AS run, count(p.run) AS instances,
           count(*) FILTER (WHERE regexp_matches(p.prediction, '\\S')) AS generated,
           round(CASE WHEN count(p.run) = 0 THEN 0
                      ELSE count(*) FILTER (WHERE regexp_matches(p.prediction, '\\S')) * 100.0e0 / count(p.run) END, 4)
               AS generation_score
    FROM orders LEFT JOIN {predictions} p ON p.run = o_orderkey GROUP BY o_orderkey""")
def generation_score(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "orders").select(F.col("o_orderkey").alias("run"))
    return rounded(scoring.score_runs(runs, view(spark, sf, "predictions"), ["run"]))


@query("SELECT run, count(*) AS instances FROM {predictions} GROUP BY run")
def file_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.file_sizes(view(spark, sf, "predictions"), ["run"])


def _scored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose scores come from their predictions rather than from the log."""
    predictions = view(spark, sf, "predictions")
    resolved = predictions.groupBy("run").agg(F.count_if("resolved").alias("resolved"))
    runs = view(spark, sf, "runs").withColumnRenamed("seq", "run").drop("generation_score")
    scored = scoring.score_runs(runs, predictions, ["run"]).join(resolved, "run", "left")
    return scored.withColumn(
        "evaluation_score", scoring.percent(F.col("resolved"), F.col("instances"))
    )


@query(f"""
    WITH scored AS (
      SELECT r.seq, any_value(r.model) AS model, any_value(r.evaluation_status) AS evaluation_status,
             any_value(r.generation_time) AS generation_time, any_value(r.evaluation_time) AS evaluation_time,
             CASE WHEN count(p.run) = 0 THEN 0
                  ELSE count(*) FILTER (WHERE regexp_matches(p.prediction, '\\S')) * 100.0e0 / count(p.run) END
                 AS generation_score,
             count(*) FILTER (WHERE p.resolved) * 100.0e0 / nullif(count(p.run), 0) AS evaluation_score
      FROM {{runs}} r LEFT JOIN {{predictions}} p ON p.run = r.seq GROUP BY r.seq)
    SELECT model, {_STATISTICS} FROM scored GROUP BY model""")
def scored_run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.score_statistics(_scored_runs(spark, sf), ["model"]))


@query(f"SELECT {_STATISTICS} FROM {{runs}}")
def score_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.score_statistics(view(spark, sf, "runs")))


@query(f"SELECT backend, dataset, {_STATISTICS} FROM {{runs}} GROUP BY backend, dataset")
def score_statistics_by_backend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(statistics.score_statistics(view(spark, sf, "runs"), ["backend", "dataset"]))


@query(f"""
    SELECT model, count(*) AS total_runs, count(*) FILTER (WHERE {_DONE}) AS evaluated,
           count(*) FILTER (WHERE NOT ({_DONE})) AS pending
    FROM {{runs}} GROUP BY model""")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.run_counts(view(spark, sf, "runs"), ["model"])


def _history(by: str) -> str:
    keys, over = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""
    WITH done AS (
      SELECT {keys} substr(coalesce(timestamp, 'Unknown'), 1, 10) AS date, coalesce(evaluation_score, 0) AS score,
             coalesce(num_instances, 0) AS instances,
             row_number() OVER ({over} ORDER BY coalesce(timestamp, ''), seq) AS place,
             count(*) OVER ({over}) AS n
      FROM {{runs}} WHERE evaluation_status = 'completed')
    SELECT {keys} place - greatest(n - 10, 0) AS position, date, round(score, 4) AS score, instances
    FROM done WHERE n >= 2 AND place > n - 10"""


@query(_history(""))
def recent_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trends.recent_evaluations(view(spark, sf, "runs")))


@query(_history("model"))
def recent_evaluations_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trends.recent_evaluations(view(spark, sf, "runs"), ["model"]))


def _trend(by: str) -> str:
    keys, over, group = (f"{by}, ", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return f"""
    WITH done AS (
      SELECT {keys} coalesce(evaluation_score, 0) AS score, count(*) OVER ({over}) AS n,
             row_number() OVER ({over} ORDER BY coalesce(timestamp, ''), seq) AS place
      FROM {{runs}} WHERE evaluation_status = 'completed'),
    halves AS (
      SELECT {keys} any_value(n) AS runs,
             CASE WHEN any_value(n) >= 3 THEN avg(score) FILTER (WHERE place <= floor(n / 2e0)) END AS first_avg,
             CASE WHEN any_value(n) >= 3 THEN avg(score) FILTER (WHERE place > floor(n / 2e0)) END AS second_avg
      FROM done {group} HAVING any_value(n) >= 2)
    SELECT {keys} runs, round(first_avg, 4) AS first_avg, round(second_avg, 4) AS second_avg,
           round(second_avg - first_avg, 4) AS trend,
           CASE WHEN second_avg > first_avg THEN 'improving' WHEN second_avg < first_avg THEN 'declining'
                WHEN second_avg = first_avg THEN 'stable' END AS direction
    FROM halves"""


@query(_trend(""))
def score_trend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trends.score_trend(view(spark, sf, "runs")))


@query(_trend("model"))
def score_trend_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trends.score_trend(view(spark, sf, "runs"), ["model"]))


@query("""
    SELECT seq, timestamp, coalesce(generation_score, 0) AS generation_score,
           CASE WHEN evaluation_status = 'completed' THEN round(evaluation_score, 4) END AS evaluation_score,
           CASE WHEN evaluation_status = 'completed' AND evaluation_score IS NOT NULL THEN 'real'
                ELSE coalesce(evaluation_status, 'unknown') END AS label
    FROM {runs} ORDER BY seq DESC LIMIT 5""")
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(trends.recent_runs(view(spark, sf, "runs")))


_TABLE = """
    seq, substr(coalesce(timestamp, 'Unknown'), 1, 19) AS timestamp, coalesce(num_instances, 0) AS instances,
    coalesce(generation_score, 0) AS generation_score, round(evaluation_score, 4) AS evaluation_score,
    CASE WHEN evaluation_score IS NULL THEN '-' ELSE printf('%.1f%%', evaluation_score) END AS evaluation_text,
    CASE evaluation_status WHEN 'completed' THEN 'Evaluated' WHEN 'pending' THEN 'Pending'
         WHEN 'skipped' THEN 'Skipped' ELSE '? ' || substr(coalesce(evaluation_status, 'unknown'), 1, 10) END AS status,
    substr(coalesce(notes, ''), 1, 30) AS notes"""


@query(f"SELECT {_TABLE} FROM {{runs}}")
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.score_table(view(spark, sf, "runs")))


@query(f"SELECT {_TABLE} FROM {{runs}} WHERE {_DONE}")
def score_table_evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(score_report(view(spark, sf, "runs"), which="evaluated").table)


@query(f"SELECT {_TABLE} FROM {{runs}} WHERE NOT ({_DONE})")
def score_table_pending(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(score_report(view(spark, sf, "runs"), which="pending").table)


@query(f"""
    WITH chosen AS (SELECT * FROM {{runs}} ORDER BY seq DESC LIMIT 100)
    SELECT {_TABLE} FROM chosen WHERE {_DONE}""")
def last_runs_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(score_report(view(spark, sf, "runs"), last=100, which="evaluated").table)


@query(f"""
    WITH chosen AS (SELECT * FROM {{runs}} ORDER BY seq DESC LIMIT 100)
    SELECT {_STATISTICS} FROM chosen""")
def last_runs_statistics(spark: SparkSession, sf: str) -> DataFrame:
    report = score_report(view(spark, sf, "runs"), last=100, which="evaluated", stats=True)
    return rounded(report.statistics)


@query("""
    SELECT seq, substr(coalesce(timestamp, 'Unknown'), 1, 19) AS timestamp,
           coalesce(regexp_extract(prediction_file, '[^/]*$'), 'Unknown') AS file_name,
           coalesce(num_instances, 0) AS instances
    FROM {runs} WHERE evaluation_status IS DISTINCT FROM 'completed'""")
def pending_runs(spark: SparkSession, sf: str) -> DataFrame:
    return check(view(spark, sf, "runs")).pending


@query("""
    SELECT CASE WHEN evaluation_score IS NULL THEN NULL
                WHEN evaluation_score >= 30 THEN 'Outstanding' WHEN evaluation_score >= 25 THEN 'Excellent'
                WHEN evaluation_score >= 20 THEN 'Very Good' WHEN evaluation_score >= 15 THEN 'Good'
                WHEN evaluation_score >= 10 THEN 'Average' WHEN evaluation_score >= 5 THEN 'Below Average'
                ELSE 'Poor' END AS band,
           count(*) AS runs
    FROM {runs} GROUP BY 1""")
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    band = score_band(F.col("evaluation_score")).alias("band")
    return view(spark, sf, "runs").groupBy(band).agg(F.count(F.lit(1)).alias("runs"))
