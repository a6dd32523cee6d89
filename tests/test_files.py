"""Prediction files: names, selection, status, submissions and evaluation scores."""

import fnmatch

import pytest
from pyspark.sql import functions as F

from runlens.functions.text import glob_regex, name_timestamp
from runlens.operators import joins, scoring, selection, status
from runlens.plans.evaluation import evaluate, select_files
from runlens.plans.runs import finished_runs
from tests.conftest import done


@pytest.fixture
def files(spark):
    names = [
        "predictions_20250901_235959.jsonl",
        "predictions_20250902_163415.jsonl",
        "predictions_20250903_235959.jsonl",
        "predictions_20250904_000000.jsonl",
        "predictions_20251301_000000.jsonl",
    ]
    rows = [(f"p/{name}", name, 10 * i) for i, name in enumerate(names, 1)]
    return spark.createDataFrame(rows, "path string, name string, instances bigint").withColumn(
        "ts", name_timestamp(F.col("name"))
    )


def days(frame):
    return sorted(r.name[18:20] for r in frame.collect())


def test_impossible_date_gives_no_time_stamp(files):
    assert [r.ts for r in files.where("name like '%_2025130%'").collect()] == [None]
    assert files.where("ts is null").count() == 1


def test_date_filters_include_both_whole_days(files):
    assert days(selection.files_on(files, "2025-09-03")) == ["03"]
    assert days(selection.files_between(files, "2025-09-01", "2025-09-03")) == ["01", "02", "03"]


@pytest.mark.parametrize(
    "pattern",
    ["*_163*", "predictions_2025090[12]_*", "[!x]*", "*", "predictions_2025090?_*.jsonl", "predictions",
     "*.JSONL", "[]p]*", "[p", "*[0-9].jsonl", "p+*", "a.c*", "*[^2]*", "*[]"],
)
def test_globs_match_as_in_a_shell(spark, pattern):
    names = ["predictions_20250901_163415.jsonl", "predictions_20250903_235959.jsonl", "x", "]p", "[p", "abc",
             "a.c", "p+q", "^", "line\nend", "[]", "a[]"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r.name for r in frame.where(F.col("name").rlike(glob_regex(pattern))).collect()}
    assert found == {n for n in names if fnmatch.fnmatchcase(n, pattern)}


def test_newest_and_latest(files):
    assert [r.name[18:20] for r in selection.newest_files(files, 2).collect()] == ["04", "03"]
    assert selection.newest_files(files, 0).count() == 5
    assert selection.latest_file(files).first().name == "predictions_20251301_000000.jsonl"


def test_file_by_path_or_name(files):
    name = "predictions_20250902_163415.jsonl"
    assert selection.file_named(files, f"p/{name}", by_name=False).count() == 1
    assert selection.file_named(files, name, by_name=False).count() == 0
    assert selection.file_named(files, name).count() == 1


@pytest.mark.parametrize(
    "text, ordinals",
    [("1,3-5", [1, 3, 4, 5]), ("2,2", [2, 2]), ("0,9,2-3", [2, 3]), ("5-1", []), ("1,x", []), ("1-2-3", []),
     ("ALL ", [1, 2, 3, 4, 5]), ("", []), ("1-3,2-4", [1, 2, 2, 3, 3, 4])],
)
def test_selection_by_number(files, text, ordinals):
    rows = selection.files_by_ordinal(files, text).collect()
    assert sorted(r.ordinal for r in rows) == ordinals


def test_numbers_run_from_the_newest_file(files):
    rows = selection.numbered(files).orderBy("ordinal").collect()
    assert [r.name[16:20] for r in rows] == ["0904", "0903", "0902", "0901", "1301"]


def test_selection_modes(files, runs_of):
    runs = runs_of(done(1.0, prediction_file="p/predictions_20250904_000000.jsonl"))
    assert days(select_files(files, date="2025-09-02")) == ["02"]
    assert days(select_files(files, date_range=("2025-09-02", "2025-09-03"))) == ["02", "03"]
    assert days(select_files(files, last=1)) == ["04"]
    assert days(select_files(files, pattern="*_235959*")) == ["01", "03"]
    assert days(select_files(files, numbers="2")) == ["03"]
    assert days(select_files(files, runs, numbers="pending")) == ["01", "01", "02", "03"]
    with pytest.raises(ValueError):
        select_files(files)


def test_status_is_that_of_the_first_log_line(files, runs_of):
    name = "predictions_20250902_163415.jsonl"
    runs = runs_of(
        {"prediction_file": f"x/{name}", "evaluation_status": "skipped"},
        {"prediction_file": f"y/{name}", "evaluation_status": "completed"},
        {"prediction_file": "None", "evaluation_status": "failed"},
        done(1.0, prediction_file="predictions_20250901_235959.jsonl"),
    )
    found = {r.name[18:20]: r.status for r in status.evaluation_status(files, runs).where("ts is not null").collect()}
    assert found == {"01": "completed", "02": "skipped", "03": "unknown", "04": "unknown"}
    assert days(status.unevaluated_files(files.where("ts is not null"), runs)) == ["02", "03", "04"]


def test_update_touches_every_matching_line(spark, runs_of):
    runs = runs_of(
        {"prediction_file": "a/f.jsonl", "evaluation_status": "pending", "notes": "n"},
        {"prediction_file": "b/f.jsonl", "evaluation_status": "failed", "evaluation_score": 0.0},
        {"prediction_file": "g.jsonl", "evaluation_status": "pending"},
        {},
    )
    updates = spark.createDataFrame(
        [("f.jsonl", 30.0, 5.0, "2025-01-01 00:00:00"), ("f.jsonl", 40.0, 6.0, "2025-01-02 00:00:00")],
        "name string, score double, seconds double, evaluated_at string",
    )
    rows = status.apply_updates(runs, updates).orderBy("seq").collect()
    assert [(r.evaluation_status, r.evaluation_score, r.evaluation_time, r.evaluation_timestamp) for r in rows] == [
        ("completed", 40.0, 6.0, "2025-01-02 00:00:00"),
        ("completed", 40.0, 6.0, "2025-01-02 00:00:00"),
        ("pending", None, None, None),
        (None, None, None, None),
    ]
    assert rows[0].notes == "n"


def test_generation_score(spark):
    texts = ["", " ", "\t\n", " ", "\u001c", None, "diff", " x "]
    rows = [("a", t) for t in texts] + [("b", "x")]
    predictions = spark.createDataFrame(rows, "file string, prediction string")
    files = spark.createDataFrame([("a",), ("b",), ("empty",)], "file string")
    found = {r.file: r for r in scoring.score_runs(files, predictions, ["file"]).collect()}
    assert (found["a"].instances, found["a"].generated, found["a"].generation_score) == (8, 2, 25.0)
    assert found["b"].generation_score == 100.0
    assert (found["empty"].instances, found["empty"].generation_score) == (0, 0.0)


def test_submissions_carry_the_first_rows_model(spark):
    rows = [("a", 2, "i2", "other", "p2"), ("a", 1, "i1", "first", None), ("b", 1, "i3", None, "p3"), ("b", 2, None, "m", "p4")]
    predictions = spark.createDataFrame(rows, "file string, seq int, instance_id string, model string, prediction string")
    found = {(r.file, r.instance_id): r for r in scoring.submissions(predictions, ["file"]).collect()}
    assert found["a", "i1"].model_name_or_path == found["a", "i2"].model_name_or_path == "first"
    assert found["b", "i3"].model_name_or_path == found["b", ""].model_name_or_path == "claude-code"
    assert found["a", "i1"].model_patch == ""
    after_run = scoring.run_submissions(predictions, F.lit("gemini"), ["file"]).collect()
    assert {r.model_name_or_path for r in after_run} == {"gemini-code"}


@pytest.mark.parametrize("counted", [False, True])
def test_hot_keys_are_split_without_losing_rows(spark, counted):
    """One key has 90 % of the rows, null a few, the others one each."""
    facts = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 10 > 0 THEN 'hot' WHEN id % 30 = 0 THEN NULL ELSE concat('k', id) END AS key"
    )
    table = facts.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    rows = "n" if counted else None
    joined = joins.split_lookup(facts, table if counted else table.drop("n"), ["key"], "id", rows, part_rows=100)
    assert joined.columns == ["key", "id", "top"]
    expected = facts.join(table.drop("n"), "key", "left")
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(
        map(tuple, expected.select("key", "id", "top").collect()), key=repr
    )


def test_parts_of_a_hot_key_follow_its_count(spark):
    facts = spark.range(9000).selectExpr("id", "IF(id < 8100, 'hot', concat('k', id)) AS key")
    table = facts.groupBy("key").agg(F.max("id").alias("top"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        joined = joins.split_lookup(facts, table, ["key"], "id", part_rows=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 9000 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


RESULTS = [
    ("a", 10, None, None, "Instances resolved: 3"),
    ("b", 10, None, None, "3 of 12 instances"),
    ("c", 10, None, None, "3/6 resolved"),
    ("d", 10, None, None, "resolved 3 of 4"),
    ("e", 10, None, None, "Success Rate: 30.5%"),
    ("f", 10, None, None, "resolved 1 of 2\nthen 5 of 10 instances"),
    ("g", 10, None, None, "nothing"),
    ("h", 10, 4, 0, "3 of 12 instances"),
    ("i", 10, 4, None, None),
    ("j", 0, 0, 0, None),
    ("k", 10, 2, 5, None),
    ("l", 10, None, None, "5 of 0 instances"),
]


@pytest.mark.parametrize("after_run", [False, True])
def test_evaluation_score_sources(spark, after_run):
    runs = spark.createDataFrame([(r[0], r[1]) for r in RESULTS], "run_id string, predictions bigint")
    reports = spark.createDataFrame(
        [(r[0], r[2], r[3]) for r in RESULTS if r[2] is not None],
        "run_id string, resolved_instances bigint, total_instances bigint",
    )
    texts = spark.createDataFrame([(r[0], r[4]) for r in RESULTS if r[4]], "run_id string, output string")
    found = {r.run_id: r for r in scoring.evaluation_scores(runs, reports, texts, after_run=after_run).collect()}
    scores = {k: r.score for k, r in found.items()}
    expected = {"a": 30.0 if after_run else None, "b": 25.0, "c": 50.0, "d": 75.0, "e": 30.5, "f": 50.0, "g": None,
                "h": 40.0, "i": 40.0, "j": 0.0, "k": 40.0, "l": 0.0}
    assert scores == expected
    assert found["e"].update_log is after_run
    assert found["g"].update_log is False and found["b"].update_log is True


def test_batch_summary_is_unweighted(spark):
    scored = spark.createDataFrame([(10.0, 1.0), (30.0, 2.0), (None, 50.0)], "score double, seconds double")
    row = scoring.batch_summary(scored).first()
    assert (row.files, row.average_score, row.total_seconds) == (2, 20.0, 3.0)
    single = scoring.batch_summary(scored.where("score = 10")).first()
    assert (single.files, single.average_score, single.total_seconds) == (1, None, None)


def test_evaluation_from_selection_to_log(spark, files, runs_of):
    names = {i: f"predictions_2025090{i}" for i in range(1, 5)}
    full = {r.name[:20]: r.name for r in files.collect()}
    first, second = full[names[1]], full[names[2]]
    runs = runs_of(done(1.0, prediction_file=f"p/{first}"), {"prediction_file": f"p/{second}", "evaluation_status": "pending"})
    predictions = spark.createDataFrame(
        [(first, 1, "i", "m", "x"), (second, 1, "j", "m", "x"), (second, 2, "k", None, "")],
        "name string, seq int, instance_id string, model string, prediction string",
    )
    reports = spark.createDataFrame([(second, 1, 0)], "name string, resolved_instances bigint, total_instances bigint")
    texts = spark.createDataFrame([(first, "1 of 2 instances")], "name string, output string")
    times = spark.createDataFrame([(first, 5.0), (second, 7.0)], "name string, seconds double")
    chosen = select_files(files, date_range=("2025-09-01", "2025-09-02")).withColumn("instances", F.lit(2).cast("bigint"))
    args = (chosen, runs, predictions, reports, texts, times, "2025-10-01 00:00:00")
    result = evaluate(*args, on="name")
    assert {r.name: r.status for r in result.selected.collect()} == {first: "completed", second: "pending"}
    assert tuple(result.totals.first()) == (2, 4)
    assert {r.instance_id for r in result.submissions.collect()} == {"j", "k"}
    assert [(r.name, r.score) for r in result.scored.collect()] == [(second, 50.0)]
    logged = status.apply_updates(runs, result.updates).orderBy("seq").collect()
    assert [(r.evaluation_score, r.evaluation_status) for r in logged] == [(1.0, "completed"), (50.0, "completed")]
    assert result.summary.first().average_score is None
    forced = evaluate(*args, force=True, on="name")
    assert {r.name: r.score for r in forced.scored.collect()} == {first: 50.0, second: 50.0}
    assert forced.summary.first().total_seconds == 12.0
    assert evaluate(*args, update_log=False, on="name").updates.count() == 0
    dry = evaluate(*args, dry_run=True, on="name")
    assert dry.scored is None and dry.selected.count() == 2


def test_run_outcomes(spark):
    rows = [
        ("ok", "f1", True, True), ("skip", "f2", False, True), ("no harness", "f3", True, False),
        ("unscored", "f4", True, True), ("no file", None, True, True),
    ]
    runs = spark.createDataFrame(rows, "run_id string, prediction_file string, evaluate boolean, harness boolean")
    runs = runs.selectExpr("*", "300 AS limit", "1.5D AS generation_time", "9.0D AS evaluation_time", "'note' AS notes")
    predictions = spark.createDataFrame(
        [("ok", "x"), ("ok", " "), ("skip", "x"), ("no harness", "x"), ("unscored", "x")], "run_id string, prediction string"
    )
    reports = spark.createDataFrame([], "run_id string, resolved_instances bigint, total_instances bigint")
    texts = spark.createDataFrame([("ok", "Instances resolved: 1"), ("skip", "1/1 resolved")], "run_id string, output string")
    found = {r.run_id: r for r in finished_runs(runs, predictions, reports, texts).collect()}
    shown = {k: (r.evaluation_status, r.evaluation_score, r.evaluation_time) for k, r in found.items()}
    assert shown == {
        "ok": ("completed", 50.0, 9.0), "skip": ("skipped", None, 0.0), "no harness": ("skipped", None, 0.0),
        "unscored": ("failed", 0.0, 9.0), "no file": ("failed", None, 0.0),
    }
    assert (found["no file"].prediction_file, found["no file"].num_instances) == ("None", 300)
    assert (found["no file"].generation_score, found["no file"].notes) == (0.0, "Failed to generate predictions. note")
    assert (found["ok"].generation_score, found["ok"].num_instances) == (50.0, 2)
    assert status.log_records(finished_runs(runs, predictions, reports, texts)).columns[0] == "timestamp"


def test_names_and_numbers_do_not_depend_on_the_time_zone(spark):
    """Half past two did not exist in New York on that day, and half past one was there twice."""
    names = [f"predictions_{t}.jsonl" for t in ("20250309_023000", "20250309_033000", "20251102_013000", "20251102_003000")]
    frame = spark.createDataFrame([(n, n) for n in names], "path string, name string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = selection.numbered(frame.withColumn("ts", name_timestamp(F.col("name")))).collect()
        assert {r.name[12:27]: (r.ordinal, str(r.ts)) for r in rows} == {
            "20251102_013000": (1, "2025-11-02 01:30:00"), "20251102_003000": (2, "2025-11-02 00:30:00"),
            "20250309_033000": (3, "2025-03-09 03:30:00"), "20250309_023000": (4, "2025-03-09 02:30:00"),
        }
        assert selection.files_on(frame.withColumn("ts", name_timestamp(F.col("name"))), "2025-03-09").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_catalog_lists_whole_names_only(spark):
    from runlens.sources.predictions import file_catalog

    names = ["predictions_20250902_163415.jsonl", "old_predictions_20250902_163415.jsonl"]
    lines = spark.createDataFrame([(f"p/{n}", n, '{"instance_id":"a"}') for n in names], "path string, name string, line string")
    assert [r.name for r in file_catalog(lines).collect()] == names[:1]


def test_files_of_one_name_in_two_folders_are_two(spark, runs_of):
    name = "predictions_20250902_000000.jsonl"
    files = spark.createDataFrame([(f"a/{name}", name, 4), (f"b/{name}", name, 10)], "path string, name string, instances bigint")
    predictions = spark.createDataFrame(
        [(f"a/{name}", 1, "i", "m", "x"), (f"b/{name}", 1, "j", "n", "y")],
        "path string, seq int, instance_id string, model string, prediction string",
    )
    reports = spark.createDataFrame([(f"a/{name}", 1, 4)], "path string, resolved_instances bigint, total_instances bigint")
    texts = spark.createDataFrame([(f"b/{name}", "5 of 10 instances")], "path string, output string")
    times = spark.createDataFrame([(f"a/{name}", 1.0), (f"b/{name}", 2.0)], "path string, seconds double")
    result = evaluate(files, runs_of({"notes": "x"}), predictions, reports, texts, times, "2025-10-01 00:00:00")
    assert {r.path[0]: (r.score, r.seconds) for r in result.scored.collect()} == {"a": (25.0, 1.0), "b": (50.0, 2.0)}
    assert {(r.path[0], r.model_name_or_path) for r in result.submissions.collect()} == {("a", "m"), ("b", "n")}
