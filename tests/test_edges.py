"""Edges of logs and patches that the given tables do not reach."""

import json

from pyspark.sql import functions as F

from runlens.functions.diffs import parse_patch
from runlens.operators.selection import last_runs
from runlens.operators.status import update_log_lines
from runlens.sources.logs import read_lines, read_score_log


def test_files_are_ordered_by_their_numbers(spark, tmp_path):
    for name in ("part-99999-x", "part-100000-x", "log.10", "log.2"):
        (tmp_path / name).write_text(json.dumps({"notes": name}) + "\n")
    ordered = read_lines(spark, str(tmp_path)).orderBy("seq").collect()
    names = [json.loads(r.line)["notes"] for r in ordered]
    assert names == ["log.2", "log.10", "part-99999-x", "part-100000-x"]
    assert [r.notes for r in last_runs(read_score_log(spark, str(tmp_path)), 1).collect()] == ["part-100000-x"]


def test_hunk_numbers_beyond_the_range_are_a_problem(spark):
    patch = "--- a/f\n+++ b/f\n@@ -1,{} +1,1 @@\n-a\n+b\n"
    rows = spark.createDataFrame([(patch.format("1"),), (patch.format("9" * 11),)], "patch string")
    problems = [r.p for r in rows.select(parse_patch("patch")["problem"].alias("p")).collect()]
    assert problems == [None, "hunk number is too large"]


UPDATES = [("f.jsonl", 50.0, 1.0, "2025-01-01 00:00:00")], "name string, score double, seconds double, evaluated_at string"


def rewritten(spark, *texts):
    lines = spark.createDataFrame([(text, i) for i, text in enumerate(texts)], "line string, seq long")
    return [r.line for r in update_log_lines(lines, spark.createDataFrame(*UPDATES)).orderBy("seq").collect()]


def test_a_repeated_key_keeps_its_last_value(spark):
    done = json.loads(rewritten(spark, '{"prediction_file":"p/f.jsonl","a":1,"a":2}')[0])
    assert done["a"] == 2 and done["evaluation_score"] == 50.0 and done["prediction_file"] == "p/f.jsonl"


def test_a_rewritten_line_changes_in_four_values_only(spark):
    long = ("x" + chr(92) + "n" + chr(92) + chr(34)) * 20_000
    lines = [
        '{"prediction_file": "p/f.jsonl", "a": 33.0, "b" : 1e5, "c":NaN, "evaluation_score": null , "z": {"evaluation_score": [1.0, {"q": "}"}]}}',
        '\t{ "evaluation_status":"pending","prediction_file":"f.jsonl","notes":"a, \\"b\\": {[","evaluation_time":12} ',
        f'{{"prediction_file":"f.jsonl","notes":"{long}"}}',
        '{"prediction_file":"other.jsonl","evaluation_score":1.50}',
        '{"\\u0065valuation_score":7,"prediction_file":"f.jsonl","list":[],"empty":{}}',
        '{"prediction_file":"None","a":1}',
    ]
    end = '"evaluation_time":1.0,"evaluation_status":"completed","evaluation_timestamp":"2025-01-01 00:00:00"}'
    assert rewritten(spark, *lines) == [
        lines[0][:-1].replace("null", "50.0", 1) + "," + end,
        '{ "evaluation_status":"completed","prediction_file":"f.jsonl","notes":"a, \\"b\\": {[","evaluation_time":1.0,'
        '"evaluation_score":50.0,"evaluation_timestamp":"2025-01-01 00:00:00"}',
        lines[2][:-1] + ',"evaluation_score":50.0,' + end,
        lines[3],
        lines[4][:-1].replace(":7", ":50.0") + "," + end,
        lines[5],
    ]
