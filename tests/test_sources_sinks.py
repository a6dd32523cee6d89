"""Files in, files out: every source and sink on real files."""

import csv
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import jsonl
from runlens.functions.text import result_score, strip, strip_long
from runlens.operators import scoring, status
from runlens.operators.selection import in_cohort, last_runs, newest_first
from runlens.operators.trends import score_trend
from runlens.session import scratch_path
from runlens.sinks import writers
from runlens.sources import logs, predictions
from runlens.streaming import generation
from runlens.operators.scoring import generation_scores
from tests.conftest import done

RUN = {"timestamp": "2025-01-01 00:00:00", "prediction_file": "predictions/f.jsonl", "num_instances": 3,
       "generation_score": 100, "evaluation_score": None, "evaluation_status": "pending", "notes": 'a "b", c'}
LOG = [
    json.dumps(RUN),
    "not json",
    "",
    "5",
    "null",
    "[1]",
    json.dumps({"evaluation_status": "completed"}) + " trailing",
    json.dumps({"evaluation_status": "completed", "num_instances": 4.0, "extra": [1], "notes": {"deep": 1}}),
    "  " + json.dumps({**RUN, "num_instances": "many", "model": "m", "extra": {"a": [1, None]}}) + "\t",
    "{'evaluation_status': 'completed'}",
    '{"evaluation_status": "completed"}{"evaluation_status": "completed"}',
]


@pytest.fixture
def log(tmp_path):
    file = tmp_path / "scores.log"
    file.write_text("\n".join(LOG) + "\n")
    return str(file)


def test_log_scan_skips_faulty_lines_and_keeps_order(spark, log):
    rows = logs.read_score_log(spark, log).orderBy("seq").collect()
    assert [(r.evaluation_status, r.num_instances) for r in rows] == [("pending", 3), ("completed", 4), ("pending", None)]
    assert (rows[0].generation_score, rows[0].evaluation_score, rows[0].notes) == (100.0, None, 'a "b", c')
    assert rows[1].prediction_file is None and rows[2].model == "m"
    assert logs.faulty_lines(logs.read_lines(spark, log)).count() == len(LOG) - 3


def test_log_order_holds_across_blocks(spark, tmp_path):
    file = tmp_path / "big.log"
    file.write_text("".join(json.dumps({"num_instances": i, "evaluation_status": "completed",
                                        "evaluation_score": float(i)}) + "\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        runs = logs.read_score_log(spark, str(file))
        assert runs.rdd.getNumPartitions() > 3
        assert [r.num_instances for r in runs.orderBy("seq").collect()] == list(range(5000))
        assert [r.num_instances for r in last_runs(runs, 3).orderBy("seq").collect()] == [4997, 4998, 4999]
        trend = score_trend(runs).first()
        assert (trend.first_avg, trend.second_avg) == (1249.5, 3749.5)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rewrite_keeps_faulty_lines_and_unknown_fields(spark, log, tmp_path):
    updates = spark.createDataFrame([("f.jsonl", 30.5, 9.0, "2025-02-02 00:00:00")],
                                    "name string, score double, seconds double, evaluated_at string")
    target = str(tmp_path / "rewritten")
    writers.write_lines(status.update_log_lines(logs.read_lines(spark, log), updates), target)
    back = [r.line for r in logs.read_lines(spark, target).orderBy("seq").collect()]
    assert len(back) == len(LOG)
    update = {"evaluation_score": 30.5, "evaluation_time": 9.0, "evaluation_status": "completed",
              "evaluation_timestamp": "2025-02-02 00:00:00"}
    for i, (old, new) in enumerate(zip(LOG, back)):
        if i in (0, 8):
            assert json.loads(new) == json.loads(old) | update
        else:
            assert new == old


def test_rewrite_sorts_lines_before_it_changes_them(spark, tmp_path):
    log = [json.dumps(RUN | {"prediction_file": f"p/f{i % 7}.jsonl", "num_instances": i}) + " " * (i % 2) for i in range(300)]
    log[5], log[6] = " {broken ", json.dumps({"prediction_file": "None"})
    lines = spark.createDataFrame(list(enumerate(log)), "seq bigint, line string").repartition(5)
    updates = spark.createDataFrame([(f"f{i}.jsonl", float(i), None, "2025-02-02 00:00:00") for i in (1, 2)] + [("None", 1.0, 1.0, "x"), (None, 2.0, 2.0, "y")],
                                    "name string, score double, seconds double, evaluated_at string")
    ordered = status.update_log_lines(lines, updates, in_order=True)
    plan = ordered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Sort [seq")
    writers.write_lines(ordered, str(tmp_path / "ordered"), in_order=True)
    writers.write_lines(status.update_log_lines(lines, updates), str(tmp_path / "sorted"))
    found = {way: [r.line for r in logs.read_lines(spark, str(tmp_path / way)).orderBy("seq").collect()] for way in ("ordered", "sorted")}
    changed = {f"p/f{i}.jsonl": {"evaluation_score": float(i), "evaluation_time": None, "evaluation_status": "completed",
                                 "evaluation_timestamp": "2025-02-02 00:00:00"} for i in (1, 2)}
    for i, line in enumerate(log):
        update = {} if i == 5 else changed.get(json.loads(line)["prediction_file"], {})
        new = found["ordered"][i]
        assert json.loads(new) == json.loads(line) | update if update else new == (line.strip() if i == 5 else line)
    assert len(found["ordered"]) == 300 and found["sorted"] == found["ordered"]


def test_members_are_replaced_by_span(spark):
    deep = "[" * 12 + '{"score":1}' + "]" * 12
    expected = {
        '{"score": 1 ,"a":"}"}': '{"score": 2.5 ,"a":"}","b$":"\\\\$1"}',
        '{ "x":{"score":[1.0,"]"]}, "b$" : {"y":[]}\t}': '{ "x":{"score":[1.0,"]"]}, "b$" : "\\\\$1"\t,"score":2.5}',
        '{"score":1,"score":-1e5,"a":NaN,"b$":"\\""}': '{"score":2.5,"score":2.5,"a":NaN,"b$":"\\\\$1"}',
        '{"sc\\u006fre":1,"scores":33.0}': '{"sc\\u006fre":2.5,"scores":33.0,"b$":"\\\\$1"}',
        f'{{"a":{deep},"score":null}}': f'{{"a":{deep},"score":2.5,"b$":"\\\\$1"}}',
        f'{{"score":{deep}}}': '{"score":2.5,"b$":"\\\\$1"}',
        "{}": '{"score":2.5,"b$":"\\\\$1"}',
    }
    lines = spark.createDataFrame([(line,) for line in [*expected, None]], "line string")
    values = {"score": F.lit("2.5"), "b$": F.lit('"\\\\$1"')}
    got = lines.select("line", jsonl.with_members("line", values).alias("new"), jsonl._with_members_by_fold("line", values).alias("folded"))
    for row in got.collect():
        assert row.new == row.folded == expected.get(row.line)


def test_members_of_a_long_object_are_replaced_in_one_pass(spark):
    fields = {f"k{i}": [i, {"score": "}"}] for i in range(20_000)} | {"score": 1.0}
    lines = spark.createDataFrame([(json.dumps(fields),)], "line string")
    start = time.perf_counter()
    new = lines.select(jsonl.with_members("line", {"score": F.lit("2.5"), "notes": F.lit('"x"')})).first()[0]
    assert json.loads(new) == fields | {"score": 2.5, "notes": "x"}
    assert time.perf_counter() - start < 20


def test_appends_come_back_in_order(spark, runs_of, tmp_path):
    path = str(tmp_path / "log")
    first = writers.append_runs(runs_of(done(1.0, notes="x"), {"num_instances": 2}).coalesce(1), path)
    writers.append_runs(runs_of({"num_instances": 3}), path)
    assert first.startswith(path)
    rows = logs.read_score_log(spark, path).orderBy("seq").collect()
    assert [r.num_instances for r in rows] == [None, 2, 3]
    text = spark.read.text(first).first().value
    assert '"model":null' in text and set(json.loads(text)) == set(schemas.RUN.names)


def test_catalog_of_plain_files(spark, tmp_path):
    good = json.dumps({"instance_id": "i", "prediction": "p"}) + "\n"
    contents = {
        "predictions_20250902_163415.jsonl": good * 3,
        "predictions_20250902_163415_eval.jsonl": good,
        "predictions_20250903_000000.jsonl": "",
        "predictions_20250904_000000.jsonl": good + "oops\n" + good,
        "predictions_20250905_000000.jsonl": good + "\n" + good,
        "predictions_20251301_000000.jsonl": good,
        "notes.jsonl": good,
        "predictions_20250902_163415.json": "[]",
    }
    for name, content in contents.items():
        (tmp_path / name).write_text(content)
    rows = newest_first(predictions.read_file_catalog(spark, str(tmp_path))).collect()
    assert [(r.name, r.ts and str(r.ts), r.instances) for r in rows] == [
        ("predictions_20250903_000000.jsonl", "2025-09-03 00:00:00", 0),
        ("predictions_20250902_163415.jsonl", "2025-09-02 16:34:15", 3),
        ("predictions_20251301_000000.jsonl", None, 1),
    ]


def test_catalog_of_written_predictions(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = [(f"predictions_2025090{d}_000000.jsonl", f"i{k}", "m", "p", None) for d in (1, 2) for k in range(20)]
    frame = spark.createDataFrame(rows, "prediction_file string, instance_id string, model string, prediction string, error string")
    writers.append_predictions(frame, path)
    writers.append_predictions(frame.limit(5), path)
    found = {r.name: r.instances for r in predictions.read_file_catalog(spark, path).collect()}
    assert sum(found.values()) == 45 and len(found) == 2
    read = predictions.read_predictions(spark, path)
    assert read.count() == 45 and read.where("error is not null").count() == 0


def test_catalog_takes_paths_apart_once_per_file(spark, tmp_path):
    good = '{"instance_id": "i"}\n'
    for name in ("predictions_20250902_163415.jsonl/a.txt", "predictions_20250902_163415.jsonl/b.txt",
                 "predictions_20250902_163415_eval.jsonl/a.txt", "predictions_20250903_000000_eval.jsonl",
                 "predictions_20250904_000000.jsonl/x_eval.jsonl", "predictions_x/other.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(good * 2)
    catalog = predictions.read_file_catalog(spark, str(tmp_path))
    assert {(r.name, r.instances) for r in catalog.collect()} == {
        ("predictions_20250902_163415.jsonl", 4), ("predictions_20250904_000000.jsonl", 2)}
    # What is under the first count runs for every line of the files; it must not decode or match their paths.
    plan = catalog._jdf.queryExecution().optimizedPlan().toString()
    per_line = plan[plan.rindex("Aggregate ["):]
    assert "file_path" in per_line and "UrlCodec" not in per_line and "regexp_extract" not in per_line


def test_submissions_are_written_per_run(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([("r1", "i", "m", "p"), ("r2", "j", "m", None)],
                                  "run_id string, instance_id string, model_name_or_path string, model_patch string")
    writers.write_submissions(frame, path)
    found = spark.read.schema(f"{schemas.SUBMISSION.toDDL()}, run_id string").json(path)
    assert {tuple(r) for r in found.collect()} == {("i", "m", "p", "r1"), ("j", "m", None, "r2")}


def test_csv_export_reads_back_with_a_csv_reader(runs_of, tmp_path):
    runs = runs_of(
        done(12.5, timestamp="t", notes='say "hi", \\ or\tnot ', dataset="", num_instances=3, model="hidden"),
        {"notes": " padded "},
    )
    path = tmp_path / "csv"
    assert writers.export_csv(runs.orderBy("seq"), str(path), single_file=True)
    part = next(path.glob("part-*.csv"))
    with open(part, newline="") as file:
        rows = list(csv.DictReader(file))
    assert list(rows[0]) == list(writers.EXPORT_COLUMNS)
    assert rows[0]["notes"] == 'say "hi", \\ or\tnot ' and rows[0]["evaluation_score"] == "12.5"
    assert rows[1]["notes"] == " padded " and rows[1]["timestamp"] == "" and rows[0]["dataset"] == ""
    assert not writers.export_csv(runs.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_reports_results_and_texts(spark, tmp_path):
    reports, results, texts = (tmp_path / n for n in ("reports", "results", "texts"))
    for folder in (reports, results, texts):
        folder.mkdir()
    (reports / "gpt-4.1.eval_20250101_000000.json").write_text(json.dumps({"resolved_instances": 3, "total_instances": 10, "x": {}}, indent=2))
    (reports / "m.eval_2.json").write_text("{broken")
    found = {r.run_id: tuple(r)[1:] for r in logs.read_reports(spark, str(reports)).collect()}
    assert found == {"eval_20250101_000000": ("gpt-4.1", 3, 10), "eval_2": ("m", None, None)}
    raw = {"instance_id": "i", "timestamp": "20250101_000000", "extracted_patch": "p",
           "claude_output": {"success": True, "stdout": "o\n", "stderr": "", "returncode": 0}}
    (results / "i_20250101.json").write_text(json.dumps(raw, indent=2))
    row = logs.read_raw_results(spark, str(results)).first()
    assert row.claude_output.success and row.claude_output.stdout == "o\n" and row.extracted_patch == "p"
    (texts / "eval_2.log").write_text("one\n3 of 4 instances\n")
    row = logs.read_result_texts(spark, str(texts)).first()
    assert (row.run_id, row.output) == ("eval_2", "one\n3 of 4 instances\n")


def test_cohort_list(spark, tmp_path):
    file = tmp_path / "cohort.txt"
    file.write_text("# header\n\n django__django-1 \n  # note\na__b-2\n")
    cohort = logs.read_cohort(spark, str(file))
    assert sorted(r.instance_id for r in cohort.collect()) == ["a__b-2", "django__django-1"]
    rows = spark.createDataFrame([("a__b-2",), ("a__b-2",), ("z__z-1",)], "instance_id string")
    assert in_cohort(rows, cohort).count() == 2


def test_instances_by_split(spark, tmp_path):
    frame = spark.createDataFrame([("i1", "test"), ("i2", "dev")], "instance_id string, split string")
    frame.write.partitionBy("split").parquet(str(tmp_path / "data"))
    found = predictions.read_instances(spark, str(tmp_path / "data"), split="test")
    assert [r.instance_id for r in found.collect()] == ["i1"]
    (tmp_path / "d.jsonl").write_text('{"instance_id": "i3"}\n')
    assert predictions.read_instances(spark, str(tmp_path / "d.jsonl")).first().instance_id == "i3"


def test_stream_gives_the_scores_of_a_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("predictions", "scores", "checkpoint"))
    schema = "prediction_file string, instance_id string, prediction string"

    def append(rows):
        writers.append_predictions(spark.createDataFrame(rows, schema), source)

    def run():
        stream = generation.prediction_stream(spark, source, files_per_batch=2)
        generation.keep_scores(stream, ["name"], out, checkpoint).awaitTermination()
        return {r.name: (r.instances, r.generated, r.generation_score)
                for r in generation.current_scores(spark, out).collect()}

    first, second = "predictions_20250901_000000.jsonl", "predictions_20250902_000000.jsonl"
    append([(first, f"i{k}", "x" if k % 2 else " ") for k in range(10)])
    assert run() == {first: (10, 5, 50.0)}
    append([(first, "i10", "x"), (second, "i1", None)])
    expected = {r.name: (r.instances, r.generated, r.generation_score) for r in
                generation_scores(predictions.read_predictions(spark, source), ["name"]).collect()}
    assert run() == expected == {first: (11, 6, 6 / 11 * 100), second: (1, 0, 0.0)}
    assert run() == expected
    for _ in range(3):
        append([(second, "i2", "x")])
        run()
    assert run() == {first: (11, 6, 6 / 11 * 100), second: (4, 3, 75.0)}
    assert len([f for f in os.listdir(out) if f.startswith("generation=")]) == 2


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("predictions", "scores", "checkpoint"))
    name = "predictions_20250901_000000.jsonl"

    def run():
        stream = generation.prediction_stream(spark, source)
        generation.keep_scores(stream, ["name"], out, checkpoint).awaitTermination()
        return [(r.name, r.instances, r.generated) for r in generation.current_scores(spark, out).collect()]

    for k in range(3):
        writers.append_predictions(spark.createDataFrame([(name, f"i{k}", "x")], "prediction_file string, instance_id string, prediction string"), source)
        assert run() == [(name, k + 1, k + 1)]
    # Lost after its rows were written and before it was noted as done.
    for file in os.listdir(f"{checkpoint}/commits"):
        if file.strip(".").startswith("2"):
            os.remove(f"{checkpoint}/commits/{file}")
    assert run() == [(name, 3, 3)]
    # Lost while its rows were written: the generation before counts until it is repeated.
    os.remove(f"{out}/generation=2/_SUCCESS")
    assert generation.current_scores(spark, out).first().instances == 2


def test_scores_before_the_first_batch_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        generation.current_scores(spark, str(tmp_path / "none"))


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_prediction_arrays(spark, tmp_path):
    rows = [{"instance_id": "a", "model": "m", "prediction": "p\nq"}, {"instance_id": "b", "prediction": "", "error": "e"}]
    (tmp_path / "predictions_20250902_163415.json").write_text(json.dumps(rows, indent=2))
    found = predictions.read_prediction_arrays(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.name, r.instance_id, r.model, r.prediction, r.error) for r in found] == [
        ("predictions_20250902_163415.json", "a", "m", "p\nq", None),
        ("predictions_20250902_163415.json", "b", None, "", "e"),
    ]


def test_a_faulty_element_spoils_only_itself(spark):
    one, two = '{"instance_id": "a", "prediction": "], {\\\\\\"["}', '{"instance_id": "b"}'
    documents = {
        f"[{one}, 5, {two}]": (["a", "b"], ["5"]),
        f'  [{one},"{{}}",null,[{two}],{{"x":[1,{{}}]}}]\n': (["a", None], ['"{}"', "null", f"[{two}]"]),
        f"[{one}, {{bad}}, {two}]": (["a", "b"], ["{bad}"]),
        f"[{one},": (["a"], [""]),
        f"[{one}, {two}": (["a"], [two]),
        f"[{one}] {two}": (["a"], [two]),
        f"[{one}] [{two}, {two}]": (["a"], [f"[{two}, {two}]"]),
        f"[{one},]": (["a"], [""]),
        f"[,{one}]": (["a"], [""]),
        one: ([], [one]),
        "": ([], [""]),
        "x [1]": ([], ["x [1]"]),
        "[": ([], [""]),
        "[]": ([], []),
        " [ ] ": ([], []),
        "[" + ",".join([one] * 3000) + "]": (["a"] * 3000, []),
    }
    frame = spark.createDataFrame(list(enumerate(documents)) + [(99, None)], "name int, text string")
    good = predictions.parse_prediction_arrays(frame).orderBy("name", "ordinal").collect()
    bad = predictions.faulty_elements(frame).orderBy("name", "ordinal").collect()
    assert predictions.faulty_elements(frame).columns == ["name", "ordinal", "element"]
    for number, (text, (ids, faults)) in enumerate(documents.items()):
        assert [r.instance_id for r in good if r.name == number] == ids, text[:80]
        assert [r.element for r in bad if r.name == number] == faults, text[:80]
    assert not [r for r in good + bad if r.name == 99]


def test_elements_and_faults_come_from_one_pass(spark):
    one = '{"instance_id": "a", "prediction": "p"}'
    texts = [f"[{one}, 5, {one}]", f'[{one}, "{{}}", {{bad}}', one, "", "[]", f"[{one}, {{}}, null]", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "name int, text string")
    found = predictions.checked_prediction_arrays(frame)
    good = predictions.parse_prediction_arrays(frame).collect()
    bad = predictions.faulty_elements(frame).collect()
    plain = [(r.name, r.ordinal, r.instance_id, r.prediction, None) for r in good]
    plain += [(r.name, r.ordinal, None, None, r.element) for r in bad]
    rows = found.select("name", "ordinal", "instance_id", "prediction", "fault").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, plain)) and len(bad) == 6
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_elements_of_a_long_array_are_rows_before_anything_else(spark):
    frame = spark.createDataFrame([(0, "[1, 2]")], "name int, text string")
    plan = predictions.checked_prediction_arrays(frame)._jdf.queryExecution().optimizedPlan().toString()
    # The array that Spark's parser gives is not passed on from row to row.
    above = plan[: plan.rindex("posexplode(")]
    assert above.count("array<array<string>>") == 0 and "_read" not in plan


@pytest.mark.parametrize("text", ["", " \n", "a", " a b\t\n", " " * 250, "a" + "\n" * 250, "x" * 300 + " \u3000", " é" * 120 + "  ", None])
def test_long_texts_are_stripped_as_short_ones_are(spark, text):
    frame = spark.createDataFrame([(text,)], "text string")
    one, other = frame.select(strip(F.col("text")), strip_long(F.col("text"))).first()
    assert one == other


def test_faulty_results_are_listed(spark):
    frame = spark.createDataFrame([("a", '{"instance_id": "i"}'), ("b", "{"), ("c", "[1]"), ("d", "")], "name string, text string")
    assert sorted(r.name for r in logs.faulty_results(frame).collect()) == ["b", "c", "d"]
    assert logs.parse_raw_results(frame.drop("name")).count() == 1


def test_bare_values_count_and_dates_prune_files(spark, tmp_path):
    good = json.dumps({"instance_id": "i"}) + "\n"
    folder = tmp_path / "a b+c%20d"
    folder.mkdir()
    contents = {
        "predictions_20250901_000000.jsonl": good,
        "predictions_20250902_163415.jsonl": good + '5\n"x] y"\n[1, {"a": 2}]\ntrue\n-1.5e3\nNaN\n',
        "predictions_20250903_000000.jsonl": "",
        "predictions_20250903_000001.jsonl": good + "null\n",
        "predictions_20250903_000002.jsonl": good + "5] x\n",
        "predictions_20250903_000003.jsonl": good + "05\n",
        "predictions_20250903_000004.jsonl": good + "1, 2\n",
        "predictions_20250999_000000.jsonl": good,
        "predictions_20251001_000000.jsonl": good,
    }
    for name, content in contents.items():
        (folder / name).write_text(content)
    found = predictions.read_file_catalog(spark, str(tmp_path), "2025-09-02", "2025-09-30")
    assert {(r.name, r.instances) for r in found.collect()} == {
        ("predictions_20250902_163415.jsonl", 7), ("predictions_20250903_000000.jsonl", 0)}
    assert {r.path for r in found.collect()} == {f"file:{folder}/{n}" for n in list(contents)[1:3]}
    everything = predictions.read_file_catalog(spark, str(tmp_path))
    assert everything.count() == 5 and everything.where("instances = 0").count() == 1
    # Files outside the days are not opened.
    lines = logs.read_lines(spark, str(tmp_path), lambda path: predictions._dated(path, "2025-09-02", "2025-09-02"))
    plan = lines.select("line", "path")
    assert plan.count() == 7
    plan._jdf.queryExecution().executedPlan().execute().count()
    scan = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1


def test_output_by_lines_states_what_the_whole_text_states(spark, tmp_path):
    outputs = {
        "run.1": "start\nresolved 1 of 2\n\nthen 5 of 10 instances\n3 of 4 instances\n",
        "run.2": "Success Rate: 7%\r\nInstances resolved: 3\n",
        "run.3": "nothing\n" * 50,
        "run.4": "5 of\n10 instances",
    }
    for name, text in outputs.items():
        (tmp_path / f"{name}.log").write_text(text)
    lines = logs.read_result_lines(spark, str(tmp_path))
    for after_run in (False, True):
        stated = scoring.stated_in_lines(lines, "run_id", after_run)
        found = {r.run_id: r._text for r in stated.collect()}
        whole = logs.read_result_texts(spark, str(tmp_path)).select("run_id", result_score(F.col("output"), after_run).alias("t"))
        assert found == {r.run_id: r.t for r in whole.collect() if r.t}


@pytest.mark.parametrize(
    "path, name, whole",
    [
        ("file:/p/predictions_a.jsonl", "predictions_a.jsonl", "file:/p/predictions_a.jsonl"),
        ("predictions_a.jsonl", "predictions_a.jsonl", "predictions_a.jsonl"),
        ("file:/p/x=y/file=a=predictions_a.jsonl/part-0.txt", "predictions_a.jsonl", "file:/p/x=y/file=a=predictions_a.jsonl"),
        ("file:/p/a.jsonl/b.jsonl", "a.jsonl", "file:/p/a.jsonl"),
        ("file:/p/a.jsonl/b/c.txt", "", ""),
        ("file:/p/a.jsonl.txt", "", ""),
        ("", "", ""),
    ],
)
def test_names_come_from_the_end_of_a_path(spark, path, name, whole):
    frame = spark.createDataFrame([(path,)], "path string")
    found = frame.select(predictions.file_name(F.col("path")).alias("n"), predictions._file_path(F.col("path")).alias("p")).first()
    assert (found.n, found.p) == (name, whole)


def test_a_long_folder_adds_nothing_to_the_cost_of_a_name(spark, tmp_path):
    folder = tmp_path / "a+b%20c"
    folder.mkdir()
    (folder / "predictions_20250902_163415.jsonl").write_text('{"instance_id": "i"}\n')
    read = predictions.read_predictions(spark, str(tmp_path)).select("name", "instance_id")
    assert [tuple(r) for r in read.collect()] == [("predictions_20250902_163415.jsonl", "i")]
    # Only the last two parts of a path are matched.
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == plan.count("substring_index(CASE WHEN") > 0
