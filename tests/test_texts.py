"""Text functions, prompts, models and decisions."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import models, patches, selection, status
from runlens.plans.runs import predictions, prompts
from runlens.sources import registry as registry_source
from runlens.sources.templates import DEFAULT_TEMPLATE, load_template


def values(spark, column, inputs):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


BLANKS = ["", " ", "\t\r\n", "  ", "\x1c\x1f", "​", " a ", "\n　b "]


def test_blank_and_strip_follow_the_writers(spark):
    assert values(spark, text.has_text(F.col("x")), BLANKS + [None]) == [bool(s.strip()) for s in BLANKS] + [False]
    assert values(spark, text.strip(F.col("x")), BLANKS) == [s.strip() for s in BLANKS]


def test_name_timestamp(spark):
    names = ["predictions_20250902_163415.jsonl", "predictions_20251301_000000.jsonl", "predictions_x.jsonl", "a"]
    stamps = values(spark, text.name_timestamp(F.col("x")), names)
    assert [s and str(s) for s in stamps] == ["2025-09-02 16:34:15", None, None, None]


def test_response_changes(spark):
    response = (
        "Editing file: a.py \n```diff\n-x\n+y\n```\nCreating file: b\r.py\nDeleting file: c\n"
        "```diff\nsecond```\n```diff\nunclosed\nModifying file: end"
    )
    frame = spark.createDataFrame([(1, response), (2, "no change"), (3, None)], "id int, text string")
    rows = patches.extracted_changes(frame).orderBy("id", "ordinal").collect()
    assert [(r.id, r.ordinal, r.type, r.content, r.path) for r in rows] == [
        (1, 0, "diff", "-x\n+y\n", None),
        (1, 1, "diff", "second", None),
        (1, 2, "file_mention", None, "a.py"),
        (1, 3, "file_mention", None, "b\r.py"),
        (1, 4, "file_mention", None, "end"),
    ]


def test_score_bands(spark):
    scores = spark.createDataFrame([(s,) for s in (0.0, 4.9, 5.0, 12.0, 19.99, 20.0, 29.0, 30.0, 100.0, None)], "s double")
    assert [r[0] for r in scores.select(text.score_band(F.col("s"))).collect()] == [
        "Poor", "Poor", "Below Average", "Average", "Good", "Very Good", "Excellent", "Outstanding", "Outstanding", None,
    ]


def test_instance_parts(spark):
    parts = values(spark, text.instance_parts(F.col("x")), ["pytest-dev__pytest-5495", "scikit-learn__scikit-learn-13439", "bad"])
    assert [tuple(p) for p in parts] == [("pytest-dev", "pytest", 5495), ("scikit-learn", "scikit-learn", 13439), (None, None, None)]


@pytest.fixture
def instances(spark):
    rows = [
        (0, "o__r-1", "o/r", "c1", "Title\nBody with {repo_name} and {unknown}", "try this"),
        (1, "o__r-2", "o/r", None, "One line", ""),
        (2, "o__r-3", None, "c3", None, None),
    ]
    schema = "ord int, instance_id string, repo string, base_commit string, problem_statement string, hints_text string"
    return spark.createDataFrame(rows, schema)


def test_prompts_fill_all_fields_at_once(instances):
    template = "{repo_name}|{issue_title}|{issue_description}|{base_path}|{instance_id}|{base_commit}|{{x}}"
    rows = {r.instance_id: r.prompt for r in prompts(instances, template).collect()}
    assert rows["o__r-1"] == (
        "o/r|Title|Title\nBody with {repo_name} and {unknown}|/tmp/swe_bench_o__r-1|o__r-1|c1|{x}\n\nHints:\ntry this"
    )
    assert rows["o__r-2"] == "o/r|One line|One line|/tmp/swe_bench_o__r-2|o__r-2||{x}"
    assert rows["o__r-3"] == "|||/tmp/swe_bench_o__r-3|o__r-3|c3|{x}"


def test_prompt_choices_and_templates(instances, tmp_path):
    assert [r.instance_id for r in prompts(instances, limit=2).collect()] == ["o__r-1", "o__r-2"]
    assert prompts(instances, limit=0).count() == 3
    assert [r.instance_id for r in prompts(instances, instance_id="o__r-3").collect()] == ["o__r-3"]
    with pytest.raises(ValueError):
        prompts(instances, instance_id="absent")
    with pytest.raises(KeyError):
        prompts(instances, "{nothing_known}")
    file = tmp_path / "t.txt"
    file.write_text("{instance_id}!")
    assert load_template(str(file)) == "{instance_id}!"
    assert load_template(str(tmp_path / "absent")) == load_template() == DEFAULT_TEMPLATE


def test_instance_info_has_all_fields(instances):
    row = selection.instance_info(instances).where("instance_id = 'o__r-3'").first()
    assert len(row) == 9 and row.repo == "" and row.test_patch == ""


@pytest.fixture(scope="module")
def registry(spark):
    return registry_source.registry(spark)


def resolve(spark, registry, *pairs):
    frame = spark.createDataFrame(list(pairs), "model string, backend string")
    rows = models.expected_performance(frame, registry).collect()
    return {(r.model, r.backend): (r.full_name, r.expected_min, r.expected_max, r.expected_typical) for r in rows}


def test_models_resolve_and_have_expectations(spark, registry):
    found = resolve(
        spark, registry, ("best", "claude"), ("codex", "Codex"), ("gpt-5-codex", "codex"), ("gemini-2.5", "gemini"),
        ("best", "cline"), ("own", "claude"), ("", "claude"), (None, None), ("sonnet-4", "unheard of"), ("o3", "codex"),
    )
    assert found == {
        ("best", "claude"): ("claude-sonnet-4-5-20250929", 35, 45, 40),
        ("codex", "Codex"): ("gpt-5-codex", 32, 42, 38),
        ("gpt-5-codex", "codex"): ("gpt-5-codex", 32, 42, 38),
        ("gemini-2.5", "gemini"): ("gemini-2.5-pro", 25, 35, 30),
        ("best", "cline"): ("best", 10, 30, 20),
        ("own", "claude"): ("own", 10, 30, 20),
        ("", "claude"): (None, 10, 30, 20),
        (None, None): (None, 10, 30, 20),
        ("sonnet-4", "unheard of"): ("claude-sonnet-4-20250514", 25, 35, 30),
        ("o3", "codex"): ("o3-2025-04-16", 10, 30, 20),
    }


def test_alias_cycles_end_where_they_close_and_order_breaks_ties(spark):
    own = registry_source.registry(
        spark,
        aliases={"claude": [("a", "b"), ("b", "a"), ("x", "a"), ("self", "self"), ("p", "t"), ("q", "t"), ("r", "t")]},
        descriptions={"claude": []},
        categories={"claude": []},
        expected={"claude": [("r", 1, 2, 3), ("q", 4, 5, 6)]},
    )
    found = resolve(spark, own, *[(m, "claude") for m in ("a", "b", "x", "self", "p", "r")])
    assert {k[0]: v[0] for k, v in found.items()} == {"a": "a", "b": "b", "x": "a", "self": "self", "p": "t", "r": "t"}
    assert found["p", "claude"][1:] == (4, 5, 6)
    assert found["r", "claude"][1:] == (1, 2, 3)


def test_model_listing(registry):
    rows = models.model_listing(registry, "GEMINI").orderBy("cat_ord", "ord").collect()
    assert [r.model for r in rows][:2] == ["gemini-3-pro-preview", "gemini-2.5-pro"]
    notes = {r.model: r.note for r in rows}
    assert notes["gemini-2.5-flash"] == "- Gemini 2.5 Flash - Fast and efficient"
    assert notes["lite"] == "-> gemini-2.5-flash-lite"
    assert models.model_listing(registry, "cline").count() == 0


def test_valid_models(spark):
    frame = spark.createDataFrame([("a",), ("",), (None,)], "model string")
    assert [r.model for r in selection.valid_models(frame).collect()] == ["a"]


def test_predictions_are_assembled_by_outcome(spark):
    good = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    rows = [
        ("setup", None, good), ("timeout", (False, "", "Command timed out after 10 minutes", -1), good),
        ("error", (False, "", "boom", 1), good), ("invalid", (True, "", "", 0), "@@ -1 +1 @@\n-a\n+b"),
        ("empty", (True, "", "", 0), None), ("good", (True, "", "", 0), good),
    ]
    schema = (
        "instance_id string, claude_output struct<success:boolean,stdout:string,stderr:string,returncode:int>,"
        " extracted_patch string"
    )
    results = spark.createDataFrame(rows, schema)
    found = {r.instance_id: tuple(r)[1:] for r in predictions(results, F.lit("codex"), F.lit("best")).collect()}
    assert found == {
        "setup": ("codex-code", "", "Failed to set up repository", None),
        "timeout": ("best", "", "Execution failed: Command timed out after 10 minutes", "timeout"),
        "error": ("best", "", "Execution failed: boom", "error"),
        "invalid": ("best", "", None, None),
        "empty": ("best", "", None, None),
        "good": ("best", good, None, None),
    }
    assert {r.model for r in predictions(results, F.lit("codex")).collect()} == {"codex-code"}
    plain = status.prediction_rows(results.withColumnRenamed("extracted_patch", "patch")).first()
    assert plain.asDict() == {"instance_id": "setup", "model": "claude-code", "prediction": good}
