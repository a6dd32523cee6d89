"""Patch validation, applicability and snapshot changes."""

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runlens.operators import patches

HEAD = "--- a/x\n+++ b/x\n"
CASES = {
    "null": (None, "Empty patch"),
    "empty": ("", "Empty patch"),
    "blank": (" \n\t ", "Empty patch"),
    "prose": ("just words\nand more", "Patch contains no file changes"),
    "one hunk": (HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n+c\n", None),
    "no final line end": (HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n+c", None),
    "section text": (HEAD + "@@ -1 +1 @@ def f():\n-a\n+b\n", None),
    "header without hunk": (HEAD, None),
    "two files": (HEAD + "@@ -1 +1 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-a\n+b\n", None),
    "removed line like a header": (HEAD + "@@ -1,2 +1 @@\n a\n--- x\n", None),
    "added line like a header": (HEAD + "@@ -1 +1,2 @@\n a\n+++ x\n", None),
    "no newline note": (HEAD + "@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n", None),
    "empty context line": (HEAD + "@@ -1,3 +1,3 @@\n a\n\n-b\n+c\n", None),
    "git rename": ("diff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y\n", None),
    "git header": ("diff --git a/x b/x\nindex 1..2\n" + HEAD + "@@ -1 +1 @@\n-a\n+b\n", None),
    "words after": (HEAD + "@@ -1 +1 @@\n-a\n+b\nthat is all\n", None),
    "hunk first": ("@@ -1 +1 @@\n-a\n+b\n", "Invalid patch format"),
    "too short": (HEAD + "@@ -1,3 +1,2 @@\n a\n-b\n+c\n", "Invalid patch format"),
    "too long": (HEAD + "@@ -1,1 +1,2 @@\n-a\n-b\n+c\n", "Invalid patch format"),
    "bad mark": (HEAD + "@@ -1,2 +1,2 @@\n a\n?b\n", "Invalid patch format"),
    "next header too early": (HEAD + "@@ -1,3 +1,3 @@\n a\n@@ -9 +9 @@\n-a\n+b\n", "Invalid patch format"),
    "target without source": ("+++ b/x\n@@ -1 +1 @@\n-a\n+b\n", "Invalid patch format"),
    "source without target": ("--- a/x\n@@ -1 +1 @@\n-a\n+b\n", "Invalid patch format"),
}


def test_validation(spark):
    rows = spark.createDataFrame([(name, patch) for name, (patch, _) in CASES.items()], "name string, patch string")
    found = {r.name: (r.valid, r.problem and r.problem.split(":")[0]) for r in patches.validate_patches(rows).collect()}
    assert found == {name: (problem is None, problem) for name, (_, problem) in CASES.items()}


FILES = {"x": "a\nb\nc\nd\n", "deep/y": "one\ntwo", "empty": ""}
FITS = {
    "fits": (HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n+B\n", None),
    "fits at the end": (HEAD + "@@ -3,2 +3,1 @@\n c\n-d\n", None),
    "two hunks": (HEAD + "@@ -1 +1 @@\n-a\n+A\n@@ -4 +4 @@\n-d\n+D\n", None),
    "second hunk off": (HEAD + "@@ -1 +1 @@\n-a\n+A\n@@ -3 +3 @@\n-d\n+D\n", "hunk does not fit"),
    "other text": (HEAD + "@@ -1,2 +1,2 @@\n a\n-q\n+B\n", "hunk does not fit"),
    "beyond the end": (HEAD + "@@ -4,2 +4,1 @@\n d\n-e\n", "hunk does not fit"),
    "insertion": (HEAD + "@@ -2,0 +3 @@\n+new\n", None),
    "two files": (HEAD + "@@ -1 +1 @@\n-a\n+A\n--- a/deep/y\t2024\n+++ b/deep/y\n@@ -2 +2 @@\n-two\n+2\n", None),
    "one of two off": (HEAD + "@@ -1 +1 @@\n-a\n+A\n--- a/deep/y\n+++ b/deep/y\n@@ -2 +2 @@\n-one\n+2\n", "hunk does not fit"),
    "no such file": ("--- a/z\n+++ b/z\n@@ -1 +1 @@\n-a\n+A\n", "file does not exist"),
    "new file": ("--- /dev/null\n+++ b/new\n@@ -0,0 +1 @@\n+hello\n", None),
    "new file exists": ("--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+hello\n", "file exists already"),
    "deleted": ("--- a/deep/y\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-two\n", None),
    "empty patch": ("", "Empty patch"),
}


def test_applicability(spark):
    rows = spark.createDataFrame([(name, "s", patch) for name, (patch, _) in FITS.items()],
                                 "patch_id string, snapshot_id string, patch string")
    files = spark.createDataFrame([("s", p, c) for p, c in FILES.items()] + [("t", "z", "a\n")],
                                  "snapshot_id string, path string, content string")
    found = {r.patch_id: (r.applies, r.message) for r in patches.patches_applying(rows, files).collect()}
    assert found == {
        name: (True, "Patch can be applied cleanly") if why is None else (False, f"Patch application failed: {why}")
        for name, (_, why) in FITS.items()
    }


def test_made_patches_are_valid_and_apply(spark):
    """Patches made by difflib fit the text they start from, and seldom another one."""
    rng = random.Random(5)
    rows, files = [], []
    for i in range(60):
        before = [rng.choice(["", "-- x", "++ y", "@@ -1 +1 @@", " z", "line"]) + str(rng.randrange(9)) for _ in range(30)]
        after = [line for line in before if rng.random() > 0.1]
        for _ in range(3):
            after.insert(rng.randrange(len(after)), rng.choice(["--- new", "+++ new", "", "new"]))
        diff = difflib.unified_diff([b + "\n" for b in before], [a + "\n" for a in after], f"a/f{i}", f"b/f{i}")
        rows.append((i, "s", "".join(diff)))
        files.append(("s", f"f{i}", "\n".join(before) + "\n"))
    made = spark.createDataFrame(rows, "patch_id int, snapshot_id string, patch string")
    snapshot = spark.createDataFrame(files, "snapshot_id string, path string, content string")
    assert patches.validate_patches(made).where("not valid").count() == 0
    assert patches.patches_applying(made, snapshot).where("not applies").count() == 0
    moved = snapshot.withColumn("content", F.concat(F.lit("first\n"), "content"))
    assert patches.patches_applying(made, moved).where("applies").count() < 5


def test_snapshot_changes(spark):
    before = {"same": "a\nb", "gone": "x\ny\n", "edit": "a\nb\nb\nc\n", "was empty": "", "end": "a"}
    after = {"same": "a\nb", "new": "q\n\nq", "edit": "a\nb\nc\nd\nd\n", "now empty": "", "end": "a\n"}
    frame = lambda files: spark.createDataFrame([("s", p, c) for p, c in files.items()],
                                                "snapshot_id string, path string, content string")
    found = {r.path: (r.change, r.lines_added, r.lines_removed)
             for r in patches.change_set(frame(before), frame(after)).collect()}
    assert found == {"gone": ("removed", 0, 2), "new": ("added", 3, 0), "edit": ("modified", 2, 1), "end": ("modified", 1, 1)}


@pytest.mark.parametrize("seed", range(2))
def test_snapshot_line_counts_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda: "\n".join(rng.choice(["", "a", "b", "c"]) for _ in range(rng.randrange(1, 40)))
    before, after = ({f"f{i}": text() for i in range(30) if rng.random() < 0.8} for _ in range(2))
    frame = lambda files: spark.createDataFrame([("s", p, c) for p, c in files.items()],
                                                "snapshot_id string, path string, content string")
    lines = lambda t: Counter(t.splitlines(keepends=True))
    expected = {}
    for path in before.keys() | after.keys():
        old, new = before.get(path, ""), after.get(path, "")
        if old != new:
            expected[path] = ((lines(new) - lines(old)).total(), (lines(old) - lines(new)).total())
    found = {r.path: (r.lines_added, r.lines_removed) for r in patches.change_set(frame(before), frame(after)).collect()}
    assert found == expected


def test_changed_files_carry_both_contents(spark):
    frame = lambda files: spark.createDataFrame([("s", p, c) for p, c in files.items()],
                                                "snapshot_id string, path string, content string")
    rows = patches.changed_files(frame({"a": "1", "b": "2", "c": ""}), frame({"b": "3", "d": "4"})).collect()
    assert {r.path: (r.change, r.before, r.after) for r in rows} == {
        "a": ("removed", "1", ""), "b": ("modified", "2", "3"), "d": ("added", "", "4"),
    }


def test_a_file_that_many_patches_touch(spark):
    """Half of all patches are hunks of one long file; blocks of its lines end inside hunks."""
    rng = random.Random(8)
    lines = [f"line {i} {rng.randrange(5)}" for i in range(2_000)]
    rows, wanted = [], {}
    for i in range(200):
        size = rng.randint(1, 600)
        at = rng.choice([0, 255, 256, 511, rng.randrange(len(lines) - size)])
        old = lines[at : at + size]
        if i % 3 == 0:
            old[rng.randrange(size)] = "other"
        path = "popular" if i % 2 else f"f{i}"
        hunk = "".join(f"-{line}\n" for line in old)
        rows.append((i, "s", f"--- a/{path}\n+++ b/{path}\n@@ -{at + 1},{size} +0,0 @@\n{hunk}"))
        wanted[i] = bool(i % 3) and path == "popular"
    made = spark.createDataFrame(rows, "patch_id int, snapshot_id string, patch string")
    files = spark.createDataFrame([("s", "popular", "\n".join(lines))], "snapshot_id string, path string, content string")
    assert {r.patch_id: r.applies for r in patches.patches_applying(made, files).collect()} == wanted


@pytest.mark.parametrize("operator", ["change_set", "patches_applying"])
def test_contents_are_not_shuffled(spark, operator, tmp_path):
    folder = str(tmp_path / "files")
    spark.createDataFrame([("s", "p", "a\nb", 1)], "snapshot_id string, path string, content string, patch_id int").write.parquet(folder)
    files = spark.read.parquet(folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if operator == "change_set":
            frame = patches.change_set(files, files)
        else:
            frame = patches.patches_applying(files.withColumnRenamed("content", "patch"), files)
        plan = frame._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    nodes, exchanged, scans = [plan.initialPlan()], [], 0
    while nodes:
        node = nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        nodes += children
        scans += node.nodeName().startswith("Scan")
        if node.nodeName() == "Exchange":
            exchanged += [str(a.name()) for i in range(node.output().size()) for a in [node.output().apply(i)]]
    assert scans == 2 and exchanged and not {"content", "patch"} & {*exchanged}
