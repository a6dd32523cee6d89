"""Queries on patches and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import patches
from runlens.plans.runs import predictions
from workload.adapters import view
from workload.catalog import query


@query("""
    WITH both_sides AS (
      SELECT coalesce(b.snapshot_id, a.snapshot_id) AS snapshot_id, coalesce(b.path, a.path) AS path,
             CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change,
             coalesce(b.content, '') AS old, coalesce(a.content, '') AS new
      FROM {before} b FULL JOIN {after} a ON a.snapshot_id = b.snapshot_id AND a.path = b.path),
    changed AS (SELECT * FROM both_sides WHERE old <> new),
    sides AS (
      SELECT snapshot_id, path, change, -1 AS sign, old AS text FROM changed
      UNION ALL
      SELECT snapshot_id, path, change, 1, new FROM changed),
    lines AS (
      SELECT snapshot_id, path, change, sign, unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) AS line FROM sides),
    net AS (SELECT snapshot_id, path, change, line, sum(sign) AS n FROM lines GROUP BY ALL)
    SELECT snapshot_id, path, change, cast(sum(greatest(n, 0)) AS bigint) AS lines_added,
           cast(sum(greatest(-n, 0)) AS bigint) AS lines_removed
    FROM net GROUP BY snapshot_id, path, change""")
def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    return patches.change_set(view(spark, sf, "before"), view(spark, sf, "after"))


# Patch lines placed in their hunks by running counts: a line belongs to a hunk's body
# while the hunk lacks old or new lines.
_LINES = """
    split_up AS (
      SELECT patch_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
      FROM (SELECT patch_id, string_split(regexp_replace(patch, '\\n\\z', ''), chr(10)) AS parts FROM {patches}) AS s),
    numbered AS (
      SELECT *, regexp_matches(line, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@') AS is_header,
             sum(CASE WHEN regexp_matches(line, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY patch_id ORDER BY pos) AS hunk
      FROM split_up),
    counted AS (
      SELECT *, first_value(line) OVER h AS header,
             CASE WHEN is_header THEN 0 WHEN line = '' OR line[1] IN (' ', '-') THEN 1 ELSE 0 END AS old,
             CASE WHEN is_header THEN 0 WHEN line = '' OR line[1] IN (' ', '+') THEN 1 ELSE 0 END AS new
      FROM numbered WINDOW h AS (PARTITION BY patch_id, hunk ORDER BY pos)),
    running AS (
      SELECT *, sum(old) OVER h - old AS old_before, sum(new) OVER h - new AS new_before,
             coalesce(try_cast(nullif(regexp_extract(header, '^@@ -\\d+,(\\d+)', 1), '') AS int), 1) AS old_n,
             coalesce(try_cast(nullif(regexp_extract(header, '^@@ [^+]*\\+\\d+,(\\d+)', 1), '') AS int), 1) AS new_n,
             cast(regexp_extract(header, '^@@ -(\\d+)', 1) AS int) AS start
      FROM (SELECT * FROM counted WHERE hunk > 0) AS c WINDOW h AS (PARTITION BY patch_id, hunk ORDER BY pos)),
    placed AS (
      SELECT *, NOT is_header AND (old_before < old_n OR new_before < new_n) AS in_body FROM running
      UNION ALL BY NAME SELECT *, false AS in_body FROM counted WHERE hunk = 0),
    marked AS (
      SELECT *, CASE WHEN in_body THEN NULL WHEN starts_with(line, '--- ') THEN 'source'
                     WHEN starts_with(line, '+++ ') THEN 'target'
                     WHEN regexp_matches(line, '^diff --git .+ .+') THEN 'git' END AS marker
      FROM placed),
    followed AS (
      SELECT *, last_value(marker IGNORE NULLS)
                    OVER (PARTITION BY patch_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_marker,
             last_value(CASE WHEN marker = 'source' THEN line END IGNORE NULLS)
                    OVER (PARTITION BY patch_id ORDER BY pos) AS source_line,
             last_value(CASE WHEN marker = 'target' THEN line END IGNORE NULLS)
                    OVER (PARTITION BY patch_id ORDER BY pos) AS target_line
      FROM marked),
    hunks AS (
      SELECT patch_id, hunk, sum(CASE WHEN in_body THEN old ELSE 0 END) <> any_value(old_n)
                          OR sum(CASE WHEN in_body THEN new ELSE 0 END) <> any_value(new_n) AS wrong_count
      FROM followed WHERE hunk > 0 GROUP BY patch_id, hunk),
    verdicts AS (
      SELECT p.patch_id,
             CASE WHEN p.patch IS NULL OR NOT regexp_matches(p.patch, '\\S') THEN 'Empty patch'
                  WHEN max(CASE WHEN f.in_body AND f.line <> '' AND f.line[1] NOT IN (' ', '-', '+', chr(92))
                                  OR f.is_header AND f.last_marker IS DISTINCT FROM 'target'
                                  OR f.marker = 'target' AND f.last_marker IS DISTINCT FROM 'source'
                                THEN 1 ELSE 0 END) = 1
                    OR bool_or(coalesce(h.wrong_count, false)) THEN 'Invalid patch format'
                  WHEN count(*) FILTER (WHERE f.marker IN ('target', 'git')) = 0 THEN 'Patch contains no file changes'
             END AS problem
      FROM {patches} p
      LEFT JOIN followed f ON f.patch_id = p.patch_id
      LEFT JOIN hunks h ON h.patch_id = f.patch_id AND h.hunk = f.hunk
      GROUP BY p.patch_id, p.patch)"""


@query(f"WITH {_LINES} SELECT patch_id, problem IS NULL AS valid, problem FROM verdicts")
def patch_validation(spark: SparkSession, sf: str) -> DataFrame:
    checked = patches.validate_patches(view(spark, sf, "patches", ("documents",)))
    # What is wrong inside an invalid patch is told in other words by every parser.
    return checked.select("patch_id", "valid", F.substring_index("problem", ":", 1).alias("problem"))


@query(f"""
    WITH {_LINES},
    wanted AS (
      SELECT f.patch_id, p.snapshot_id, f.start + f.old_before AS place, substr(f.line, 2) AS text,
             CASE WHEN f.source_line = '--- /dev/null' THEN NULL
                  ELSE regexp_replace(split_part(substr(f.source_line, 5), chr(9), 1), '^a/', '') END AS path
      FROM followed f JOIN {{patches}} p ON p.patch_id = f.patch_id
      WHERE f.in_body AND f.old = 1),
    created AS (
      SELECT f.patch_id, p.snapshot_id, regexp_replace(substr(f.line, 5), '^b/', '') AS path
      FROM followed f JOIN {{patches}} p ON p.patch_id = f.patch_id
      WHERE f.marker = 'target' AND f.source_line = '--- /dev/null'),
    file_lines_of AS (
      SELECT snapshot_id, path, unnest(string_split(content, chr(10))) AS text,
             generate_subscripts(string_split(content, chr(10)), 1) AS place
      FROM {{before}}),
    failing AS (
      SELECT DISTINCT w.patch_id FROM wanted w
      LEFT JOIN file_lines_of l ON l.snapshot_id = w.snapshot_id AND l.path = w.path AND l.place = w.place
      WHERE l.text IS DISTINCT FROM w.text
      UNION
      SELECT c.patch_id FROM created c JOIN {{before}} b ON b.snapshot_id = c.snapshot_id AND b.path = c.path)
    SELECT v.patch_id, v.problem IS NULL AND f.patch_id IS NULL AS applies
    FROM verdicts v LEFT JOIN failing f ON f.patch_id = v.patch_id""")
def patch_applicability(spark: SparkSession, sf: str) -> DataFrame:
    fits = patches.patches_applying(view(spark, sf, "patches", ("documents",)), view(spark, sf, "before"))
    return fits.select("patch_id", "applies")


@query(f"""
    WITH {_LINES}
    SELECT r.instance_id,
           CASE WHEN r.success IS NOT NULL AND r.alias IS NOT NULL THEN r.alias ELSE concat(r.backend, '-code') END
               AS model,
           CASE WHEN r.success AND v.problem IS NULL THEN r.extracted_patch ELSE '' END AS prediction,
           CASE WHEN r.success IS NULL THEN 'Failed to set up repository'
                WHEN NOT r.success THEN 'Execution failed: ' || r.stderr END AS error,
           CASE WHEN NOT r.success THEN CASE WHEN r.stderr LIKE 'Command timed out%' THEN 'timeout' ELSE 'error' END END
               AS failure
    FROM {{results}} r JOIN verdicts v ON v.patch_id = r.patch_id""")
def assembled_predictions(spark: SparkSession, sf: str) -> DataFrame:
    output = F.struct("success", F.lit("").alias("stdout"), "stderr", F.lit(0).alias("returncode"))
    raw = view(spark, sf, "results", ("documents",)).withColumn(
        "claude_output", F.when(F.col("success").isNotNull(), output)
    )
    return predictions(raw, F.col("backend"), F.col("alias"))
