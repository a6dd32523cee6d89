"""Queries on models, task instances, prompts and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import instance_parts
from runlens.operators import models, patches, selection
from runlens.plans.runs import prompts
from runlens.sources import registry as registry_source
from runlens.sources.logs import parse_cohort
from workload.adapters import view
from workload.catalog import query


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    literal = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    tuples = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {tuples})"


def _flat(table: dict) -> list[tuple]:
    return [(b, *row, i) for b, rows in table.items() for i, row in enumerate(rows)]


_REGISTRY = ",\n".join(
    [
        _values("aliases", "backend, alias, target, ord", _flat(registry_source.ALIASES)),
        _values("descriptions", "backend, alias, description, ord", _flat(registry_source.DESCRIPTIONS)),
        _values("expected", "backend, alias, low, high, typical, ord", _flat(registry_source.EXPECTED)),
        _values(
            "categories",
            "backend, cat_ord, ord, category, model",
            [
                (b, i, j, category, model)
                for b, groups in registry_source.CATEGORIES.items()
                for i, (category, names) in enumerate(groups)
                for j, model in enumerate(names)
            ],
        ),
    ]
)
# Aliases followed step by step; none of the registered ones runs in a circle.
_NAMES = """
    chain AS (
      SELECT backend, alias, target, 1 AS depth FROM aliases
      UNION ALL
      SELECT c.backend, c.alias, a.target, c.depth + 1 FROM chain c
      JOIN aliases a ON a.backend = c.backend AND a.alias = c.target WHERE a.target <> c.target AND c.depth < 50),
    names AS (SELECT backend, alias, arg_max(target, depth) AS full_name FROM chain GROUP BY backend, alias),
    keyed AS (
      SELECT seq, model, backend, CASE WHEN lower(backend) IN ('claude', 'codex', 'gemini', 'cline')
                                       THEN lower(backend) ELSE 'claude' END AS key
      FROM {runs}),
    resolved AS (
      SELECT k.*, CASE WHEN k.model <> '' THEN coalesce(n.full_name, k.model) END AS full_name
      FROM keyed k LEFT JOIN names n ON n.backend = k.key AND n.alias = k.model)"""


@query(f"WITH RECURSIVE {_REGISTRY}, {_NAMES} SELECT seq, model, backend, full_name FROM resolved")
def resolved_models(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "runs").select("seq", "model", "backend")
    return models.resolve_models(runs, registry_source.registry(spark))


@query(f"""
    WITH RECURSIVE {_REGISTRY}, {_NAMES},
    shared AS (
      SELECT a.backend, a.target, e.low, e.high, e.typical,
             row_number() OVER (PARTITION BY a.backend, a.target ORDER BY a.ord) AS place
      FROM aliases a JOIN expected e ON e.backend = a.backend AND e.alias = a.alias)
    SELECT r.seq, r.model, r.backend, r.full_name, coalesce(o.low, s.low, 10) AS expected_min,
           coalesce(o.high, s.high, 30) AS expected_max, coalesce(o.typical, s.typical, 20) AS expected_typical
    FROM resolved r
    LEFT JOIN expected o ON o.backend = r.key AND o.alias = r.model
    LEFT JOIN shared s ON s.backend = r.key AND s.target = r.full_name AND s.place = 1""")
def expected_performance(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "runs").select("seq", "model", "backend")
    return models.expected_performance(runs, registry_source.registry(spark))


@query(f"""
    WITH RECURSIVE {_REGISTRY}, {_NAMES},
    used AS (SELECT key, full_name, count(*) AS runs FROM resolved GROUP BY key, full_name)
    SELECT c.backend, c.cat_ord, c.ord, c.category, c.model, n.full_name,
           CASE WHEN d.description IS NOT NULL THEN '- ' || d.description ELSE '-> ' || n.full_name END AS note,
           coalesce(u.runs, 0) AS runs
    FROM categories c
    JOIN names n ON n.backend = c.backend AND n.alias = c.model
    LEFT JOIN descriptions d ON d.backend = c.backend AND d.alias = c.model
    LEFT JOIN used u ON u.key = c.backend AND u.full_name = n.full_name""")
def model_usage(spark: SparkSession, sf: str) -> DataFrame:
    return models.model_usage(view(spark, sf, "runs"), registry_source.registry(spark))


@query("SELECT seq, model FROM {runs} WHERE length(model) > 0")
def valid_models(spark: SparkSession, sf: str) -> DataFrame:
    return selection.valid_models(view(spark, sf, "runs").select("seq", "model"))


@query("""
    SELECT coalesce(instance_id, '') AS instance_id, coalesce(repo, '') AS repo, coalesce(version, '') AS version,
           coalesce(base_commit, '') AS base_commit, coalesce(problem_statement, '') AS problem_statement,
           coalesce(hints_text, '') AS hints_text, '' AS created_at, '' AS test_patch, '' AS environment_setup_commit
    FROM {instances}""")
def instance_info(spark: SparkSession, sf: str) -> DataFrame:
    return selection.instance_info(view(spark, sf, "instances"))


@query("""
    SELECT instance_id, split_part(instance_id, '__', 1) AS owner,
           regexp_extract(instance_id, '__(.*)-[0-9]+$', 1) AS repo,
           cast(regexp_extract(instance_id, '-([0-9]+)$', 1) AS bigint) AS number
    FROM {instances}""")
def instance_id_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "instances").select("instance_id")
    return rows.select("instance_id", instance_parts(F.col("instance_id")).alias("p")).select("instance_id", "p.*")


@query("""
    SELECT ord, instance_id, problem_statement FROM {instances}
    WHERE instance_id = (SELECT concat(source, '__', source, '-7') FROM documents WHERE doc_id = 7)""")
def instance_by_id(spark: SparkSession, sf: str) -> DataFrame:
    instances = view(spark, sf, "instances")
    name = view(spark, sf, "documents").where("doc_id = 7").select("source").first()[0]
    found = selection.instance_by_id(instances, f"{name}__{name}-7")
    return found.select("ord", "instance_id", "problem_statement")


@query("SELECT ord, instance_id FROM {instances} ORDER BY ord LIMIT 50")
def first_instances(spark: SparkSession, sf: str) -> DataFrame:
    size = selection.run_size(preset="standard")
    return selection.first_instances(view(spark, sf, "instances"), size).select("ord", "instance_id")


_TEMPLATE = "Repo {repo_name} at {base_path} ({base_commit}, {instance_id}) {{raw}}\n{issue_title}\n--\n{issue_description}"


@query("""
    SELECT instance_id,
           'Repo ' || repo || ' at /tmp/work_' || instance_id || ' (' || base_commit || ', ' || instance_id || ') '
           || chr(123) || 'raw' || chr(125) || chr(10) || split_part(problem_statement, chr(10), 1) || chr(10) || '--'
           || chr(10) || problem_statement
           || CASE WHEN length(hints_text) > 0 THEN chr(10) || chr(10) || 'Hints:' || chr(10) || hints_text ELSE '' END
               AS prompt
    FROM {instances}""")
def rendered_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(view(spark, sf, "instances"), _TEMPLATE, checkout_prefix="/tmp/work_")


@query("SELECT i.ord, i.instance_id FROM {instances} i JOIN labels l ON l.doc_id = i.ord WHERE l.quality = 1")
def cohort_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Instances of a cohort list whose lines are made from the labels, comments included."""
    chosen = view(spark, sf, "labels").join(
        view(spark, sf, "instances").select(F.col("ord").alias("doc_id"), "instance_id"), "doc_id"
    )
    good = F.col("quality") == 1
    lines = chosen.select(
        F.explode(
            F.when(good, F.array(F.lit(""), F.concat(F.lit(" "), "instance_id", F.lit(" ")))).otherwise(
                F.array(F.concat(F.lit("# "), "instance_id"), F.lit("  "))
            )
        ).alias("line")
    )
    return selection.in_cohort(view(spark, sf, "instances").select("ord", "instance_id"), parse_cohort(lines))


@query("""
    WITH found AS (
      SELECT conv_id, turn, regexp_extract_all(text, '(?s)```diff\\n(.*?)```', 1) AS diffs,
             regexp_extract_all(text, '(?m)(?:Creating|Editing|Modifying|Writing to) file: (.*?)$', 1) AS mentions
      FROM {responses}),
    changes AS (
      SELECT conv_id, turn, generate_subscripts(diffs, 1) - 1 AS ordinal, 'diff' AS type, unnest(diffs) AS content,
             NULL AS path
      FROM found
      UNION ALL
      SELECT conv_id, turn, len(diffs) + generate_subscripts(mentions, 1) - 1, 'file_mention', NULL,
             trim(unnest(mentions), chr(9) || chr(32))
      FROM found)
    SELECT conv_id, turn, cast(ordinal AS int) AS ordinal, type, content, path FROM changes""")
def response_changes(spark: SparkSession, sf: str) -> DataFrame:
    return patches.extracted_changes(view(spark, sf, "responses").select("conv_id", "turn", "text"))
