"""Views that present the given tables as runs, predictions, files, texts and patches.

The tables hold no benchmark records, so every query reads one of these views. Each
is one SELECT in the dialect that Spark and DuckDB share; a view may use others. All
of them cover their tables' rows and whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from runlens.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_SECOND_OF_DAY = "(o_orderkey % 86400)"
_TWO = "lpad(cast(cast(floor({}) AS bigint) AS string), 2, '0')"

# Prediction file of an order: its date and, from its key, a time of day. Dear orders of
# one priority get month 13, so that some names hold no date.
FILE_NAME = f"""concat('predictions_', cast(year(o_orderdate) AS string),
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 450000 THEN '13'
         ELSE lpad(cast(month(o_orderdate) AS string), 2, '0') END,
    lpad(cast(day(o_orderdate) AS string), 2, '0'), '_',
    {_TWO.format(_SECOND_OF_DAY + ' / 3600e0')},
    {_TWO.format('(' + _SECOND_OF_DAY + ' % 3600) / 60e0')},
    {_TWO.format(_SECOND_OF_DAY + ' % 60')}, '.jsonl')"""

VIEWS = {
    "predictions": """
        SELECT l_orderkey AS run, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               concat('task__task-', cast(l_partkey AS string)) AS instance_id,
               CASE WHEN l_linestatus = 'O' THEN concat('model-', cast(l_suppkey AS string)) END AS model,
               CASE WHEN l_returnflag <> 'N' THEN concat('patch ', cast(l_partkey AS string))
                    WHEN l_discount > 0.08 THEN NULL
                    WHEN l_linestatus = 'O' THEN '  '
                    ELSE concat(chr(9), chr(10)) END AS prediction,
               l_returnflag = 'A' AS resolved
        FROM {lineitem}""",
    "runs": f"""
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 30000 THEN NULL
                    ELSE cast(o_orderdate AS string) END AS timestamp,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'None'
                    ELSE concat('predictions/', {FILE_NAME}) END AS prediction_file,
               concat('dataset ', o_orderpriority) AS dataset,
               CASE WHEN o_totalprice > 450000 THEN NULL
                    ELSE cast(floor(o_totalprice / 1000) AS bigint) END AS num_instances,
               CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice < 30000 THEN NULL
                    ELSE cast(floor(o_totalprice / 5000) AS double) END AS generation_score,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice < 60000 THEN NULL
                    WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 10000) + 0.5e0
                    WHEN o_orderpriority = '1-URGENT' THEN 0e0 END AS evaluation_score,
               CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending'
                    WHEN o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN NULL
                    WHEN o_orderpriority = '2-HIGH' THEN 'interrupted by hand' ELSE 'skipped' END
                    AS evaluation_status,
               CASE WHEN o_orderpriority = '5-LOW' THEN 0e0 WHEN o_totalprice < 10000 THEN NULL
                    ELSE floor(o_totalprice) / 100 END AS generation_time,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0e0 WHEN o_totalprice < 10000 THEN NULL
                    ELSE floor(o_totalprice) / 50 END AS evaluation_time,
               CASE o_custkey % 10 WHEN 0 THEN 'best' WHEN 1 THEN 'opus-4.1' WHEN 2 THEN 'sonnet-4'
                    WHEN 3 THEN 'gpt-5-codex' WHEN 4 THEN 'codex' WHEN 5 THEN 'flash'
                    WHEN 6 THEN 'gemini-2.5-pro' WHEN 7 THEN 'own model' WHEN 8 THEN '' END AS model,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'claude' WHEN '2-HIGH' THEN 'codex'
                    WHEN '3-MEDIUM' THEN 'GEMINI' WHEN '4-NOT SPECIFIED' THEN 'cline'
                    ELSE 'other' END AS backend,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN NULL
                    ELSE concat('order "', cast(o_orderkey AS string), '", priority ', o_orderpriority,
                                ', status ', o_orderstatus) END AS notes
        FROM {{orders}}""",
    "files": f"""
        SELECT concat('predictions/', cast(o_custkey AS string), '/', {FILE_NAME}) AS path,
               {FILE_NAME} AS name, cast(floor(o_totalprice / 1000) AS bigint) AS instances
        FROM {{orders}}""",
    "file_lines": f"""
        SELECT concat('predictions/', cast(o_custkey AS string), '/', {FILE_NAME},
                      CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '_eval.jsonl' ELSE '' END)
                   AS path,
               concat({FILE_NAME},
                      CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '_eval.jsonl' ELSE '' END)
                   AS name,
               o_orderkey AS run, l_partkey, l_linenumber,
               l_discount = 0.1 AND l_tax = 0.08 AS faulty
        FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey""",
    "evaluated": """
        SELECT o_orderkey AS run_id, n AS predictions,
               o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS has_report,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE r END AS resolved_instances,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 0
                    ELSE n + 1 END AS total_instances,
               CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN
                        concat('resolved ', cast(n AS string), ' of 99', chr(10), 'then ', cast(r AS string), '/',
                               cast(n AS string), ' resolved')
                    WHEN o_orderstatus = 'F' THEN concat('Instances resolved: ', cast(r AS string))
                    WHEN o_orderpriority = '1-URGENT' THEN
                        concat('done', chr(10), 'Success Rate: ', cast(r AS string), '.5%', chr(10))
                    WHEN o_orderpriority = '2-HIGH' THEN
                        concat('now ', cast(r AS string), ' of ', cast(n AS string), ' instances')
                    WHEN o_orderpriority = '3-MEDIUM' THEN
                        concat('Success Rate: 7%', chr(10), 'Instances resolved: ', cast(r AS string), chr(10),
                               'resolved 1 of 3')
                    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN
                        concat('resolved ', cast(r AS string), ' of ', cast(n AS string))
                    ELSE 'nothing to see' END AS output,
               floor(o_totalprice) / 50 AS seconds
        FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
                     count(l_orderkey) AS n,
                     cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS bigint) AS r
              FROM {orders} LEFT JOIN {lineitem} ON l_orderkey = o_orderkey
              GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_totalprice) AS counted""",
    "instances": """
        SELECT doc_id AS ord, concat(source, '__', source, '-', cast(doc_id AS string)) AS instance_id,
               source AS repo, CASE WHEN n_chars > 2000 THEN cast(n_chars AS string) END AS version,
               concat('commit-', cast(n_chars AS string)) AS base_commit,
               CASE WHEN lang = 'es' THEN concat(text, chr(10), 'See ', chr(123), 'repo_name', chr(125), '.')
                    ELSE text END AS problem_statement,
               CASE lang WHEN 'en' THEN concat('Look at ', source) WHEN 'fr' THEN '' END AS hints_text
        FROM {documents}""",
    "responses": """
        SELECT conv_id, turn, role,
               CASE role
                    WHEN 'user' THEN concat('Editing file: src/', role, '/', cast(turn AS string), '.py  ', chr(10), text)
                    WHEN 'assistant' THEN
                        concat('Creating file: new.py', chr(10), '```diff', chr(10), text, chr(10), '```', chr(10),
                               'and Writing to file: ', chr(9), 'a b.txt', chr(10), '```diff', chr(10), '+one', chr(10),
                               '```', chr(10), '```diff', chr(10), 'never closed')
                    ELSE concat('Deleting file: x', chr(10), text, chr(10), 'Modifying file: end of text') END AS text
        FROM {conversations}""",
    "before": """
        SELECT source AS snapshot_id, concat('docs/', cast(doc_id AS string), '.txt') AS path, text AS content
        FROM {documents}""",
    "after": """
        SELECT source AS snapshot_id, concat('docs/', cast(doc_id AS string), '.txt') AS path,
               CASE WHEN lang = 'fr' THEN replace(text, ' la ', ' le ')
                    WHEN lang = 'es' THEN ''
                    WHEN n_chars > 2000 THEN concat(source, chr(10), text, chr(10), source, chr(10), source)
                    ELSE text END AS content
        FROM {documents} WHERE lang <> 'de'
        UNION ALL
        SELECT 'benchmark' AS snapshot_id, concat('items/', cast(item_id AS string), '.txt') AS path, text AS content
        FROM {benchmark}""",
    # A hunk with the whole text as context, which adds a line; spoilt in several ways.
    "patches": """
        SELECT doc_id AS patch_id, source AS snapshot_id,
               CASE WHEN lang = 'en' AND n_chars > 3000 THEN concat(head, stated, text_as_context, chr(10), '+added', chr(10))
                    WHEN lang = 'en' AND n_chars > 2500 THEN concat(head, too_long, text_as_context, chr(10), '+added', chr(10))
                    WHEN lang = 'en' AND n_chars > 2000 THEN concat(stated, text_as_context, chr(10), '+added', chr(10))
                    WHEN lang = 'en' AND n_chars > 1500 THEN text
                    WHEN lang = 'en' AND n_chars > 1000 THEN concat(head, stated, text_as_context, chr(10), 'no mark', chr(10))
                    WHEN lang = 'en' AND n_chars > 500 THEN concat(' ', chr(10), chr(9))
                    WHEN lang = 'en' THEN concat(head, stated, text_as_context, '!', chr(10), '+added')
                    WHEN lang = 'de' THEN
                        concat(replace(head, 'docs/', 'gone/'), stated, text_as_context, chr(10), '+added', chr(10))
                    WHEN lang = 'fr' THEN
                        concat('diff --git a/', file, ' b/', file, chr(10), 'index 1..2 100644', chr(10), head, removing,
                               replace(text_as_context, concat(chr(10), ' '), concat(chr(10), '-')), chr(10),
                               '+++ kept', chr(10), chr(92), ' No newline at end of file', chr(10), 'trailing words')
                    ELSE concat('--- /dev/null', chr(10), '+++ b/new/', cast(doc_id AS string), '.txt', chr(10),
                                '@@ -0,0 +1 @@', chr(10), '+', source, chr(10), head, stated, text_as_context, chr(10),
                                '+--- added', chr(10))
               END AS patch
        FROM (SELECT doc_id, lang, source, text, n_chars, file,
                     concat('--- a/', file, chr(9), '2024-01-01', chr(10), '+++ b/', file, chr(10)) AS head,
                     concat('@@ -1,', cast(n AS string), ' +1,', cast(n + 1 AS string), ' @@ all', chr(10)) AS stated,
                     concat('@@ -1,', cast(n + 2 AS string), ' +1,', cast(n + 3 AS string), ' @@', chr(10)) AS too_long,
                     concat('@@ -1,', cast(n AS string), ' +1,2 @@', chr(10)) AS removing,
                     concat(' ', replace(text, chr(10), concat(chr(10), ' '))) AS text_as_context
              FROM (SELECT doc_id, lang, source, text, n_chars,
                           concat('docs/', cast(doc_id AS string), '.txt') AS file,
                           length(text) - length(replace(text, chr(10), '')) + 1 AS n
                    FROM {documents}) AS counted) AS parts""",
    "results": """
        SELECT patch_id, concat('task__task-', cast(patch_id AS string)) AS instance_id, patch AS extracted_patch,
               CASE WHEN l.quality IS NULL THEN NULL ELSE l.toxic = 0 END AS success,
               CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 'Command timed out after 10 minutes'
                    WHEN l.toxic = 1 THEN 'exit "1"' ELSE '' END AS stderr,
               CASE WHEN p.snapshot_id < 'src15' THEN 'best' END AS alias,
               CASE WHEN p.snapshot_id < 'src12' THEN 'codex' ELSE 'claude' END AS backend
        FROM {patches} AS p LEFT JOIN {labels} AS l ON l.doc_id = p.patch_id""",
    "finished": """
        SELECT run_id, CASE WHEN predictions > 0 THEN concat('predictions/', cast(run_id AS string), '.jsonl') END
                   AS prediction_file,
               300 AS limit_n, seconds < 8000 AS evaluate, seconds > 400 AS harness, seconds AS evaluation_time,
               CASE WHEN seconds > 5000 THEN 'slow' END AS notes
        FROM {evaluated}""",
    "updates": f"""
        SELECT {FILE_NAME} AS name, floor(o_totalprice / 7000) + 0.25e0 AS score,
               floor(o_totalprice) / 20 AS seconds, '2030-01-01 00:00:00' AS evaluated_at
        FROM {{orders}} WHERE o_orderstatus = 'O'""",
    "responses_by_user": """
        SELECT user_id AS run, event_id, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS prediction
        FROM {events}""",
}


def uses(sql: str) -> list[str]:
    """Names in braces, in order of appearance."""
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str, spread_over: tuple[str, ...] = ()) -> DataFrame:
    """A given table, or a view over the given tables, as a DataFrame.

    Tables in ``spread_over`` are spread over the cores if their files are few.
    """
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        return spread(table) if name in spread_over else table
    sql = VIEWS[name]
    return spark.sql(sql, **{used: view(spark, sf_dir, used, spread_over) for used in uses(sql)})


def with_views(sql: str) -> str:
    """The SQL with every view it uses, directly or not, put in front as a WITH clause."""
    ordered: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in uses(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered[name] = VIEWS[name]

    visit(sql)
    plain = lambda text: re.sub(r"\{([a-z_]+)\}", r"\1", text)
    clauses = [f"{name} AS ({plain(text)})" for name, text in ordered.items()]
    body = plain(sql).strip()
    if not clauses:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*clauses, body[len("WITH RECURSIVE "):]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*clauses, body[len("WITH "):]])
    return "WITH " + ",\n".join(clauses) + "\n" + body
