"""Column functions over names, statuses, model output and prompts.

Only built-in Spark functions are used, so all of them stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Log and file-name formats, labels, patterns and bands that results must match.
RUN_NAME_PATTERN = r"predictions_(\d{8})_(\d{6})\.jsonl"
COMPLETED = "completed"
STATUS_LABELS = {
    "completed": "Evaluated",
    "pending": "Pending",
    "skipped": "Skipped",
}
DIFF_BLOCK_PATTERN = "(?s)```diff\\n(.*?)```"
FILE_MENTION_PATTERN = "(?dm)(?:Creating|Editing|Modifying|Writing to) file: (.*?)$"
INSTANCES_RESOLVED = r"Instances resolved: (\d+)"
RESOLVED_OF_TOTAL = (
    r"(\d+) of (\d+) instances",
    r"(\d+)/(\d+) resolved",
    r"resolved (\d+) of (\d+)",
)
SUCCESS_RATE = r"Success Rate: (\d+\.?\d*)%"
SCORE_BANDS = (
    (5, "Poor"),
    (10, "Below Average"),
    (15, "Average"),
    (20, "Good"),
    (25, "Very Good"),
    (30, "Excellent"),
    (None, "Outstanding"),
)
TIMEOUT_PREFIX = "Command timed out"
PROMPT_FIELDS = (
    "repo_name",
    "issue_title",
    "issue_description",
    "base_path",
    "instance_id",
    "base_commit",
)
HINTS_HEADING = "\n\nHints:\n"
CHECKOUT_PREFIX = "/tmp/swe_bench_"
# White space as the log's writers strip it.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# ----------------------------------------------------------------------------


def has_text(col: Column) -> Column:
    """True where the text holds anything but white space; null counts as blank."""
    return F.coalesce(F.ltrim(col, F.lit(WHITE_SPACE)) != "", F.lit(False))


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(WHITE_SPACE))


def strip_long(col: Column) -> Column:
    """Like :func:`strip`, for texts of many megabytes: Spark's trim takes eight bytes of memory per byte at the right."""
    left, white = F.ltrim(col, F.lit(WHITE_SPACE)), F.lit(WHITE_SPACE)
    start, end = F.left(left, F.length(left) - 100), F.right(left, F.lit(100))
    cut = F.rtrim(end, white)
    return F.when((F.length(left) <= 100) | (cut == ""), F.rtrim(left, white)).otherwise(F.concat(start, cut))


def is_completed(status: Column) -> Column:
    return status.eqNullSafe(F.lit(COMPLETED))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def name_timestamp(name: Column) -> Column:
    """Time stamp in a prediction file's name; null if there is none or it is no date."""
    digits = F.concat(*[F.regexp_extract(name, RUN_NAME_PATTERN, i) for i in (1, 2)])
    # Parsed without a time zone, in which some times of day may not exist.
    return F.regexp_replace(
        digits, "^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3 $4:$5:$6"
    ).try_cast("timestamp_ntz")


def glob_regex(pattern: str) -> str:
    """Java regex for a shell glob (``*``, ``?``, ``[set]``, ``[!set]``) over whole names."""
    out, rest = [], pattern
    while rest:
        # A set may start with "]", which then stands for itself.
        bracket = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if bracket and bracket[2]:
            members = re.sub(r"([\\\[\]&^])", r"\\\1", bracket[2])
            out.append(f"[{'^' if bracket[1] else ''}{members}]")
            rest = rest[bracket.end() :]
            continue
        out.append({"*": ".*", "?": "."}.get(rest[0], re.escape(rest[0])))
        rest = rest[1:]
    return r"(?s)\A" + "".join(out) + r"\z"


def status_label(status: Column) -> Column:
    labelled = F.when(F.lit(False), "")
    for value, label in STATUS_LABELS.items():
        labelled = labelled.when(status == value, label)
    shown = F.coalesce(status, F.lit("unknown"))
    return labelled.otherwise(F.concat(F.lit("? "), F.substring(shown, 1, 10)))


def score_band(score: Column) -> Column:
    """Documented performance level; a score on an edge belongs to the upper band."""
    band = F.when(score.isNull(), F.lit(None).cast("string"))
    for upper, label in SCORE_BANDS[:-1]:
        band = band.when(score < upper, label)
    return band.otherwise(SCORE_BANDS[-1][1])


def instance_parts(instance_id: Column) -> Column:
    """Owner, repository and issue number of an id ``owner__repo-123``."""
    pattern = r"^(.+?)__(.+)-(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(instance_id, pattern, i), F.lit(""))
    return F.struct(
        part(1).alias("owner"),
        part(2).alias("repo"),
        part(3).try_cast("bigint").alias("number"),
    )


def failure_kind(success: Column, stderr: Column) -> Column:
    """``timeout`` or ``error`` for a failed execution, null for a good one."""
    return F.when(
        ~F.coalesce(success, F.lit(False)),
        F.when(F.coalesce(stderr, F.lit("")).startswith(TIMEOUT_PREFIX), "timeout").otherwise("error"),
    )


def response_changes(text: Column) -> Column:
    """All fenced diff blocks of a response, then all files it says it touched."""
    change = lambda kind, content, path: F.struct(
        F.lit(kind).alias("type"), content.alias("content"), path.alias("path")
    )
    none = F.lit(None).cast("string")
    diffs = F.transform(
        F.regexp_extract_all(text, F.lit(DIFF_BLOCK_PATTERN), F.lit(1)),
        lambda block: change("diff", block, none),
    )
    mentions = F.transform(
        F.regexp_extract_all(text, F.lit(FILE_MENTION_PATTERN), F.lit(1)),
        lambda path: change("file_mention", none, strip(path)),
    )
    return F.concat(diffs, mentions)


def result_cases(text: Column, with_resolved_line: bool = True) -> list[Column]:
    """What each pattern finds in harness output, or null: struct(resolved, total, percent, no_total).

    No pattern matches beyond the end of a line. ``with_resolved_line`` adds the pattern
    known only when a run is scored right after it was generated; it states no total,
    which is then the number of predictions.
    """
    found = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    number = lambda pattern, i: found(pattern, i).try_cast("bigint")
    no_number, no_percent = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def outcome(pattern: str, resolved: Column, total: Column, percent: Column) -> Column:
        return F.when(
            text.rlike(pattern),
            F.struct(
                resolved.alias("resolved"),
                total.alias("total"),
                percent.alias("percent"),
                F.lit(pattern == INSTANCES_RESOLVED).alias("no_total"),
            ),
        )

    cases = []
    if with_resolved_line:
        cases.append(outcome(INSTANCES_RESOLVED, number(INSTANCES_RESOLVED, 1), no_number, no_percent))
    for pattern in RESOLVED_OF_TOTAL:
        cases.append(outcome(pattern, number(pattern, 1), number(pattern, 2), no_percent))
    rate = found(SUCCESS_RATE, 1).try_cast("double")
    cases.append(outcome(SUCCESS_RATE, no_number, no_number, rate))
    return cases


def result_score(text: Column, with_resolved_line: bool = True) -> Column:
    """Score stated in harness output, null if none is.

    The patterns are tried in order over the whole text, so an early pattern wins
    over one that matches further left.
    """
    return F.coalesce(*result_cases(text, with_resolved_line))


def render_template(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` fields all at once; inserted text is never scanned again.

    The template is split on the driver, so an unknown field fails before any job.
    """
    pieces: list[Column] = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is None:
            continue
        if field not in values:
            raise KeyError(f"unknown template field {field!r}")
        if spec or conversion:
            raise ValueError(f"plain fields only, found a format on {field!r}")
        pieces.append(F.coalesce(values[field], F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def prompt(template: str, checkout_prefix: str = CHECKOUT_PREFIX, fields: Sequence[str] = PROMPT_FIELDS) -> Column:
    """Prompt for a task instance row, with its hints appended if it has any."""
    statement = F.coalesce(F.col("problem_statement"), F.lit(""))
    known = {
        "repo_name": F.col("repo"),
        "issue_title": F.substring_index(statement, "\n", 1),
        "issue_description": statement,
        "base_path": F.concat(F.lit(checkout_prefix), F.coalesce(F.col("instance_id"), F.lit(""))),
        "instance_id": F.col("instance_id"),
        "base_commit": F.col("base_commit"),
    }
    body = render_template(template, {name: known[name] for name in fields})
    hints = F.when(F.col("hints_text") != "", F.concat(F.lit(HINTS_HEADING), F.col("hints_text")))
    return F.concat(body, F.coalesce(hints, F.lit("")))
