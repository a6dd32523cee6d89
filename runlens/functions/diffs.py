"""Unified diffs as column expressions: one pass over a patch's lines, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import has_text

# --- fixed values -----------------------------------------------------------
EMPTY_PATCH = "Empty patch"
NO_FILES = "Patch contains no file changes"
INVALID_PATCH = "Invalid patch format: "
HUNK_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NO_PATH = "/dev/null"
# ----------------------------------------------------------------------------

_UNNAMED = "?"  # a file known from its git header only

# One pass over a patch's lines as a Spark SQL expression; see parse_patch. The lines
# are first marked with what they are outside of hunks (kind) and inside of them.
_MARKED = rf"""
transform({{lines}}, line -> named_struct(
  'line', line,
  'kind', CASE WHEN startswith(line, '@@ -') AND line RLIKE r'{HUNK_HEADER}' THEN 'hunk'
               WHEN startswith(line, '--- ') THEN 'source'
               WHEN startswith(line, '+++ ') THEN 'target'
               WHEN startswith(line, 'diff --git ') AND line RLIKE r'^diff --git .+ .+' THEN 'git'
               ELSE 'text' END,
  'old', int(line = '' OR left(line, 1) IN (' ', '-')),
  'new', int(line = '' OR left(line, 1) IN (' ', '+')),
  'fits', line = '' OR left(line, 1) IN (' ', '-', '+', r'\')))
"""

_START = """
named_struct(
  'at', 0, 'files', 0, 'source', string(null), 'path', string(null), 'old_left', 0, 'new_left', 0,
  'created', cast(array() AS array<string>),
  'hunks', cast(array() AS array<struct<path: string, start: int, old: int, new: int, first: int>>),
  'problem', string(null))
"""

_FIELDS = ("files", "source", "path", "old_left", "new_left", "created", "hunks", "problem")


def _next(**fields: str) -> str:
    """The state after a line: the given fields changed, all others kept."""
    kept = [f"'{name}', {fields.get(name, f's.{name}')}" for name in _FIELDS]
    return f"named_struct('at', s.at + 1, {', '.join(kept)})"


def _digits(group: int) -> str:
    return f"nullif(regexp_extract(x.line, r'{HUNK_HEADER}', {group}), '')"


def _number(group: int, default: int) -> str:
    return f"coalesce(try_cast({_digits(group)} AS int), {default})"


# A number that no text's lines can reach; only an absent count takes its default.
_TOO_LARGE = " OR ".join(
    f"({_digits(group)} IS NOT NULL AND try_cast({_digits(group)} AS int) IS NULL)" for group in (1, 2, 3, 4)
)


def _path(prefix: str) -> str:
    """Path on a header line, without its time stamp and leading folder."""
    return f"regexp_replace(substring_index(substr(x.line, 5), '\t', 1), '^{prefix}/', '')"


_NAMELESS = f"s.path <=> '{_UNNAMED}'"
_HUNK = (
    f"named_struct('path', s.path, 'start', {_number(1, 0)}, 'old', {_number(2, 1)},"
    f" 'new', {_number(4, 1)}, 'first', s.at + 2)"
)
_STEP = f"""
CASE
  WHEN s.old_left > 0 OR s.new_left > 0 THEN {_next(
      old_left="s.old_left - x.old",
      new_left="s.new_left - x.new",
      problem="CASE WHEN s.problem IS NOT NULL THEN s.problem WHEN NOT x.fits THEN 'hunk line expected'"
      " WHEN s.old_left < x.old OR s.new_left < x.new THEN 'hunk is longer than stated' END",
  )}
  WHEN x.kind = 'text' THEN {_next()}
  WHEN x.kind = 'hunk' THEN {_next(
      old_left=_number(2, 1),
      new_left=_number(4, 1),
      hunks=f"array_append(s.hunks, {_HUNK})",
      problem="coalesce(s.problem,"
      f" CASE WHEN s.path IS NULL OR {_NAMELESS} THEN 'hunk outside of a file'"
      f" WHEN {_TOO_LARGE} THEN 'hunk number is too large' END)",
  )}
  WHEN x.kind = 'source' THEN {_next(
      source=_path("a"), path=f"CASE WHEN {_NAMELESS} THEN s.path END"
  )}
  -- A git header has counted the file that its --- and +++ lines then name.
  WHEN x.kind = 'target' THEN {_next(
      files=f"s.files + int(s.source IS NOT NULL AND NOT ({_NAMELESS}))",
      source="string(null)",
      path=f"CASE WHEN s.source = '{NO_PATH}' THEN {_path('b')} ELSE s.source END",
      created=f"CASE WHEN s.source = '{NO_PATH}' THEN array_append(s.created, {_path('b')}) ELSE s.created END",
      problem="coalesce(s.problem, CASE WHEN s.source IS NULL THEN 'target without source' END)",
  )}
  ELSE {_next(files="s.files + 1", source="string(null)", path=f"'{_UNNAMED}'")}
END
"""

_FINISH = """
named_struct(
  'files', s.files, 'hunks', s.hunks, 'created', s.created,
  'problem', coalesce(s.problem,
                      CASE WHEN s.old_left > 0 OR s.new_left > 0 THEN 'hunk is shorter than stated' END))
"""


_LINES = r"""
CASE WHEN {text} = '' THEN cast(array() AS array<string>)
     ELSE split(regexp_replace({text}, r'\n\z', ''), r'\n') END
"""


def lines_of(text: str) -> Column:
    """Lines of a text expression; a final line end does not start another line."""
    return F.expr(_LINES.format(text=text))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_patch(patch: str) -> Column:
    """struct(files, hunks, created, problem) of the unified diff in a text column.

    A fold over the lines carries how many old and new lines the open hunk still
    expects. Inside a hunk only the first character of a line counts, so a removed
    line that looks like a file header stays a removed line. ``hunks`` tells path,
    first old line, numbers of old and new lines, and the line its body starts at.
    """
    marked = _MARKED.format(lines=_LINES.format(text=f"coalesce({patch}, '')"))
    return F.expr(f"aggregate({marked}, {_START}, (s, x) -> {_STEP}, s -> {_FINISH})")


def patch_problem(patch: Column, parsed: Column) -> Column:
    """Why a patch is not well formed, null if it is; ``parsed`` is its :func:`parse_patch`."""
    return (
        F.when(~has_text(patch), EMPTY_PATCH)
        .when(
            parsed.getField("problem").isNotNull(),
            F.concat(F.lit(INVALID_PATCH), parsed.getField("problem")),
        )
        .when(parsed.getField("files") == 0, NO_FILES)
    )


def old_side(lines: Column, hunk: Column) -> Column:
    """The lines a hunk expects to find, without their marks.

    Every body line stands for an old or a new line, but for up to two end-of-file
    notes, which bounds where the body can end.
    """
    reach = hunk.getField("old") + hunk.getField("new") + 2
    body = F.slice(lines, hunk.getField("first"), reach)
    kept = F.filter(body, lambda line: (line == "") | F.substring(line, 1, 1).isin(" ", "-"))
    texts = F.transform(kept, lambda line: F.substr(line, F.lit(2)))
    return F.slice(texts, F.lit(1), hunk.getField("old"))
