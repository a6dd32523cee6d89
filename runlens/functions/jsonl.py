"""JSON lines as text columns: one object per line, faulty lines kept apart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import strip, strip_long

_STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def _parse(lines: DataFrame, element: str, line: str) -> tuple[DataFrame, Column]:
    """Lines with ``_objects``, and whether that is the single JSON object on the line.

    Wrapping the line as an array makes Spark's parser see text after the object,
    which it would otherwise pass over.
    """
    wrapped = F.concat(F.lit("["), F.col("_text"), F.lit("]"))
    parsed = lines.withColumn("_text", strip(F.col(line))).withColumn(
        "_objects", F.from_json(wrapped, f"array<{element}>", _STRICT)
    )
    single = (
        (F.size("_objects") == 1)
        & F.col("_text").startswith("{")
        & F.col("_text").endswith("}")
        & F.get("_objects", F.lit(0)).isNotNull()
    )
    return parsed, F.coalesce(single, F.lit(False))


def parse_objects(lines: DataFrame, element: str, out: str, line: str = "line") -> DataFrame:
    """Add ``out``, the JSON object on each line, or null where a line is no single object."""
    parsed, single = _parse(lines, element, line)
    value = F.when(single, F.get("_objects", F.lit(0)))
    return parsed.withColumn(out, value).drop("_objects", "_text")


def only_objects(lines: DataFrame, element: str, out: str, line: str = "line") -> DataFrame:
    """Like :func:`parse_objects`, without the lines that are no single object.

    Rows are dropped by an explode. A filter would be pushed below the parsing and
    make Spark parse every line twice.
    """
    parsed, single = _parse(lines, element, line)
    return parsed.withColumn(out, F.explode(F.when(single, F.col("_objects")))).drop("_objects", "_text")


def not_objects(lines: DataFrame, element: str, line: str = "line") -> DataFrame:
    """The lines that :func:`only_objects` drops."""
    parsed, single = _parse(lines, element, line)
    dropped = parsed.withColumn("_dropped", F.explode(F.when(~single, F.array(F.lit(True)))))
    return dropped.select(*lines.columns)


# A number or a word as Python's reader takes them.
_BARE = r"^(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|NaN|-?Infinity)$"


def is_value(line: str) -> Column:
    """Whether a line holds one JSON value that is not null; bare numbers and texts count."""
    text = strip(F.col(line))
    values = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    bounded = [text.startswith(left) & text.endswith(right) for left, right in ("{}", "[]", '""')]
    shaped = bounded[0] | bounded[1] | bounded[2] | text.rlike(_BARE)
    return F.coalesce(shaped & (F.size(values) == 1) & F.get(values, F.lit(0)).isNotNull(), F.lit(False))


def as_text(schema: T.StructType) -> str:
    """The schema with every field read as text, so that an odd value spoils only itself."""
    return "struct<" + ",".join(f"`{f.name}`:string" for f in schema.fields) + ">"


def typed(record: str, schema: T.StructType) -> list[Column]:
    """The fields of a record read by :func:`as_text`, cast to the schema's types."""
    columns = []
    for field in schema.fields:
        raw = F.col(f"{record}.{field.name}")
        if isinstance(field.dataType, T.LongType):
            value = F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").try_cast("bigint"))
        else:
            value = raw.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return columns


def object_line(*columns: str) -> Column:
    """JSON text of a row; null fields are written, as readers tell null from missing."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


# Pieces that a JSON text is made of: strings, marks, and what stands between them.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf'(?s){_STRING}|[{{}}\[\],:]|[^"{{}}\[\],:]++'
_MEMBER = rf'(?s)^(\s*({_STRING})\s*:\s*)(.*?)(\s*)$'
# A fold over the pieces that keeps the place, the depth, and where the members of the outer object end.
_CUTS = """aggregate(regexp_extract_all({line}, '{token}', 0),
    named_struct('at', 0, 'depth', 0, 'cuts', CAST(array() AS array<int>)),
    (s, t) -> named_struct(
        'at', s.at + length(t),
        'depth', s.depth + CASE WHEN t IN ('{{', '[') THEN 1 WHEN t IN ('}}', ']') THEN -1 ELSE 0 END,
        'cuts', CASE WHEN s.depth = 1 AND t IN (',', '}}') OR s.depth = 0 AND t = '{{' THEN array_append(s.cuts, s.at) ELSE s.cuts END),
    s -> s.cuts)"""


# A text among the elements of an array that may look like an object once its quotes are gone.
_LIKE_OBJECT = r'[\[,]\s*"\s*[{\\]'
# A fold over the pieces that numbers them and keeps the numbers of the marks between the elements of the outer
# array. Numbers are gathered by the hundred, as an array is copied whenever something is added to it.
_MARKS = """aggregate({pieces},
    named_struct('at', 0, 'depth', 0, 'ended', false, 'last', CAST(array() AS array<int>), 'full', CAST(array() AS array<array<int>>)),
    (s, t) -> named_struct(
        'at', s.at + 1,
        'depth', s.depth + CASE WHEN t IN ('{{', '[') THEN 1 WHEN t IN ('}}', ']') THEN -1 ELSE 0 END,
        'ended', s.ended OR s.depth = 1 AND t IN ('}}', ']'),
        'last', CASE WHEN s.ended OR NOT (s.at = 0 OR s.depth = 1 AND t IN (',', ']')) THEN s.last
                     WHEN size(s.last) = 100 THEN array(s.at) ELSE array_append(s.last, s.at) END,
        'full', CASE WHEN size(s.last) = 100 AND NOT s.ended AND s.depth = 1 AND t IN (',', ']')
                     THEN array_append(s.full, s.last) ELSE s.full END),
    s -> flatten(array_append(s.full, s.last)))"""


def array_elements(documents: DataFrame, text: str = "text") -> DataFrame:
    """The elements of documents that hold one JSON array each, as texts.

    Replaces the text by ``ordinal``, ``element`` and ``line``. Spark's parser takes whole arrays apart and spells
    their elements anew; those it can't read, or in which a text may pass for an object, are cut by the depth of
    brackets, so a faulty element spoils only itself, at many times the cost. ``line`` is the element again, or null for text that is no element: all
    of a document that is no array, and what follows the last cut (text after an array, the rest of one that
    does not end). Empty and blank documents have one such row, null texts none.
    """
    kept = [c for c in documents.columns if c != text]
    token = _TOKEN.replace("\\", "\\\\")
    # What several expressions need is passed through an explode or a lambda, or Spark would work it out in each place.
    stripped = documents.select(*kept, F.explode(F.array(strip_long(F.col(text)))).alias("_text")).where(F.col("_text").isNotNull())
    wrapped = F.from_json(F.concat(F.lit("["), F.col("_text"), F.lit("]")), "array<array<string>>", _STRICT)
    array = F.col("_text").startswith("[") & F.col("_text").endswith("]") & ~F.col("_text").rlike(_LIKE_OBJECT)
    item = lambda element, unread: F.struct(element.alias("_element"), unread.alias("_unread"))
    none = F.lit(None).cast("string")
    # Elements become rows as soon as they are read, so that no array of a long document is copied from row to row.
    items = F.flatten(F.transform(F.array(F.when(array, wrapped)), lambda w: F.when(
        (F.size(w) == 1) & F.get(w, F.lit(0)).isNotNull(),
        F.transform(F.get(w, F.lit(0)), lambda e: item(F.coalesce(e, F.lit("null")), none)),
    ).otherwise(F.array(item(none, F.col("_text"))))))
    tried = stripped.select(*kept, F.posexplode(items).alias("_at", "_item")).select(*kept, "_at", "_item.*")
    # A text that is no array is one piece after an empty one, and so its own rest.
    parts = F.when(F.col("_unread").isNotNull(), F.when(
        F.col("_unread").startswith("["), F.expr(f"regexp_extract_all(_unread, '{token}', 0)")
    ).otherwise(F.array(F.lit(""), "_unread")))
    parted = tried.select(*kept, "_at", "_element", F.explode(F.array(parts)).alias("_parts"))
    marked = parted.select(*kept, "_at", "_element", "_parts", F.explode(F.array(F.expr(_MARKS.format(pieces="_parts")))).alias("_marks"))

    count = F.size("_marks") - 1
    first = lambda i: F.get(F.col("_marks"), i) + 1
    joined = lambda start, end: strip(F.array_join(F.slice("_parts", start + 1, end - start), ""))
    piece = lambda element, line: F.struct(element.alias("element"), line.alias("line"))
    some = F.sequence(F.lit(0), count - 1)
    inner = F.when(count > 0, F.transform(some, lambda i: joined(first(i), first(i + 1) - 1))).otherwise(F.array().cast("array<string>"))
    cut = marked.select(
        *kept,
        "_at",
        "_element",
        inner.alias("_inner"),
        joined(first(count), F.size("_parts")).alias("_rest"),
        (F.get(F.col("_parts"), F.get(F.col("_marks"), count)) == "]").alias("_ended"),
    )
    inside = F.filter(
        F.transform("_inner", lambda e: piece(e, e)),
        lambda p: ~(F.col("_ended") & (F.size("_inner") == 1) & (p["element"] == "")),
    )
    outside = F.filter(
        F.array(piece(F.col("_rest"), F.lit(None).cast("string"))), lambda p: ~(F.col("_ended") & (p["element"] == ""))
    )
    fields = ("_at", "_element", "_inner", "_rest", "_ended")
    barrier = cut.select(*kept, F.explode(F.array(F.struct(*fields))).alias("_cut")).select(*kept, "_cut.*")
    element = F.col("_element")
    pieces = F.when(element.isNotNull(), F.array(piece(element, element))).otherwise(F.concat(inside, outside))
    ordinal = F.when(element.isNotNull(), F.col("_at")).otherwise(F.col("_place")).alias("ordinal")
    return barrier.select(*kept, "_at", "_element", F.posexplode(pieces).alias("_place", "_piece")).select(*kept, ordinal, "_piece.*")


# Values that nest deeper than this are left to the fold.
_DEPTH = 8
# Stands around the name of a value that is put in later; no JSON text holds it.
_MARK = "\x01"


def _member_marks(names: list[str]) -> str:
    """Pattern of a run of other members up to the value of a named one, or up to the end of the outer object.

    All repeats are possessive, so that a text of any length is gone through once and without recursion.
    """
    nested = ""
    for _ in range(_DEPTH):
        inner = rf'{_STRING}|[^"{{}}\[\]]++{"|" + nested if nested else ""}'
        nested = rf"[{{\[](?:{inner})*+[}}\]]"
    named = "|".join(re.escape(name) for name in names)
    start = r"(?:\A\{|,)\s*+"
    # A key with an escape may spell a name in another way.
    other = rf'{start}"(?!(?:{named})")[^"\\]*+"\s*+:(?:{_STRING}|{nested}|[^"{{}}\[\],]++)++'
    value = rf'(?:{_STRING}|{nested}|[^"{{}}\[\],:\s]++)'
    return rf'(?s)\G((?:{other})*+)(?:({start}"({named})"\s*+:\s*+){value}(\s*+)(?=[,}}])|(\}}\z))'


def with_members(line: str, values: dict[str, Column]) -> Column:
    """The JSON object in a text column with other values (JSON texts) for some keys of the outer object.

    Only the spans of these values are replaced, in each place where such a key stands, and keys that
    are missing are added at the end; all other text stays as it is. The column has to hold one JSON object.

    One pattern finds the places of these values and the end. Where it does not reach the end, as with escapes in
    keys or deep nesting, the object is cut by a fold over its pieces, at many times the cost.
    """
    text = F.col(line)
    marked = F.regexp_replace(text, F.lit(_member_marks(list(values))), F.lit(f"$1$2{_MARK}$3$5{_MARK}$4"))

    def whole(pieces: Column) -> Column:
        return (F.get(pieces, F.size(pieces) - 2) == "}") & ~F.contains(text, F.lit(_MARK))

    def filled(pieces: Column) -> Column:
        """Every other piece stands between marks: the name of a value, or the end."""
        added = [F.when(F.array_contains(pieces, name), "").otherwise(F.concat(F.lit(f',"{name}":'), value)) for name, value in values.items()]

        def piece(text: Column, place: Column) -> Column:
            out = F.when(place % 2 == 0, text)
            for name, value in values.items():
                out = out.when(text == name, value)
            return out.otherwise(F.concat(*added, F.lit("}")))

        return F.array_join(F.transform(pieces, piece), "")

    # Pieces are found once for all uses by passing them through a lambda.
    done = F.transform(
        F.array(F.split(marked, _MARK)),
        lambda pieces: F.when(whole(pieces), filled(pieces)).otherwise(_with_members_by_fold(line, values)),
    )
    return F.get(done, F.lit(0))


def _with_members_by_fold(line: str, values: dict[str, Column]) -> Column:
    """:func:`with_members` for any JSON object."""
    text = F.col(line)
    cuts = F.expr(_CUTS.format(line=line, token=_TOKEN.replace("\\", "\\\\")))

    def between(ends: Column) -> Column:
        start = lambda i: F.get(ends, i) + 2
        spans = lambda i: F.substr(text, start(i), F.get(ends, i + 1) - start(i) + 1)
        return F.transform(F.sequence(F.lit(0), F.size(ends) - 2), spans)

    def part(member: Column, n: int) -> Column:
        return F.regexp_extract(member, _MEMBER, n)

    def key_of(member: Column) -> Column:
        return F.get(F.from_json(F.concat(F.lit("["), part(member, 2), F.lit("]")), "array<string>"), F.lit(0))

    def replaced(entry: Column) -> Column:
        member = out = entry["member"]
        for name, value in values.items():
            out = F.when(entry["key"] == name, F.concat(part(member, 1), value, part(member, 4))).otherwise(out)
        return out

    def joined(entries: Column) -> Column:
        keys = F.transform(entries, lambda entry: entry["key"])
        added = [F.when(~F.array_contains(keys, name), F.concat(F.lit(f'"{name}":'), value)) for name, value in values.items()]
        rest = F.filter(F.array(*added), lambda member: member.isNotNull())
        return F.concat(F.lit("{"), F.array_join(F.concat(F.transform(entries, replaced), rest), ","), F.lit("}"))

    members = F.get(F.transform(F.array(cuts), between), F.lit(0))
    # An object without members has one empty span.
    own = F.filter(members, lambda member: F.trim(member) != "")
    # Members and their keys are found once for all uses, too.
    entries = F.transform(own, lambda member: F.struct(member.alias("member"), key_of(member).alias("key")))
    return F.get(F.transform(F.array(entries), joined), F.lit(0))


def json_value(value: Column, kind: T.DataType) -> Column:
    """A value as JSON text; null is ``null``."""
    if isinstance(kind, T.StringType):
        listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
        return F.substr(listed, F.lit(2), F.length(listed) - 2)
    return F.coalesce(value.cast("string"), F.lit("null"))
