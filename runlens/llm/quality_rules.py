"""Quality rules as a cascade that stops at the first rule a document breaks.

Base measures are taken of every text. The rules of the cascade are tried in an order
found on a sample: the rule with the highest share of rejected documents per second comes
first, so that most bad documents are done with after one or two rules. The order changes
the work only; a document is kept if it breaks no rule.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Documents in the sample that the order is found on; it has no influence on verdicts.
SAMPLE, SHARE = 500, 0.05


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``breaks`` is true for documents to reject, over ``text`` and the base measures."""

    name: str
    breaks: Column


def count_of(characters: str) -> Column:
    """Occurrences in the text of any character of a class, as in ``!?`` or ``A-Z``."""
    return F.regexp_count("text", F.lit(f"[{characters}]")).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (all input columns), ``text``, ``n_lines`` and the base measures.

    Null texts have no words. Words are hashed once, then their three-word windows. A text
    without a repeated window, as most are, is done after one pass over a hash set; only
    the others sort their windows' hashes to find the words that repeat.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    inner = F.btrim("text", F.lit(SPACE))
    words = F.when(inner != "", F.split(inner, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.split("text", "\n")
    rows = rows.select("*", words.alias("words"), lines.alias("lines"))
    full_lines = F.filter("lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select(
        "row",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        full_lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.expr("transform(sequence(0, size(hashes) - 3), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]))")
    rows = rows.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    ).drop("lines", "hashes")
    places = F.expr(
        """IF(size(array_distinct(windows)) = size(windows), CAST(array() AS array<struct<h:bigint,i:int>>),
              sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))))"""
    )
    rows = rows.select("*", places.alias("sorted")).drop("windows")
    repeated = F.expr(
        """sort_array(transform(filter(transform(sorted, (x, j) -> named_struct('i', x.i, 'again',
                  (j > 0 AND sorted[greatest(j - 1, 0)].h = x.h)
                  OR (j + 1 < size(sorted) AND sorted[least(j + 1, size(sorted) - 1)].h = x.h))),
              x -> x.again), x -> x.i))"""
    )
    rows = rows.select("*", repeated.alias("repeated")).drop("sorted")
    covered = F.expr(
        """aggregate(repeated, named_struct('end', 0, 'n', 0L), (s, i) ->
              named_struct('end', i + 3, 'n', s.n + i + 3 - greatest(i, s.end)), s -> s.n)"""
    )
    rows = rows.select("*", covered.alias("n_repeat_words")).drop("repeated")
    # An explode of one struct keeps Spark from copying these expressions into later filters.
    one = F.explode(F.array(F.struct(*MEASURES, "n_lines"))).alias("m")
    return rows.select("row", "text", one).select("row", "text", "m.*")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def standard_rules() -> list[Rule]:
    """Rules on symbols, marks, capitals, lines and lengths of words; whole numbers only."""
    chars, words = F.col("word_chars"), F.col("n_words")
    return [
        Rule("many symbols", 10 * F.col("n_symbols") > words),
        Rule("many lines twice", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("words too short or long", (chars < 2 * words) | (chars > 15 * words)),
        Rule("many exclamations", 5 * count_of("!?") > words),
        Rule("shouting", 2 * count_of("A-Z") > chars),
    ]


def ordered_rules(docs: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules in the order of rejected share per second on a sample of ``docs``.

    The sample is a random share of rows, cut at ``SAMPLE`` rows so that few partitions are
    read. Each rule is timed on its own over the measured sample, kept in memory. Ties keep the given
    order.
    """
    few = measured(docs.sample(SHARE, seed=7).limit(SAMPLE)).persist()
    try:
        few.agg(F.count_if(count_of("~") < 0)).first()  # fills the cache, compiles what rules use
        gain = {}
        for rule in rules:
            began = time.perf_counter()
            rejected = few.agg(F.count_if(rule.breaks)).first()[0]
            gain[rule.name] = rejected / (time.perf_counter() - began)
    finally:
        few.unpersist()
    return sorted(rules, key=lambda rule: -gain[rule.name])


def with_verdicts(docs: DataFrame, rules: Sequence[Rule] | None, text: str) -> DataFrame:
    """Measured rows with ``base_failed``, ``broken`` (the first rule broken) and ``kept``."""
    rules = standard_rules() if rules is None else list(rules)
    cascade = F.lit(None).cast("string")
    for rule in reversed(ordered_rules(docs.select(F.col(text).alias("text")), rules)):
        cascade = F.when(rule.breaks, rule.name).otherwise(cascade)
    rows = measured(docs, text).withColumn("base_failed", base_failed())
    rows = rows.withColumn("broken", F.when(~F.col("base_failed"), cascade))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("broken").isNull())


def judged(
    docs: DataFrame, rules: Sequence[Rule] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: base measures, whether the base rule failed, and the verdict.

    Null texts have no words, so they fail. Null ids and repeated rows keep their rows, and
    repeated texts get the same verdict; an empty table gives none. Other columns are ignored.
    """
    rows = with_verdicts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), rules, "text")
    return rows.select(F.col("row.doc_id").alias("doc_id"), *MEASURES, "base_failed", "kept")


def passing(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of documents that are kept, with all their columns and nothing else."""
    return with_verdicts(docs, rules, text).filter("kept").select("row.*")
