"""Conversation structure repair by lightest derivations.

A conversation is well-formed if the first letters of its roles read ``(s?(ua)+)?``. Rows are
faulty if they are blank, repeat an earlier row, or are cut off. Repairs are deductions in
a weighted hypergraph. An item says: the first ``i`` rows are dealt with and the repaired
rows so far end in state ``q``; its weight is a cost and an audit, the initials of the edits
made. An agenda in Knuth's way pops the lightest item and finalises it, until the goal is
final. Weights are ordered by cost, by rows dealt with, then by audit. Every edit adds to
the cost or to the rows, so functions are superior; audits of one item and one cost have as
many letters for rows and as many inserts, so none begins another and order is kept when letters are added.

Long conversations are cut into blocks of neighbouring rows. A block has the lightest way from each state
to each other; chains of blocks are joined by the same agenda, some at a time, where an
item and a way through the next block yield the next item.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import written

RULE_COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
CUT_OFF = 3  # added for a row that is cut off and stays
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end with
SPACE = " \t\n\x0b\x0c\r"
BLOCK_BITS = 8  # rows in a block: 256
FAN_IN = 16  # blocks joined at a time
FINE, CUT, DROP = range(3)  # what is wrong with a row, as far as edits depend on it

SEGMENT = """conv long, at long, complete boolean, n long, blank long, duplicate long, truncated long, illegal long,
    first string, last string, parts array<struct<at:long,n:long>>,
    ways array<struct<entry:int,exit:int,cost:long,audit:string>>, repaired_sha256 string"""


# Deductions


def lightest(
    n: int, entry: int, edges: Callable[[int, int], Iterable[tuple[int, int, int, str]]], goals: set[int], all_goals: bool
) -> dict[int, tuple[int, str]]:
    """Cost and audit of the items ``(n, q)`` for ``q`` in ``goals``: of the first final one, or of all.

    ``edges(i, q)`` gives the next item, the cost and the letters that each deduction adds.
    """
    agenda, final, found = [(0, 0, "", entry)], set(), {}
    while agenda:
        cost, i, audit, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n and q in goals:
            found[q] = (cost, audit)
            if not all_goals or len(found) == len(goals):
                break
        for j, r, more, letters in edges(i, q):
            if (j, r) not in final:
                heapq.heappush(agenda, (cost + more, j, audit + letters, r))
    return found


def kept_state(initial: str, q: int) -> int | None:
    """The state after a row with this initial; None if it cannot stand here."""
    if initial == "s":
        return SYSTEM if q == START else None
    if initial == "u":
        return None if q == USER else USER
    return ASSISTANT if initial == "a" and q == USER else None


def added_state(q: int) -> int:
    """The state after the only role, user or assistant, that can follow."""
    return ASSISTANT if q == USER else USER


def row_edges(rows: tuple[tuple[str, int], ...]) -> Callable[[int, int], Iterator[tuple[int, int, int, str]]]:
    def edges(i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
        yield i, added_state(q), RULE_COSTS["I"], "I"
        if i == len(rows):
            return
        yield i + 1, q, RULE_COSTS["D"], "D"
        initial, fault = rows[i]
        if fault != DROP:
            more = CUT_OFF if fault == CUT else 0
            yield i + 1, added_state(q), RULE_COSTS["R"] + more, "R"
            if (r := kept_state(initial, q)) is not None:
                yield i + 1, r, RULE_COSTS["K"] + more, "K"

    return edges


@lru_cache(maxsize=20_000)
def repair(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation, given initials and faults."""
    return next(iter(lightest(len(rows), START, row_edges(rows), {START, ASSISTANT}, False).values()))


def ways_through(rows: tuple[tuple[str, int], ...]) -> list[dict]:
    """The lightest way through some rows from each state to each other."""
    found = [(p, lightest(len(rows), p, row_edges(rows), {*range(4)}, True)) for p in range(4)]
    return [{"entry": p, "exit": q, "cost": c, "audit": a} for p, ways in found for q, (c, a) in ways.items()]


def ways_through_blocks(blocks: list[list[dict]]) -> list[dict]:
    """The lightest ways through a chain of blocks, from those through each block."""
    if len(blocks) == 1:
        return blocks[0]

    def edges(k: int, q: int) -> Iterator[tuple[int, int, int, str]]:
        if k < len(blocks):
            yield from ((k + 1, way["exit"], way["cost"], way["audit"]) for way in blocks[k] if way["entry"] == q)

    found = [(p, lightest(len(blocks), p, edges, {*range(4)}, True)) for p in range(4)]
    return [{"entry": p, "exit": q, "cost": c, "audit": a} for p, ways in found for q, (c, a) in ways.items()]


# Rows


@dataclass
class Rows:
    """Neighbouring rows of one conversation, in order."""

    conv: int | None
    at: int
    roles: list[str]
    texts: list[str]
    repeats: list[bool]

    def faults(self) -> list[str]:
        """The first fault of each row, or nothing."""
        found = []
        for text, repeat in zip(self.texts, self.repeats):
            end = text.rstrip(SPACE)[-1:]
            found.append("blank" if not end else "duplicate" if repeat else "truncated" if end not in ".!?" else "")
        return found

    def shape(self) -> tuple[tuple[str, int], ...]:
        """What edits depend on: the initial of each role, and how far the row is at fault."""
        signs = {"": FINE, "truncated": CUT}
        return tuple((role[:1], signs.get(fault, DROP)) for role, fault in zip(self.roles, self.faults()))


def edited(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The rows (role and text) after the edits of an audit, which starts in ``state``."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit == "K":
            state = kept_state(role[:1], state)
        else:
            state = added_state(state)
            role = "user" if state == USER else "assistant"
        yield role, text


def text_of(rows: Iterable[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


LEGAL = {"su", "ua", "au"}


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def segment(rows: Rows, complete: bool) -> dict:
    """What a block knows of its rows of one conversation; the whole repair if there are no others."""
    faults, shape = rows.faults(), rows.shape()
    out = {
        "conv": rows.conv,
        "at": rows.at,
        "complete": complete,
        "n": len(faults),
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": illegal_pairs([role[:1] for role in rows.roles]),
        "first": rows.roles[0][:1],
        "last": rows.roles[-1][:1],
        "parts": [{"at": rows.at, "n": len(faults)}],
    }
    if complete:
        cost, audit = repair(shape)
        done = text_of(edited(zip(rows.roles, rows.texts), audit, START))
        return out | {"ways": [{"entry": START, "exit": START, "cost": cost, "audit": audit}], "repaired_sha256": sha256(done)}
    return out | {"ways": ways_through(shape), "repaired_sha256": None}


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Rows]]:
    """The conversations' rows in one block, for each block; blocks are whole and rows in order."""
    block, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "role", "text", "is_first"))):
            conv, at, role, text, first = row
            if at >> BLOCK_BITS != block:
                if held:
                    yield held
                block, held = at >> BLOCK_BITS, []
            if not held or held[-1].conv != conv:
                held.append(Rows(conv, at, [], [], []))
            held[-1].roles.append(role)
            held[-1].texts.append(text)
            held[-1].repeats.append(not first)
    if held:
        yield held


ARROW = pa.schema(
    [
        ("conv", pa.int64()),
        ("at", pa.int64()),
        ("complete", pa.bool_()),
        *((name, pa.int64()) for name in ("n", "blank", "duplicate", "truncated", "illegal")),
        ("first", pa.string()),
        ("last", pa.string()),
        ("parts", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))),
        ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
        ("repaired_sha256", pa.string()),
    ]
)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for held in blocks_of(batches):
        # The first and the last conversation of a block may have rows in other blocks.
        out += [segment(rows, 0 < i < len(held) - 1) for i, rows in enumerate(held)]
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=ARROW)


def chained(table: pa.Table) -> pa.Table:
    """Neighbouring segments of one conversation as one, the ``group``-th of the next round."""
    rows = sorted(table.to_pylist(), key=lambda row: row["at"])
    one = dict(rows[0])
    for name in ("n", "blank", "duplicate", "truncated", "illegal"):
        one[name] = sum(row[name] for row in rows)
    one["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
    one["last"] = rows[-1]["last"]
    one["parts"] = [part for row in rows for part in row["parts"]]
    one["ways"] = ways_through_blocks([row["ways"] for row in rows])
    one["k"] = one["group"]
    return pa.Table.from_pylist([one], schema=ARROW.append(pa.field("k", pa.int64())))


# Spark


def damaged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as ``conv``, ``turn``, ``role``, ``text`` after damage that a checksum of conversation and turn picks."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)))
    plain = rows.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))),
        (F.crc32(key) % 20).alias("kind"),
    ).filter("kind <> 0")
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    changed = plain.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"), copies)
    return changed.drop("copy")


def plain_rows(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))),
    )


def block() -> Column:
    return F.shiftright("at", BLOCK_BITS).alias("block")


@dataclass(frozen=True)
class Repairs:
    """``report`` has a row per conversation, ``pieces`` the repaired text in order of ``at``."""

    report: DataFrame
    pieces: DataFrame


def repaired(
    conversations: DataFrame,
    damage: bool = False,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> Repairs:
    """Find the faults of each conversation and the cheapest edits that mend it.

    Rows are taken in order of turn, nulls first; rows of one turn in the order of role and text. The
    first fault of a row counts: blank, duplicate of an earlier row's role and text, truncated.
    Edits are keep, rerole to user or assistant, delete (a must for blank and duplicate rows), and insert
    an empty row of user or assistant; of the cheapest repairs the one with the least
    audit is taken. With ``damage`` rows are damaged first, as a test of repairs.

    ``report`` has every conversation of the input: ``gaps`` (turns missing between the least and the largest),
    ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose initials cannot follow one
    another), ``cost``, ``audit`` and ``repaired_sha256``; one without rows left has zeros, an
    empty audit and the digest of nothing. ``pieces`` has ``conv_id``, ``at`` and ``repaired``, lines of ``role:text``;
    conversations of which nothing is left have none, and a long one has several, to be joined by line ends.

    Null roles and texts are one space, null conversations are one of their own, an empty role
    can never stay as it is. Very long texts are kept whole. Repeated rows are duplicates. Other
    columns are ignored; an empty table gives no rows. A conversation may have any number
    of rows: only its digest, which is sequential, and its audit pass through one task, as a stream of
    blocks and as one string.
    """
    names = conv_id, turn, role, text
    rows = damaged(conversations, *names) if damage else plain_rows(conversations, *names)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = written(spread.withColumn("at", F.monotonically_increasing_id()), "ordered")
    # Each (conversation, role, text) has one first place. Places are unique keys, however often a text repeats.
    firsts = ordered.groupBy("conv", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.min("at").alias("at"))
    # A block has at most 256 of them, so they come as one list per block, and rows stay dealt by block.
    firsts = firsts.select(block(), "at").groupBy("block").agg(F.collect_list("at").alias("firsts"))
    marked = ordered.select("conv", "role", "text", "at", block()).repartition("block").join(firsts, "block")
    marked = marked.sortWithinPartitions("at").select("conv", "at", "role", "text", F.array_contains("firsts", F.col("at")).alias("is_first"))
    found = written(marked.mapInArrow(segments, SEGMENT), "segments")
    whole = found.filter("complete").select(
        "conv", "blank", "duplicate", "truncated", "illegal", F.col("ways")[0]["cost"].alias("cost"),
        F.col("ways")[0]["audit"].alias("audit"), "repaired_sha256",
    )
    chains = joined_chains(found.filter("NOT complete"))
    decided = chains.select("conv", "blank", "duplicate", "truncated", "illegal", best_way().alias("way"), "parts")
    decided = written(decided.select("*", "way.cost", "way.audit").drop("way"), "decided")
    pieces = written(long_pieces(ordered, decided), "pieces")
    long = decided.drop("parts").join(digests(pieces), F.col("conv").eqNullSafe(F.col("digest_of")), "left")
    long = long.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).drop("digest_of")
    gaps = ordered.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    results = whole.unionByName(long).join(gaps.withColumnRenamed("conv", "gaps_of"), F.col("conv").eqNullSafe(F.col("gaps_of")), "left")
    every = conversations.select(F.col(conv_id).alias("conv_id")).distinct()
    report = every.join(results, F.col("conv_id").cast("long").eqNullSafe(F.col("conv")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = report.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    short = marked.mapInArrow(whole_pieces, PIECES)
    return Repairs(report, short.unionByName(pieces).withColumnRenamed("conv", "conv_id"))


def joined_chains(open_segments: DataFrame) -> DataFrame:
    """One row per conversation: its segments joined, ``FAN_IN`` neighbours at a time."""
    # The window sees one short row per 256 rows of a conversation, without ways.
    places = open_segments.select("conv", "at", (F.row_number().over(Window.partitionBy("conv").orderBy("at")) - 1).cast("long").alias("k"))
    segments = open_segments.join(places.withColumnRenamed("conv", "k_of"), "at").drop("k_of")
    while True:
        groups = segments.withColumn("group", F.floor(F.col("k") / FAN_IN)).groupBy("conv", "group")
        segments = written(groups.applyInArrow(chained, SEGMENT + ", k long"), "chains")
        if not segments.filter("k > 0").limit(1).count():
            return segments


def best_way() -> Column:
    """The cheapest way from the start to an accepted end, the least audit first."""
    ends = F.filter("ways", lambda w: (w["entry"] == START) & w["exit"].isin(START, ASSISTANT))
    return F.array_min(F.transform(ends, lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))


SHARES = pa.schema([("share_of", pa.int64()), ("block", pa.int64()), ("share", pa.string()), ("state", pa.int32())])
PIECES = "conv long, at long, repaired string"


def shares_of(audit: str, parts: list[dict]) -> Iterator[tuple[str, int]]:
    """The letters of an audit that belong to each block of rows, and the state before them.

    Inserts go with the row behind them. What stays reads ``s?(ua)*``, so the number of
    rows that stay tells whether there is a system row, and the number so far tells the state.
    """
    odd = (len(audit) - audit.count("D")) % 2
    end, stayed = 0, 0
    for i, part in enumerate(parts):
        start, left = end, part["n"]
        while left:
            left -= audit[end] != "I"
            end += 1
        if i == len(parts) - 1:
            end = len(audit)
        if not stayed:
            state = START
        elif stayed == odd:
            state = SYSTEM
        else:
            state = USER if (stayed - odd) % 2 else ASSISTANT
        yield audit[start:end], state
        stayed += end - start - audit.count("D", start, end)


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            out = [
                {"share_of": row["conv"], "block": part["at"] >> BLOCK_BITS, "share": share, "state": state}
                for part, (share, state) in zip(row["parts"], shares_of(row["audit"], row["parts"]))
            ]
            yield pa.RecordBatch.from_pylist(out, schema=SHARES)


def as_pieces(found: list[tuple]) -> pa.RecordBatch:
    conv, at, done = zip(*found) if found else ((), (), ())
    return pa.record_batch([pa.array(conv, pa.int64()), pa.array(at, pa.int64()), pa.array(done, pa.string())], names=["conv", "at", "repaired"])


def edited_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired text of the rows of one conversation and block, which stand together."""
    key, rows, share, state = None, [], "", START

    def done() -> pa.RecordBatch:
        text = text_of(edited(rows, share, state))
        return as_pieces([(key[0], key[2], text)] if text else [])

    for batch in batches:
        for conv, at, role, text, own, own_state in zip(
            *(batch.column(c).to_pylist() for c in ("conv", "at", "role", "text", "share", "state"))
        ):
            if key is None or key[:2] != (conv, at >> BLOCK_BITS):
                if key is not None:
                    yield done()
                key, rows, share, state = (conv, at >> BLOCK_BITS, at), [], own, own_state
            rows.append((role, text))
    if key is not None:
        yield done()


def long_pieces(ordered: DataFrame, decided: DataFrame) -> DataFrame:
    """Repaired text of each block of the decided conversations: ``conv``, ``at``, ``repaired``."""
    planned = decided.select("conv", "audit", "parts").mapInArrow(shares, "share_of long, block long, share string, state int")
    rows = ordered.select("conv", "at", "role", "text", block())
    planned = planned.withColumnRenamed("block", "block_of")
    both = rows.join(planned, (F.col("block") == F.col("block_of")) & F.col("conv").eqNullSafe(F.col("share_of")))
    ready = both.repartition("block").sortWithinPartitions("at").select("conv", "at", "role", "text", "share", "state")
    return ready.mapInArrow(edited_blocks, PIECES)


def whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired text of the conversations that lie in one block."""
    for held in blocks_of(batches):
        found = []
        for rows in held[1:-1]:
            text = text_of(edited(zip(rows.roles, rows.texts), repair(rows.shape())[1], START))
            if text:
                found.append((rows.conv, rows.at, text))
        yield as_pieces(found)


def digests(pieces: DataFrame) -> DataFrame:
    """The digest of each conversation's pieces, joined by line ends, as a stream."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, None
        for batch in batches:
            found = []
            for own, done in zip(batch.column("conv").to_pylist(), batch.column("repaired").to_pylist()):
                if state is None or own != conv:
                    if state is not None:
                        found.append((conv, state.hexdigest()))
                    state, conv = hashlib.sha256(), own
                else:
                    state.update(b"\n")
                state.update(done.encode("utf-8", "surrogatepass"))
            yield ready(found)
        yield ready([(conv, state.hexdigest())] if state is not None else [])

    def ready(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())],
            names=["digest_of", "repaired_sha256"],
        )

    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "at")
    return ordered.mapInArrow(digest, "digest_of long, repaired_sha256 string")
