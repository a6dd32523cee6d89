"""Repairs of conversations against all edits, tried one after another."""

import hashlib
import random
import re
import zlib

import pytest

from runlens.llm import conversation_repair as cr

BLANK = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Plain dynamic programming over rows and states, keeping the least (cost, audit, repaired rows)."""
    best = {"": (0, "", [])}

    def better(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def filled(found):
        for _ in range(3):
            for state, (cost, audit, done) in list(found.items()):
                role = "assistant" if state == "u" else "user"
                better(found, role[0], (cost + 3, audit + "I", [*done, (role, "")]))
        return found

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, done) in filled(best).items():
            better(new, state, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            other = "assistant" if state == "u" else "user"
            better(new, other[0], (cost + 3 + more, audit + "R", [*done, (other, text)]))
            if role and state + role[:1] in ("s", "u", "su", "ua", "au"):
                better(new, role[:1], (cost + more, audit + "K", [*done, (role, text)]))
        best = new
    return min((v for s, v in filled(best).items() if s in ("", "a")), key=lambda v: v[:2])


def brute(rows, damaged):
    found = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in (damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]) if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, judged = set(), []
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, *_ in own if t is not None]
        cost, audit, done = cheapest(judged)
        faults = [f for *_, f in judged]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest(),
        )
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(frame):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def some_rows(seed=4, convs=60, long=1_300):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", None, "", "User", "user"]
    texts = ["Yes.", "No!", "cut off", " \t\r\n", "", None, "What?", "é ü.", "a" * 5_000 + "."]
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    for turn in range(long):  # a third of all rows and more
        role = "user" if turn % 2 == 0 else "assistant"
        rows.append((1_000, turn, role, rng.choice([f"Turn {turn}.", f"Turn {turn}.", f"Turn {turn}", "Same."])))
    for conv in range(2_000, 2_040):  # clean ones
        rows += [(conv, 0, "system", "Be kind."), (conv, 1, "user", f"Hello {conv}!"), (conv, 2, "assistant", "Good day.")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("damaged", [False, True])
def test_repairs_are_the_cheapest(spark, damaged):
    rows = some_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "text AS at", "role AS block").repartition(7)
    repairs = cr.repaired(frame, damage=damaged)
    wanted = brute(rows, damaged)
    assert reported(repairs.report) == wanted
    texts = {}
    for r in repairs.pieces.orderBy("at").collect():
        texts.setdefault(r.conv_id, []).append(r.repaired)
    for conv, found in wanted.items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == found[-1]


def test_long_conversations_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "FAN_IN", 2)
    rows = some_rows(seed=9, convs=300, long=2_100)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    # As with large tables: joins shuffle and partitions are not joined together.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = cr.repaired(frame, damage=True).report.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    wanted = brute(rows, True)
    assert len(found) == len(wanted)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == wanted


def test_nothing_left_and_empty_table(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    found = reported(cr.repaired(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema), damage=True).report)
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert cr.repaired(spark.createDataFrame([], schema), damage=True).report.count() == 0


def test_joined_ways_equal_the_way_through_all_rows():
    rng = random.Random(2)
    for _ in range(200):
        rows = tuple((rng.choice("suax"), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 24)))
        cuts = sorted(rng.randint(0, len(rows)) for _ in range(3))
        blocks = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        ways = cr.ways_through_blocks([cr.ways_through(b) for b in blocks])
        least = min((w["cost"], w["audit"]) for w in ways if w["entry"] == cr.START and w["exit"] in (cr.START, cr.ASSISTANT))
        assert least == cr.repair(rows) == cheapest([(r, "", ("", "truncated", "blank")[f]) for r, f in rows])[:2]
