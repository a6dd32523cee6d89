"""Every registered query gives what its SQL gives, and its plan holds up at scale."""

import re

import pytest

import __spark_entry__ as registered
from tests.compare import connect, differences
from workload.catalog import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, connection, name):
    assert differences(QUERIES[name](spark, SF), connection, CHECKS[name]) == []


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)


def test_entry_gives_rows(spark):
    assert registered.entry(spark).count() > 0


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_and_no_python_in_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


def has_keys(window: str) -> bool:
    """Whether a printed window, ``Window [expressions], [keys], [order]``, has keys.

    Empty parts are not printed; only the order says ASC or DESC.
    """
    parts, depth, start = [], 0, 0
    for i, char in enumerate(window):
        if char == "[":
            start = i if depth == 0 else start
            depth += 1
        elif char == "]":
            depth -= 1
            if depth == 0:
                parts.append(window[start + 1 : i])
    return any(not re.search(r" (ASC|DESC) NULLS ", part) for part in parts[1:])


def test_window_keys_are_told_from_the_order():
    order = "[a#1 ASC NULLS FIRST, b#2 DESC NULLS LAST]"
    assert has_keys(f"Window [sum(x[0]) AS s#3], [k#4], {order}")
    assert has_keys("Window [count(1) AS s#3], [k#4]")
    assert not has_keys(f"Window [sum(x) windowspecdefinition(a#1 ASC NULLS FIRST) AS s#3], {order}")
    assert not has_keys("Window [count(1) AS s#3]")


# Windows without a partition key run in one task. They may only see rows that are few by
# nature: days, seconds of one day, chunks of one second, or what a limit has left.
FEW_ROWS = {"numbered_files", "files_by_number", "score_trend", "recent_evaluations"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_windows_have_a_partition_key(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    windows = re.findall(r"(?:^|[ +*)-])(Window \[.*)$", plan, re.M)
    unkeyed = [window for window in windows if not has_keys(window)]
    assert bool(unkeyed) == (name in FEW_ROWS)


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(QUERIES["score_bands"](spark, SF))
    assert "struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan


def test_large_groups_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["recent_evaluations_by_model"](spark, SF))
    assert re.search(r"Exchange hashpartitioning\(model.*\n.*WindowGroupLimit.*Partial", plan)
