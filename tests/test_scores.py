"""Statistics, history and listing of runs: the small rules that are easy to get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import selection, statistics, trends
from runlens.plans.scores import check, score_report
from tests.conftest import done


def only(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_pending_is_everything_not_completed(runs_of):
    rows = [{"evaluation_status": s} for s in (None, "skipped", "failed", "pending", "completed")]
    runs = runs_of(*rows)
    assert [r.seq for r in selection.runs_with_status(runs, "pending").collect()] == [0, 1, 2, 3]
    assert [r.seq for r in selection.runs_with_status(runs, "evaluated").collect()] == [4]
    counts = only(statistics.run_counts(runs))
    assert (counts.total_runs, counts.evaluated, counts.pending) == (5, 1, 4)


def test_no_patches_generated_leaves_success_rate_open(runs_of):
    stats = only(statistics.score_statistics(runs_of(done(0.0, generation_score=0.0))))
    assert stats.success_rate is None
    assert stats.average_drop == 0.0


def test_generation_counts_all_completed_runs_and_evaluation_only_scored_ones(runs_of):
    runs = runs_of(
        done(40.0, generation_score=80.0),
        done(None, generation_score=None),
        done(20.0, generation_score=100.0),
        {"evaluation_status": "pending", "generation_score": 100.0, "evaluation_score": 90.0},
    )
    stats = only(statistics.score_statistics(runs))
    assert (stats.generation_avg, stats.generation_min, stats.generation_max) == (60.0, 0.0, 100.0)
    assert (stats.evaluation_avg, stats.evaluation_min, stats.evaluation_max) == (30.0, 20.0, 40.0)
    assert (stats.average_drop, stats.success_rate) == (30.0, 50.0)


def test_drop_and_rate_need_a_score(runs_of):
    stats = only(statistics.score_statistics(runs_of(done(None, generation_score=50.0))))
    assert stats.generation_avg == 50.0
    assert (stats.evaluation_avg, stats.average_drop, stats.success_rate) == (None, None, None)


def test_times_of_zero_do_not_count(runs_of):
    runs = runs_of(
        done(1.0, generation_time=0.0, evaluation_time=0.0),
        done(1.0, generation_time=10.0, evaluation_time=4.0),
        {"evaluation_status": "skipped", "generation_time": 20.0, "evaluation_time": 100.0},
        {"evaluation_status": "skipped"},
    )
    stats = only(statistics.score_statistics(runs))
    assert (stats.generation_time_avg, stats.generation_time_total) == (15.0, 30.0)
    assert (stats.evaluation_time_avg, stats.evaluation_time_total) == (4.0, 4.0)


def test_trend_gives_the_extra_run_to_the_later_half(runs_of):
    scores = [10.0, 20.0, 30.0, 40.0, 50.0]
    runs = runs_of(*[done(s, timestamp=f"2025-01-0{i + 1} 00:00:00") for i, s in enumerate(scores)])
    trend = only(trends.score_trend(runs))
    assert (trend.runs, trend.first_avg, trend.second_avg) == (5, 15.0, 40.0)
    assert (trend.trend, trend.direction) == (25.0, "improving")


def test_trend_keeps_log_order_on_equal_times(runs_of):
    same = "2025-01-01 00:00:00"
    trend = only(trends.score_trend(runs_of(*[done(s, timestamp=same) for s in (9.0, 7.0, 1.0, 3.0)])))
    assert (trend.first_avg, trend.second_avg, trend.direction) == (8.0, 2.0, "declining")


def test_missing_time_sorts_first(runs_of):
    runs = runs_of(
        done(1.0, timestamp="2025-01-02 00:00:00"), done(2.0, timestamp="2025-01-03 00:00:00"), done(9.0)
    )
    assert only(trends.score_trend(runs)).first_avg == 9.0
    recent = {r.position: r for r in trends.recent_evaluations(runs).collect()}
    assert (recent[1].date, recent[1].score) == ("Unknown", 9.0)


def test_missing_score_counts_as_zero_in_history(runs_of):
    times = [f"2025-01-0{i} 00:00:00" for i in range(1, 4)]
    runs = runs_of(*[done(s, timestamp=t) for s, t in zip((None, 4.0, None), times)])
    trend = only(trends.score_trend(runs))
    assert (trend.first_avg, trend.second_avg) == (0.0, 2.0)
    assert sorted(r.score for r in trends.recent_evaluations(runs).collect()) == [0.0, 0.0, 4.0]


@pytest.mark.parametrize("count, rows, direction", [(1, 0, None), (2, 1, None), (3, 1, "stable")])
def test_short_histories(runs_of, count, rows, direction):
    runs = runs_of(*[done(5.0, timestamp="2025-01-01 00:00:00")] * count)
    found = trends.score_trend(runs).collect()
    assert len(found) == rows
    assert not rows or found[0].direction == direction
    assert trends.recent_evaluations(runs).count() == (0 if count < 2 else count)


def test_recent_evaluations_are_the_last_ten_in_time_order(runs_of):
    runs = runs_of(*[done(float(i), timestamp=f"2025-01-{30 - i:02d} 00:00:00") for i in range(15)])
    rows = sorted(trends.recent_evaluations(runs).collect(), key=lambda r: r.position)
    assert [r.score for r in rows] == [float(i) for i in range(9, -1, -1)]
    assert [r.position for r in rows] == list(range(1, 11))


def brute_trend(rows):
    ordered = sorted(rows, key=lambda r: (r["timestamp"] or "", r["seq"]))
    scores = [r["evaluation_score"] or 0.0 for r in ordered]
    half = len(scores) // 2
    return sum(scores[:half]) / half, sum(scores[half:]) / (len(scores) - half)


@pytest.mark.parametrize("seed", range(4))
def test_trend_against_brute_force(runs_of, seed):
    """Few days, few seconds, many ties and a group that holds most rows."""
    rng = random.Random(seed)
    rows = [
        done(
            rng.choice([None, float(rng.randrange(100))]),
            timestamp=rng.choice([None, f"2025-01-0{rng.randrange(1, 4)} 00:00:0{rng.randrange(3)}"]),
            model=rng.choice(["a", "a", "a", None, "b"]),
        )
        for _ in range(rng.randrange(30, 60))
    ]
    runs = runs_of(*rows)
    rows = [dict(row, seq=i) for i, row in enumerate(rows)]
    found = {r.model: r for r in trends.score_trend(runs, ["model"]).collect()}
    for model in {row["model"] for row in rows}:
        group = [row for row in rows if row["model"] == model]
        if len(group) >= 3:
            assert (found[model].first_avg, found[model].second_avg) == pytest.approx(brute_trend(group))
    overall = only(trends.score_trend(runs))
    assert (overall.first_avg, overall.second_avg) == pytest.approx(brute_trend(rows))


def test_trend_splits_inside_one_second_across_chunks(runs_of):
    """All times missing and positions far apart: only the last two steps can find the split."""
    runs = runs_of(*[done(float(i)) for i in range(40)]).withColumn("seq", F.col("seq") * 700_000)
    trend = only(trends.score_trend(runs))
    assert (trend.first_avg, trend.second_avg) == (9.5, 29.5)


def test_last_runs_go_by_log_position_and_zero_means_all(runs_of):
    runs = runs_of(*[{"timestamp": f"2025-01-{9 - i:02d}"} for i in range(5)])
    assert sorted(r.seq for r in selection.last_runs(runs, 2).collect()) == [3, 4]
    assert selection.last_runs(runs, 0).count() == selection.last_runs(runs, None).count() == 5


def test_filter_touches_the_table_only_and_last_comes_first(runs_of):
    runs = runs_of(done(1.0), done(2.0), {"evaluation_status": "pending"}, done(3.0))
    report = score_report(runs, last=3, which="pending", stats=True, trends_too=True, pending=True)
    assert [r.seq for r in report.table.collect()] == [2]
    assert only(report.summary).total_runs == 3
    assert only(report.statistics).evaluation_avg == 2.5
    assert only(report.trend).runs == 2
    assert [r.seq for r in report.pending.collect()] == [2]


def test_check_shows_statistics_and_pending(runs_of):
    report = check(runs_of(done(1.0), {"evaluation_status": "failed"}))
    assert only(report.statistics).total_runs == 2
    assert report.pending.count() == 1 and report.trend is None


def test_score_table(runs_of):
    runs = runs_of(
        {"timestamp": "2025-01-01 10:11:12.999", "notes": "n" * 40, "num_instances": 3,
         "generation_score": 50.0, "evaluation_score": 12.5, "evaluation_status": "completed"},
        {"evaluation_status": "interrupted by hand"},
        {"evaluation_status": "skipped"},
        {},
    )
    rows = selection.score_table(runs).orderBy("seq").collect()
    assert rows[0].timestamp == "2025-01-01 10:11:12" and rows[0].notes == "n" * 30
    assert (rows[0].evaluation_text, rows[0].status) == ("12.5%", "Evaluated")
    assert (rows[1].timestamp, rows[1].instances, rows[1].evaluation_text) == ("Unknown", 0, "-")
    assert [r.status for r in rows[1:]] == ["? interrupte", "Skipped", "? unknown"]


def test_pending_listing(runs_of):
    runs = runs_of(
        {"prediction_file": "a/b/predictions_1.jsonl", "timestamp": "2025-01-01 10:11:12.5", "num_instances": 4},
        {},
        done(1.0),
    )
    rows = selection.pending_runs(runs).orderBy("seq").collect()
    assert [(r.file_name, r.timestamp, r.instances) for r in rows] == [
        ("predictions_1.jsonl", "2025-01-01 10:11:12", 4),
        ("Unknown", "Unknown", 0),
    ]


def test_recent_runs_are_labelled(runs_of):
    runs = runs_of({}, *[{"evaluation_status": "skipped"}] * 2, done(5.0), done(None), {"evaluation_status": "failed"})
    rows = sorted(trends.recent_runs(runs).collect(), key=lambda r: r.seq)
    assert [r.label for r in rows] == ["skipped", "skipped", "real", "completed", "failed"]
    assert rows[2].evaluation_score == 5.0


def test_run_sizes():
    assert selection.run_size(7, "quick") == 7
    assert [selection.run_size(preset=p) for p in ("quick", "standard", "full", None)] == [10, 50, 300, 300]
    assert selection.run_size(0, "quick") == 10


def test_equal_scores_are_stable_however_they_add_up(runs_of):
    for count in (3, 7, 10):
        runs = runs_of(*[done(100 / 3, timestamp=f"2025-01-{i % 4 + 1:02d} 00:00:00") for i in range(count)])
        assert only(trends.score_trend(runs)).direction == "stable"


def test_the_smallest_change_has_a_direction(runs_of):
    for last, direction in ((10.0000000008, "improving"), (9.9999999992, "declining"), (10.0, "stable")):
        runs = runs_of(*[done(score, timestamp=f"2025-01-0{i + 1}") for i, score in enumerate([10.0, 10.0, 10.0, last])])
        assert only(trends.score_trend(runs)).direction == direction


def test_odd_numbers_of_runs_and_odd_scores(runs_of):
    third = 100 / 3
    runs = runs_of(*[done(score, timestamp=f"2025-01-0{i + 1}") for i, score in enumerate([third, third, third, third, third])])
    assert only(trends.score_trend(runs)).direction == "stable"
    runs = runs_of(*[done(score, timestamp=f"2025-01-0{i + 1}") for i, score in enumerate([5.0, float("nan"), 1e300])])
    assert only(trends.score_trend(runs)).direction == "declining"
