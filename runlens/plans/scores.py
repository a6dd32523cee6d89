"""The score view: table, statistics, history and export of a score log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from runlens.operators import selection, statistics, trends
from runlens.sinks.writers import export_csv


@dataclass(frozen=True)
class ScoreReport:
    """Parts of the score view; each is a lazy DataFrame, or None if not asked for."""

    table: DataFrame
    summary: DataFrame
    statistics: DataFrame | None = None
    recent: DataFrame | None = None
    trend: DataFrame | None = None
    pending: DataFrame | None = None
    exported: bool = False


def score_report(
    runs: DataFrame,
    last: int | None = None,
    which: str = "all",
    stats: bool = False,
    trends_too: bool = False,
    pending: bool = False,
    export: str | None = None,
    by: Sequence[str] = (),
) -> ScoreReport:
    """The parts of the score view.

    ``last`` cuts the log before everything else; ``which`` (all, evaluated,
    pending) narrows the table only. ``by`` groups statistics and history.
    """
    chosen = selection.last_runs(runs, last)
    return ScoreReport(
        table=selection.score_table(selection.runs_with_status(chosen, which)).orderBy("seq"),
        summary=statistics.run_counts(chosen),
        statistics=statistics.score_statistics(chosen, by) if stats else None,
        recent=trends.recent_evaluations(chosen, by) if trends_too else None,
        trend=trends.score_trend(chosen, by) if trends_too else None,
        pending=selection.pending_runs(chosen).orderBy("seq") if pending else None,
        exported=export_csv(chosen.orderBy("seq"), export) if export else False,
    )


def check(runs: DataFrame) -> ScoreReport:
    """Statistics and pending runs of the whole log."""
    return score_report(runs, stats=True, pending=True)
