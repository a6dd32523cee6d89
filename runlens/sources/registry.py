"""Model registry: four small dimension tables per backend."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Aliases with their one-step targets, descriptions, listing order and expected
# scores (min, max, typical) per backend. Order matters: it decides ties.
ALIASES = {
    "claude": [
        ("claude-opus-4.1", "claude-opus-4-1-20250805"),
        ("claude-opus-4.0", "claude-opus-4-20250514"),
        ("claude-sonnet-4.5", "claude-sonnet-4-5-20250929"),
        ("claude-sonnet-4.0", "claude-sonnet-4-20250514"),
        ("claude-3.7-sonnet", "claude-3-7-sonnet-20250219"),
        ("claude-haiku-4.5", "claude-haiku-4-5-20251001"),
        ("claude-3.5-haiku", "claude-3-5-haiku-20241022"),
        ("opus-4.1", "claude-opus-4.1"),
        ("opus-4.0", "claude-opus-4.0"),
        ("sonnet-4.5", "claude-sonnet-4.5"),
        ("sonnet-4", "claude-sonnet-4.0"),
        ("sonnet-3.7", "claude-3.7-sonnet"),
        ("best", "claude-sonnet-4.5"),
        ("balanced", "claude-sonnet-4.0"),
        ("fast", "claude-haiku-4.5"),
        ("latest", "claude-sonnet-4.5"),
    ],
    "codex": [
        ("gpt-5", "gpt-5-2025-08-07"),
        ("gpt-5-mini", "gpt-5-mini-2025-08-07"),
        ("gpt-5-pro", "gpt-5-pro"),
        ("codex-gpt-5", "gpt-5-codex"),
        ("codex-mini", "codex-mini-latest"),
        ("gpt-4.1", "gpt-4.1-2025-04-14"),
        ("o3", "o3-2025-04-16"),
        ("o3-mini", "o3-mini"),
        ("codex-latest", "gpt-5-codex"),
        ("codex", "codex-latest"),
        ("best", "gpt-5-pro"),
        ("fast", "gpt-5-mini"),
    ],
    "gemini": [
        ("gemini-3-pro-preview", "gemini-3-pro-preview"),
        ("gemini-2.5-pro", "gemini-2.5-pro"),
        ("gemini-2.5-flash", "gemini-2.5-flash"),
        ("gemini-2.5-flash-lite", "gemini-2.5-flash-lite"),
        ("gemini-2.0-flash", "gemini-2.0-flash"),
        ("gemini-2.0-flash-lite", "gemini-2.0-flash-lite"),
        ("gemini-3", "gemini-3-pro-preview"),
        ("gemini-2.5", "gemini-2.5-pro"),
        ("flash", "gemini-2.5-flash"),
        ("lite", "gemini-2.5-flash-lite"),
        ("best", "gemini-3-pro-preview"),
    ],
}
DESCRIPTIONS = {
    "claude": [
        ("claude-opus-4.1", "Opus 4.1 - Latest and most capable"),
        ("claude-opus-4.0", "Opus 4.0 - Very strong performance"),
        ("claude-sonnet-4.5", "Sonnet 4.5 - State of the art balanced model"),
        ("claude-sonnet-4.0", "Sonnet 4.0 - Strong balanced model"),
        ("claude-haiku-4.5", "Haiku 4.5 - Fast and smart"),
        ("claude-3.7-sonnet", "Sonnet 3.7 - Reliable previous gen"),
    ],
    "codex": [
        ("gpt-5", "GPT-5 - Major flagship release"),
        ("gpt-5-pro", "GPT-5 Pro - High compute model"),
        ("codex-gpt-5", "GPT-5 Codex - Specialized for code"),
        ("o3", "O3 - Reasoning model"),
        ("gpt-4.1", "GPT-4.1 - Refined GPT-4 architecture"),
    ],
    "gemini": [
        ("gemini-3-pro-preview", "Gemini 3 Pro Preview - State of the art"),
        ("gemini-2.5-pro", "Gemini 2.5 Pro - Strong performance"),
        ("gemini-2.5-flash", "Gemini 2.5 Flash - Fast and efficient"),
        ("gemini-2.5-flash-lite", "Gemini 2.5 Flash Lite - Lightweight"),
        ("gemini-2.0-flash", "Gemini 2.0 Flash - Previous generation fast model"),
    ],
}
CATEGORIES = {
    "claude": [
        ("Opus Models (Most Capable)", ["claude-opus-4.1", "claude-opus-4.0"]),
        ("Sonnet Models (Balanced)", ["claude-sonnet-4.5", "claude-sonnet-4.0", "claude-3.7-sonnet"]),
        ("Haiku Models (Fast)", ["claude-haiku-4.5", "claude-3.5-haiku"]),
        ("Quick Aliases", ["best", "balanced", "fast"]),
    ],
    "codex": [
        ("GPT-5 Series", ["gpt-5", "gpt-5-pro", "gpt-5-mini"]),
        ("Codex Models", ["codex-gpt-5", "codex-mini"]),
        ("O-Series (Reasoning)", ["o3", "o3-mini"]),
        ("Legacy", ["gpt-4.1"]),
        ("Quick Aliases", ["best", "codex-latest"]),
    ],
    "gemini": [
        ("Gemini 3 Series", ["gemini-3-pro-preview"]),
        ("Gemini 2.5 Series", ["gemini-2.5-pro", "gemini-2.5-flash", "gemini-2.5-flash-lite"]),
        ("Gemini 2.0 Series", ["gemini-2.0-flash", "gemini-2.0-flash-lite"]),
        ("Quick Aliases", ["best", "flash", "lite"]),
    ],
}
EXPECTED = {
    "claude": [
        ("claude-opus-4.1", 35, 45, 40),
        ("claude-sonnet-4.5", 35, 45, 40),
        ("claude-sonnet-4.0", 25, 35, 30),
    ],
    "codex": [
        ("gpt-5-pro", 35, 45, 40),
        ("gpt-5", 30, 40, 35),
        ("codex-gpt-5", 32, 42, 38),
    ],
    "gemini": [
        ("gemini-3-pro-preview", 30, 40, 35),
        ("gemini-2.5-pro", 25, 35, 30),
        ("gemini-2.5-flash", 20, 30, 25),
    ],
}
DEFAULT_EXPECTED = (10, 30, 20)
BACKENDS = ("claude", "codex", "gemini", "cline")  # cline has no registered models
DEFAULT_BACKEND = "claude"
# ----------------------------------------------------------------------------

# Below this many rows a registry table is sent to every executor.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Registry:
    """The registry's tables; ``small`` says that their size is known to be bounded."""

    aliases: DataFrame  # backend, alias, target, ord
    descriptions: DataFrame  # backend, alias, description
    categories: DataFrame  # backend, category, model, cat_ord, ord
    expected: DataFrame  # backend, alias, min, max, typical
    small: bool = False

    def side(self, table: DataFrame) -> DataFrame:
        """A join side: broadcast if bounded, else left to Spark's own size check."""
        return F.broadcast(table) if self.small else table


def known_backend(backend: Column) -> Column:
    """Backend names in lower case; one that is not known counts as the default."""
    lowered = F.lower(backend)
    return F.when(lowered.isin(*BACKENDS), lowered).otherwise(DEFAULT_BACKEND)


def registry(
    spark: SparkSession,
    aliases: dict = ALIASES,
    descriptions: dict = DESCRIPTIONS,
    categories: dict = CATEGORIES,
    expected: dict = EXPECTED,
) -> Registry:
    alias_rows = [
        (backend, alias, target, ord_)
        for backend, pairs in aliases.items()
        for ord_, (alias, target) in enumerate(pairs)
    ]
    listing = [
        (backend, category, model, cat_ord, ord_)
        for backend, groups in categories.items()
        for cat_ord, (category, models) in enumerate(groups)
        for ord_, model in enumerate(models)
    ]
    flat = lambda table: [(backend, *row) for backend, rows in table.items() for row in rows]
    tables = {
        "backend string, alias string, target string, ord int": alias_rows,
        "backend string, alias string, description string": flat(descriptions),
        "backend string, category string, model string, cat_ord int, ord int": listing,
        "backend string, alias string, min int, max int, typical int": flat(expected),
    }
    frames = [spark.createDataFrame(rows, schema) for schema, rows in tables.items()]
    return Registry(*frames, small=max(map(len, tables.values())) <= BROADCAST_ROWS)
