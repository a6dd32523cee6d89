"""Model aliases, expected scores and the model listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.sources.registry import DEFAULT_EXPECTED, Registry, known_backend

_RESOLVE = """
WITH RECURSIVE step AS (
  SELECT backend, alias, target AS name, array(alias) AS seen FROM {aliases}
  UNION ALL
  SELECT step.backend, step.alias, next.target, array_append(step.seen, step.name)
  FROM step JOIN {aliases} AS next ON next.backend = step.backend AND next.alias = step.name
  WHERE NOT array_contains(step.seen, step.name)
)
SELECT backend, alias, max_by(name, size(seen)) AS full_name FROM step GROUP BY backend, alias
"""


def resolved_aliases(registry: Registry) -> DataFrame:
    """Every alias followed to its last name; a cycle ends at the name met twice.

    The recursion runs over the registry alone, never over runs.
    """
    aliases = registry.aliases
    return aliases.sparkSession.sql(_RESOLVE, aliases=aliases)


def resolve_models(
    runs: DataFrame, registry: Registry, model: str = "model", backend: str = "backend"
) -> DataFrame:
    """Add ``full_name``: the name behind an alias, the model itself if it is no alias.

    A missing or empty model gives null.
    """
    names = resolved_aliases(registry).withColumnsRenamed({"backend": "_backend", "alias": "_alias"})
    keyed = runs.withColumn("_key", known_backend(F.col(backend)))
    on = (F.col("_key") == F.col("_backend")) & (F.col(model) == F.col("_alias"))
    joined = keyed.join(registry.side(names), on, "left")
    name = F.when(F.col(model) != "", F.coalesce("full_name", F.col(model)))
    return joined.select(*runs.columns, name.alias("full_name"))


def expected_performance(
    runs: DataFrame, registry: Registry, model: str = "model", backend: str = "backend"
) -> DataFrame:
    """Add the expected score of a model: ``expected_min``, ``_max`` and ``_typical``.

    A model's own entry counts first, then the first registry entry whose target is
    the model's full name and that has an expectation, then the default.
    """
    columns = ("min", "max", "typical")
    bundle = F.struct(*columns)
    own = registry.expected.select(
        F.col("backend").alias("_b1"), F.col("alias").alias("_a1"), bundle.alias("_own")
    )
    shared = (
        registry.aliases.join(registry.side(registry.expected), ["backend", "alias"])
        .groupBy(F.col("backend").alias("_b2"), F.col("target").alias("_a2"))
        .agg(F.min_by(bundle, "ord").alias("_shared"))
    )
    named = resolve_models(runs, registry, model, backend).withColumn("_key", known_backend(F.col(backend)))
    joined = named.join(
        registry.side(own), (F.col("_key") == F.col("_b1")) & (F.col(model) == F.col("_a1")), "left"
    ).join(
        registry.side(shared),
        (F.col("_key") == F.col("_b2")) & (F.col("full_name") == F.col("_a2")),
        "left",
    )
    default = F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, DEFAULT_EXPECTED)])
    expected = F.coalesce("_own", "_shared", default)
    return joined.withColumn("_expected", expected).select(
        *runs.columns, "full_name", *[F.col(f"_expected.{c}").alias(f"expected_{c}") for c in columns]
    )


def model_listing(registry: Registry, backend: str | None = None) -> DataFrame:
    """Listed models by category, each with its description or else its full name."""
    listed = registry.categories
    if backend is not None:
        wanted = known_backend(F.lit(backend))
        listed = listed.where(F.col("backend") == wanted)
    names = resolved_aliases(registry).withColumnRenamed("alias", "model")
    described = registry.descriptions.withColumnRenamed("alias", "model")
    joined = listed.join(registry.side(names), ["backend", "model"], "left").join(
        registry.side(described), ["backend", "model"], "left"
    )
    full = F.coalesce("full_name", "model")
    note: Column = F.when(
        F.coalesce("description", F.lit("")) != "", F.concat(F.lit("- "), "description")
    ).otherwise(F.concat(F.lit("-> "), full))
    return joined.select(
        "backend", "cat_ord", "ord", "category", "model", full.alias("full_name"), note.alias("note")
    )


def model_usage(runs: DataFrame, registry: Registry) -> DataFrame:
    """The model listing with the number of runs that used each entry's full name."""
    used = (
        resolve_models(runs, registry)
        .groupBy(known_backend(F.col("backend")).alias("backend"), "full_name")
        .agg(F.count(F.lit(1)).alias("runs"))
    )
    listing = registry.side(model_listing(registry))
    on = ["backend", "full_name"]
    # Sum over the usage side, so that only names of the listing are joined.
    hits = used.join(listing.select(*on).distinct(), on, "left_semi")
    return model_listing(registry).join(hits, on, "left").na.fill(0, ["runs"])
