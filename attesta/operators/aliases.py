"""Alias map, identity resolution and safe-alias seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import vocab as V
from attesta.functions import text as tx
from attesta.session import materialize


def entity_side(strains: DataFrame) -> DataFrame:
    """The entity table as a lookup: joined by sorting, never broadcast.

    The planner estimates a table by its files, which says little about rows
    that were exploded or compressed well; a broadcast of all entities would
    pass through the driver.
    """
    return strains.hint("merge")


SMALL = 100_000   # rows that may pass through the driver as a broadcast


def sized(stored: DataFrame) -> DataFrame:
    """A stored step as one side of a join: joined by sorting once it has more than ``SMALL`` rows.

    Its files are compressed to a small part of its rows, so their size alone
    would let the planner broadcast millions of rows.
    """
    return stored if stored.count() <= SMALL else entity_side(stored)


def of_keys(keys: DataFrame, table: DataFrame, column: str, label: str = "lookup") -> DataFrame:
    """The rows of ``table`` whose ``column`` occurs in ``keys``, as a step of measured size.

    For a long side with few keys: it then moves only if the lookup is large.
    """
    asked = keys.select(column).distinct()
    return sized(materialize(entity_side(table).join(asked, column, "left_semi"), label))


def alias_pairs(strains: DataFrame) -> DataFrame:
    """``(alias, slug)`` for every real alias.

    A canonical slug never acts as an alias, and of two owners of one alias
    the smallest slug wins.  Identity rows are left out on purpose: consumers
    fall back with ``coalesce``, so the lookup side holds only true aliases.
    """
    owned = strains.select(
        F.explode(tx.alias_slugs("aliases")).alias("alias"), F.col("slug"))
    return (owned.filter(F.col("alias") != F.col("slug"))
            .join(entity_side(strains.select(F.col("slug").alias("alias"))), "alias", "left_anti")
            .groupBy("alias").agg(F.min("slug").alias("slug")))


def alias_map(strains: DataFrame) -> DataFrame:
    """``alias_pairs`` plus one identity row per entity: all known spellings."""
    return alias_pairs(strains).unionByName(
        strains.select(F.col("slug").alias("alias"), F.col("slug")))


def resolve(df: DataFrame, pairs: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """Replace a slug column by the owning slug (or add it as ``into``)."""
    target = into or column
    lookup = pairs.filter(F.col("alias") != F.col("slug")).select(
        F.col("alias").alias("__alias"), F.col("slug").alias("__owner"))
    joined = df.join(lookup, F.col(column) == F.col("__alias"), "left")
    return joined.withColumn(target, F.coalesce("__owner", column)).drop("__alias", "__owner")


def identify(names: DataFrame, strains: DataFrame, column: str = "name") -> DataFrame:
    """Search identity and display name of free-text names.

    Known entity or alias -> owning slug and stored name; otherwise the name's
    own slug and the name as given.
    """
    keyed = names.withColumn("__slug", tx.slug(column))
    keyed = resolve(keyed, alias_pairs(strains), "__slug", "identity")
    stored = strains.select(F.col("slug").alias("identity"), F.col("name").alias("__stored"))
    return (keyed.join(entity_side(stored), "identity", "left")
            .withColumn("known", F.col("__stored").isNotNull())
            .withColumn("display_name",
                        F.coalesce(F.nullif("__stored", F.lit("")), F.col(column)))
            .drop("__slug", "__stored"))


def find_entity(names: DataFrame, strains: DataFrame, column: str = "name") -> DataFrame:
    """Entity rows for names: by slug, by alias, else by name ignoring case."""
    keyed = resolve(names.withColumn("__slug", tx.slug(column)), alias_pairs(strains),
                    "__slug", "__owner_slug")
    by_slug = strains.select(F.col("slug").alias("__owner_slug"), F.lit(True).alias("__hit"))
    keyed = keyed.join(entity_side(by_slug), "__owner_slug", "left")
    named = (strains.groupBy(F.lower("name").alias("__lname"))
             .agg(F.min("slug").alias("__named")))
    keyed = (keyed.withColumn("__lname", F.lower(tx.strip(column)))
             .join(entity_side(named), "__lname", "left")
             .withColumn("slug", F.when(F.col("__hit"), F.col("__owner_slug"))
                         .otherwise(F.col("__named")))
             .drop("__slug", "__owner_slug", "__hit", "__lname", "__named"))
    entity = strains.withColumnRenamed("name", "entity_name") if column == "name" else strains
    return keyed.join(entity_side(entity), "slug", "left")


def _safe_dictionary(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(pairs.items()), "alias STRING, slug STRING")


def seed_aliases(strains: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """Attach dictionary aliases to entities that exist.

    Creates no entity and never takes a spelling that is another entity's slug.
    """
    spark = strains.sparkSession
    wanted = _safe_dictionary(spark, V.SAFE_ALIASES if pairs is None else pairs)
    free = (wanted.filter(F.col("alias") != F.col("slug"))
            .join(entity_side(strains.select(F.col("slug").alias("alias"))), "alias", "left_anti"))
    extra = free.groupBy("slug").agg(F.collect_set("alias").alias("__extra"))
    merged: Column = F.array_sort(F.array_union(
        tx.alias_slugs("aliases"), F.coalesce("__extra", F.array().cast("array<string>"))))
    return (strains.join(extra, "slug", "left").withColumn("aliases", merged)
            .drop("__extra").select(*strains.columns))
