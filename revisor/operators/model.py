"""The vintage model: releases, the observation fact, its constraints, and the latest value of a cell.

All functions take and return DataFrames.  A fact has at least cell_id,
observation_id, vintage_id, source_id, value, value_lexeme, unit, vintage_date,
retrieved_at and arrival_order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.functions.identity import decimal_of

#: Order of what was known: release date, then retrieval, then id.
KNOWLEDGE = ("vintage_date", "retrieved_at", "vintage_id")


def release_dimension(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """Distinct releases; ``conflicts`` counts the further attribute sets of one id, and must be 0."""
    one = F.struct(*attributes)
    return rows.groupBy("vintage_id").agg(F.min(one).alias("a"), (F.count_distinct(one) - 1).alias("conflicts")).select("vintage_id", "a.*", "conflicts")


def arrival_order(releases: DataFrame) -> DataFrame:
    """Rank of each release in knowledge order.  Releases are few, so one task ranks them."""
    return releases.withColumn("arrival_order", F.dense_rank().over(Window.orderBy(*KNOWLEDGE)).cast("long"))


def latest_by_cell(fact: DataFrame, columns: list[str]) -> DataFrame:
    """The latest vintage of each cell by a hash aggregate with partial aggregation, no sort."""
    return fact.groupBy("cell_id").agg(F.max_by(F.struct(*columns), F.struct(*KNOWLEDGE)).alias("v")).select("cell_id", "v.*")


def dedup_panel(rows: DataFrame) -> DataFrame:
    """Rows of one (cell, source): the latest retrieval is kept, then the smallest locator.

    Adds kept, kept_observation_id and conflict (a dropped row says another value).
    """
    w = Window.partitionBy("cell_id", "source_id").orderBy(F.col("retrieved_at").desc(), "source_record_id")
    first = F.first(F.struct("observation_id", "value", "value_lexeme", "unit")).over(w)
    ranked = rows.withColumn("place", F.row_number().over(w)).withColumn("winner", first)
    same = (F.col("value") == F.col("winner.value")) & (F.col("value_lexeme") == F.col("winner.value_lexeme")) & (F.col("unit") == F.col("winner.unit"))
    return ranked.select(*rows.columns, (F.col("place") == 1).alias("kept"), F.col("winner.observation_id").alias("kept_observation_id"), (~same).alias("conflict"))


#: Rules of the fact: those of a row, and those of a key's rows.
ROW_RULES = ("release_exists", "lexeme_is_value")
KEY_RULES = ("unique_observation", "unique_cell_vintage_record", "vintages_per_cell", "one_cell_per_trace")


def _row_flags(fact: DataFrame, releases: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    known = releases.select(F.col("vintage_id").alias("known_vintage")).distinct()
    rows = fact.join(known, F.col("vintage_id") == F.col("known_vintage"), "left")
    return rows, {"release_exists": F.col("known_vintage").isNull(), "lexeme_is_value": ~decimal_of(F.col("value_lexeme")).eqNullSafe(F.col("value").cast("decimal(38,10)"))}


def fact_constraints(fact: DataFrame, releases: DataFrame, vintages: tuple[int, int]) -> DataFrame:
    """rule, violations: one row for each constraint of the fact.  ``vintages``: least and most of a cell.

    The fact is read once: each row is expanded to its keys, one for each rule, and one
    grouping counts them; what breaks a rule of rows is summed beside.
    """
    rows, flags = _row_flags(fact, releases)
    entry = lambda rule, key, value, vintage=None, bad=None: F.struct(F.lit(rule).alias("rule"), key.alias("key"), value.alias("value"), (vintage if vintage is not None else F.lit(None).cast("string")).alias("vintage"), (bad if bad is not None else F.lit(False)).alias("bad"))
    c, none, joined = F.col, F.lit(None).cast("string"), lambda *k: F.to_json(F.struct(*k))
    entries = F.array(
        entry("unique_observation", c("observation_id"), none),
        entry("unique_cell_vintage_record", joined("cell_id", "vintage_id", "source_record_id"), none),
        entry("vintages_per_cell", c("cell_id"), none, c("vintage_id")),
        entry("one_cell_per_trace", joined("source_id", "source_record_id"), c("cell_id")),
        *(entry(rule, F.lit(""), none, None, bad) for rule, bad in flags.items()),
    )
    keyed = rows.select(F.explode(entries).alias("e")).select("e.*").groupBy("rule", "key")
    by_key = keyed.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.min("value").alias("low"), F.max("value").alias("high"), F.size(F.collect_set("vintage")).alias("vintages"))  # bounded by the vintages of a cell
    broken = (
        F.when(F.col("rule").isin(*ROW_RULES), F.col("bad"))
        .when(F.col("rule").startswith("unique"), (F.col("n") > 1).cast("long"))
        .when(F.col("rule") == "vintages_per_cell", (~F.col("vintages").between(*vintages)).cast("long"))
        .otherwise((F.col("low") != F.col("high")).cast("long"))
    )
    counts = by_key.groupBy("rule").agg(F.sum(broken).alias("violations"))
    every = fact.sparkSession.createDataFrame([(r,) for r in (*ROW_RULES, *KEY_RULES)], "rule string")
    return every.join(counts, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).alias("violations"))


def write_checked(fact: DataFrame, releases: DataFrame, path: str) -> dict[str, int]:
    """Write the fact and count its rows and what breaks the rules of rows while it is written."""
    rows, flags = _row_flags(fact, releases)
    seen = Observation()
    rows.observe(seen, F.count("*").alias("rows"), *(F.count_if(bad).alias(rule) for rule, bad in flags.items())).select(*fact.columns).write.parquet(path)
    return seen.get


def with_releases(observations: DataFrame, releases: DataFrame) -> DataFrame:
    """Observations with their release; ``problem`` is unknown_release where their source has none, else null."""
    rows = observations.join(releases, "source_id", "left")
    return rows.withColumn("problem", F.when(F.col("vintage_id").isNull(), "unknown_release"))
