"""Deterministic what-if revisions: scenarios are a column, so one job serves them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.functions.identity import SEPARATOR, identity, last_place
from revisor.sources.files import written


def rank_universe(cells: DataFrame, seed: str, k: int | None = None) -> DataFrame:
    """Every cell with its rank, from 1, in the order of sha256(seed, cell); with ``k`` the first k cells only.

    A range sort orders the cells over tasks and the counts of the parts give each its
    first rank; with ``k`` each task keeps k rows, so no task ever sorts all cells.
    """
    key = F.sha2(F.concat(F.lit(seed + SEPARATOR), "cell_id"), 256)
    order = ("selection_key", "cell_id")
    keyed = cells.withColumn("selection_key", key)
    if k is not None:
        return keyed.orderBy(*order).limit(k).withColumn("selection_rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each task
    firsts = counts.select("part", before.alias("before"))
    within = F.col("place") - F.shiftleft("part", 33)
    return placed.withColumn("part", part).join(firsts, "part").withColumn("selection_rank", F.col("before") + within + 1).drop("part", "before", "place")


def nested_scenarios(ranked: DataFrame, scenarios: DataFrame, universe_size: DataFrame) -> DataFrame:
    """scenario_id, cell_id, share: each scenario holds the first ``selection_count`` cells, so smaller ones are in larger ones.

    Scenarios are few and travel as one row; a null count stands for the whole universe.
    """
    one = scenarios.agg(F.collect_list(F.struct("scenario_id", "selection_count")).alias("scenarios")).crossJoin(universe_size)
    sized = F.transform("scenarios", lambda s: F.struct(s["scenario_id"].alias("scenario_id"), F.coalesce(s["selection_count"], "cells").alias("selection_count")))
    rows = ranked.crossJoin(one.select(sized.alias("scenarios"), "cells"))  # one row
    own = F.filter("scenarios", lambda s: F.col("selection_rank") <= s["selection_count"])
    out = rows.withColumn("s", F.explode(own)).select("s.*", *(c for c in rows.columns if c != "scenarios"))
    return out.withColumn("share", F.round(F.col("selection_count") / F.col("cells"), 6))


def mutate_one_unit(rows: DataFrame) -> DataFrame:
    """The value moved by one unit of its last place: up, or down where a percentage would pass 100."""
    step = last_place(F.col("places"))
    up = F.col("value").cast("decimal(28,10)") + step
    after = F.when((F.col("unit") == "percent") & (up > 100), F.col("value").cast("decimal(28,10)") - step).otherwise(up).cast("decimal(28,10)")
    texts = [F.when(F.col("places") == p, F.col("after").cast(f"decimal(28,{p})").cast("string")) for p in range(11)]
    return rows.withColumn("after", after).withColumn("after_lexeme", F.coalesce(*texts))


def synthetic_release(releases: DataFrame, label: str) -> DataFrame:
    """A release one day after the latest official one."""
    one = releases.agg(F.date_add(F.max("vintage_date"), 1).alias("vintage_date"), F.max("arrival_order").alias("last"))
    return one.select(F.lit(label).alias("source_id"), "vintage_date", (F.col("last") + 1).cast("long").alias("arrival_order"), identity(F.lit(label), "vintage_date", F.lit("synthetic")).alias("vintage_id"))


def synthetic_observations(injected: DataFrame, base: DataFrame, release: DataFrame) -> DataFrame:
    """Injected cells as observations of the synthetic release; ``base_matches`` says whether the base is of the cell."""
    b = base.select(F.col("observation_id").alias("base_id"), F.col("cell_id").alias("base_cell"), F.col("source_id").alias("revised_source"), "value", "unit", "places", "domain")
    rows = mutate_one_unit(injected.join(b, "base_id")).crossJoin(release)  # one row
    return rows.withColumn("observation_id", identity("cell_id", "vintage_id", "scenario_id")).withColumn("base_matches", F.col("base_cell") == F.col("cell_id"))


def inherit_lineage(synthetic: DataFrame, edges: DataFrame) -> DataFrame:
    """Cell edges of the synthetic observations, taken over from their base observations."""
    own = edges.where("relationship = 'observation_materializes_cell'").select(F.col("from_id").alias("base_id"), "to_id")
    rows = synthetic.select("base_id", F.col("observation_id").alias("from_id")).join(own, "base_id")
    rel = F.lit("observation_materializes_cell")
    return rows.select(identity("from_id", rel, "to_id").alias("edge_id"), "from_id", rel.alias("relationship"), "to_id")


def route_matrix(scenarios: DataFrame, strategies: list[str]) -> DataFrame:
    """Every scenario under every strategy with one payload digest for the scenario."""
    digest = F.sha2(F.concat_ws(SEPARATOR, "scenario_id", "selection_count"), 256)
    return scenarios.withColumn("payload_sha256", digest).withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))


def _routed(synthetic: DataFrame, official: DataFrame, scores: DataFrame) -> DataFrame:
    """Each injected cell under each strategy, with ``takes``: whether the strategy serves the injected value.

    B2 scores an injected row by the source it revises.  It is the latest of its cell, so
    it is taken unless the served source has a higher score.  A source without a score is an error.
    """
    known = scores.select(F.col("source_id").alias("revised_source"), F.col("trust_score").alias("revised_score"))
    rows = synthetic.join(known, "revised_source", "left").withColumn("revised_score", F.coalesce("revised_score", F.raise_error(F.lit("no frozen score")).cast("double")))
    rows = rows.join(official.withColumnRenamed("observation_id", "served_id").withColumnRenamed("value", "served_value"), "cell_id")
    return rows.withColumn("takes", (F.col("strategy") != "B2") | (F.col("revised_score") >= F.col("trust_score")))


def execute_routes(synthetic: DataFrame, official: DataFrame, scores: DataFrame, observations: DataFrame) -> DataFrame:
    """What each scenario does under each strategy.

    ``synthetic``: scenario_id, cell_id, observation_id, after, base_id, revised_source.
    ``official``: cell_id, strategy, observation_id, value, trust_score and is_latest as
    served before.  ``observations``: one row, the number of stored observations.

    B0 writes the revised cells, B1 the whole state again, B2 the cells that change and B3
    the new rows and the cells they reach.  B1 and B3 can give every observation, B0 and
    B2 those they serve.
    """
    rows = _routed(synthetic, official, scores)
    keeps_base = F.col("strategy").isin("B1", "B3") | ~F.col("takes") | (F.col("served_id") != F.col("base_id"))
    by = rows.groupBy("scenario_id", "strategy").agg(
        F.count("*").alias("cells"),
        F.count_if("takes").alias("served_new"),
        F.count_if(~F.col("takes")).alias("refused"),
        F.count_if(F.col("takes") & (F.col("after") != F.col("served_value"))).alias("value_changed"),
        F.count_if(keeps_base).alias("base_still_addressable"),
        F.count_if(~keeps_base).alias("base_unavailable"),
        F.count_if(~F.col("takes") & (F.col("served_id") == F.col("base_id"))).alias("base_still_served"),
        F.count_if("is_latest").alias("were_latest"),
    )
    states = official.groupBy("strategy").agg(F.count("*").alias("all_cells"), F.count_if("is_latest").alias("all_latest"))
    rows = by.join(states, "strategy").crossJoin(observations.toDF("stored"))  # one row
    n, every, whole = F.col("cells"), F.col("all_cells"), F.col("strategy").isin("B1", "B3")
    requests = F.col("stored") + n
    found = {
        "cells_evaluated": F.when(F.col("strategy") == "B1", every).otherwise(n),
        "rows_written": F.when(F.col("strategy") == "B1", every).when(F.col("strategy") == "B2", F.col("served_new")).when(F.col("strategy") == "B3", 2 * n).otherwise(n),
        "latest_cells": F.col("all_latest") - F.col("were_latest") + F.col("served_new"),
        "requests": requests,
        "addressable": F.when(whole, requests).otherwise(every),
        "unavailable": F.when(whole, F.lit(0).cast("long")).otherwise(requests - every),
    }
    return rows.withColumns(found).drop("all_cells", "all_latest", "were_latest", "stored")


def served_after(synthetic: DataFrame, official: DataFrame, scores: DataFrame) -> DataFrame:
    """scenario_id, strategy, cell_id, observation_id, lexeme: what the revised cells say after each scenario; served_id is what they said before."""
    rows = _routed(synthetic, official, scores)
    return rows.select("scenario_id", "strategy", "cell_id", F.when(F.col("takes"), F.col("observation_id")).otherwise(F.col("served_id")).alias("observation_id"), F.when(F.col("takes"), F.col("after_lexeme")).alias("new_lexeme"), "served_id")


def scenario_expectations(scenarios: DataFrame, cells: DataFrame, observations: DataFrame) -> DataFrame:
    """For each scenario and strategy: cells to evaluate and rows to write.

    B0 and B3 touch the revised cells; B1 and B2 rewrite all cells.  ``cells`` and
    ``observations`` are one-row counts.
    """
    rows = scenarios.crossJoin(cells).crossJoin(observations)  # one row each
    none, few, all_cells = F.lit(0).cast("long"), F.col("selection_count"), F.col("cells")
    work = {"B0": (few, few, none), "B1": (all_cells, all_cells, none), "B2": (all_cells, all_cells, none), "B3": (few, few, F.col("observations") + few)}
    structs = [F.struct(a.alias("evaluated"), b.alias("written"), c.alias("store")) for a, b, c in work.values()]
    per = F.map_from_arrays(F.array(*map(F.lit, work)), F.array(*structs))
    return rows.select("scenario_id", F.explode(per).alias("strategy", "x")).select("scenario_id", "strategy", "x.*")
