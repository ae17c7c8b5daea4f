"""Four ways to maintain the served state, and what each does on every arrival.

B0 overwrites, B1 keeps a full snapshot for each release, B2 serves one trusted
source, B3 appends to a vintage store and resolves the cells an arrival touches.
Every window is partitioned by cell_id, so the operators of one plan share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.functions.identity import changed, identity
from revisor.operators.model import KNOWLEDGE
from revisor.operators.states import LEAF_ROWS, state_digest
from revisor.sources.files import written


def by_arrival():
    return Window.partitionBy("cell_id").orderBy("arrival_order")


def by_knowledge():
    return Window.partitionBy("cell_id").orderBy(*KNOWLEDGE)


def whole_cell():
    return Window.partitionBy("cell_id")


def overwrite_state(fact: DataFrame) -> DataFrame:
    """B0: the last arrival of each cell, with the observation it replaced."""
    is_last = F.lead("cell_id").over(by_arrival()).isNull()  # the same order as the lag, so one sort serves both
    rows = fact.withColumn("replaced_observation_id", F.lag("observation_id").over(by_arrival())).withColumn("is_last", is_last)
    return rows.where("is_last").drop("is_last").withColumnRenamed("arrival_order", "applied_order")


def upsert(state: DataFrame, arrived: DataFrame, columns: list[str]) -> DataFrame:
    """One arrival over a state with one row for each cell: a full outer join, the arrival first."""
    new = arrived.select("cell_id", F.struct(*columns).alias("new"))
    old = state.select("cell_id", F.struct(*columns).alias("old"))
    return old.join(new, "cell_id", "full_outer").select("cell_id", F.coalesce("new", "old").alias("v")).select("cell_id", "v.*")


def overwrite_operations(fact: DataFrame) -> DataFrame:
    """What each arrival did to B0: inserted, overwritten, of those changed or same, and rows so far."""
    before = F.lag(F.struct("value")).over(by_arrival())
    rows = fact.withColumn("before", before)
    by = rows.groupBy("arrival_order").agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.col("before").isNull()).alias("inserted"),
        F.count_if(F.col("before").isNotNull()).alias("overwritten"),
        F.count_if(F.col("before.value") != F.col("value")).alias("value_changed"),
        F.count_if(F.col("before.value") == F.col("value")).alias("same_value"),
    )
    return by.withColumn("state_rows", F.sum("inserted").over(Window.orderBy("arrival_order").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each arrival


def validity(fact: DataFrame) -> DataFrame:
    """Carry-forward intervals: each observation is what its cell says from its arrival until before the next."""
    return fact.withColumn("valid_from", F.col("arrival_order")).withColumn("valid_to", F.lead("arrival_order").over(by_arrival()))


def full_snapshots(fact: DataFrame, last_order: int) -> DataFrame:
    """B1: the whole state after each release.  The intervals expand, so nothing is joined by range."""
    until = F.coalesce(F.col("valid_to") - 1, F.lit(last_order))
    orders = F.explode(F.sequence(F.col("valid_from").cast("int"), until.cast("int")))
    return validity(fact).withColumn("snapshot_order", orders).drop("valid_from", "valid_to")


def snapshot_catalog(fact: DataFrame, last_order: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """A row for each snapshot: what its release did, its size and its key."""
    states = written(full_snapshots(fact, last_order).select("snapshot_order", "vintage_id", "cell_id", "observation_id", "value_lexeme"), "states")
    sizes = states.groupBy("snapshot_order").agg(F.count_distinct("vintage_id").alias("vintages"))
    digests = state_digest(states, ["snapshot_order"], ["cell_id", "observation_id", "value_lexeme"], leaf_rows).withColumnRenamed("digest", "state_digest")
    done = overwrite_operations(fact).drop("state_rows").withColumnRenamed("arrival_order", "snapshot_order")
    return done.join(sizes, "snapshot_order").join(digests, "snapshot_order").withColumn("snapshot_key", identity(F.lit("B1"), "snapshot_order", "state_digest"))


#: Weights of trust, and the worth of a source's role and format (fixed values).
TRUST = {"authority": 0.30, "provenance": 0.20, "role": 0.20, "format": 0.15, "coverage": 0.15}
ROLES = {"indicator_values_and_definitions": 1.0, "indicator_values": 0.75}
FORMATS = {"json": 1.0, "csv": 1.0, "pdf": 0.75}


def _worth(column: str, worth: dict[str, float]):
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in worth.items() for x in kv)), F.col(column)), F.lit(0.0))


def trust_scores(fact: DataFrame, registry: DataFrame, authority: str, places: int = 6) -> DataFrame:
    """Trust of each source: five weighted parts, none of which looks at the values.  ``authority``: the official publisher."""
    cells = fact.groupBy("source_id").agg(F.avg((F.col("source_record_id") != "").cast("double")).alias("provenance"), F.count_distinct("cell_id").alias("cells"))
    total = fact.agg(F.count_distinct("cell_id").alias("all_cells"))
    parts = {
        "authority": (F.col("publisher") == authority).cast("double"),
        "provenance": F.col("provenance"),
        "role": _worth("role", ROLES),
        "format": _worth("format", FORMATS),
        "coverage": F.col("cells") / F.col("all_cells"),
    }
    score = sum((parts[k] * w for k, w in TRUST.items()), F.lit(0.0))
    scored = registry.join(cells, "source_id").crossJoin(total).withColumn("trust_score", F.round(score, places))  # total is one row
    rank = Window.orderBy(F.col("trust_score").desc(), F.col("vintage_date").desc(), "source_id")  # sources are few
    return scored.select("source_id", "vintage_date", "trust_score").withColumn("source_rank", F.row_number().over(rank).cast("long"))


def ranked_candidates(fact: DataFrame, scores: DataFrame) -> DataFrame:
    """Every candidate of a cell in order of trust, release date, source and id."""
    few = scores.select("source_id", "trust_score", "source_rank")
    w = Window.partitionBy("cell_id").orderBy(F.col("trust_score").desc(), F.col("vintage_date").desc(), "source_id", "observation_id")
    return (
        fact.join(few, "source_id")
        .withColumn("choice", F.row_number().over(w))
        .withColumn("candidate_count", F.count("*").over(whole_cell()))
        .withColumn("last_arrival", F.max("arrival_order").over(whole_cell()))
    )


def select_single_source(fact: DataFrame, scores: DataFrame) -> DataFrame:
    """B2: the most trusted observation of each cell."""
    rows = ranked_candidates(fact, scores).where("choice = 1")
    return rows.withColumn("discarded_candidate_count", F.col("candidate_count") - 1).withColumn("selected_is_latest_vintage", F.col("arrival_order") == F.col("last_arrival")).drop("choice", "last_arrival")


def selection_preview(fact: DataFrame, scores: DataFrame) -> DataFrame:
    """Selected, runner-up and latest observation of each cell, by one conditional aggregate."""
    rows = ranked_candidates(fact, scores)
    at = lambda n: F.max(F.when(F.col("choice") == n, F.struct("observation_id", "value")))
    by = rows.groupBy("cell_id").agg(at(1).alias("one"), at(2).alias("two"), F.max_by(F.struct("observation_id", "value"), F.struct(*KNOWLEDGE)).alias("latest"))
    return by.select(
        "cell_id",
        F.col("one.observation_id").alias("selected_id"),
        F.col("two.observation_id").alias("runner_up_id"),
        F.col("latest.observation_id").alias("latest_id"),
        (F.col("one.observation_id") == F.col("latest.observation_id")).alias("is_latest"),
        (F.col("one.value") == F.col("latest.value")).alias("value_equals_latest"),
    )


def discarded_candidates(fact: DataFrame, scores: DataFrame) -> DataFrame:
    """The losers of each cell and why they lost."""
    w = Window.partitionBy("cell_id").orderBy("choice")
    rows = ranked_candidates(fact, scores).withColumn("w", F.first(F.struct("observation_id", "trust_score", "vintage_date", "source_id")).over(w)).where("choice > 1")
    reason = (
        F.when(F.col("trust_score") < F.col("w.trust_score"), "lower_trust_score")
        .when(F.col("vintage_date") < F.col("w.vintage_date"), "tie_break_older_vintage")
        .when(F.col("source_id") > F.col("w.source_id"), "tie_break_source_id")
        .otherwise("tie_break_observation_id")
    )
    return rows.select("cell_id", "observation_id", F.col("w.observation_id").alias("selected_id"), reason.alias("reason"))


def admitted(store: DataFrame, arrived: DataFrame) -> DataFrame:
    """The rows of an arrival with ``refused``: in_store if the store holds their (cell, vintage), repeated if an earlier row of the arrival has it, else null."""
    order = Window.partitionBy("cell_id", "vintage_id").orderBy("observation_id", "source_record_id")
    held = store.select("cell_id", "vintage_id").distinct().withColumn("held", F.lit(True))
    rows = arrived.withColumn("place", F.row_number().over(order)).join(held, ["cell_id", "vintage_id"], "left")
    return rows.withColumn("refused", F.when(F.col("held"), "in_store").when(F.col("place") > 1, "repeated")).drop("place", "held")


def vintage_store(store: DataFrame, arrived: DataFrame) -> DataFrame:
    """B3: the rows of an arrival that the store takes, one for each (cell, vintage) it does not hold yet; replays add nothing."""
    return admitted(store, arrived).where("refused IS NULL").select(arrived.columns)


def resolve_cells(store: DataFrame) -> DataFrame:
    """B3: latest value of each cell, how many vintages it has and how often its value changed."""
    before = F.lag("value").over(by_knowledge())
    is_last = F.lead("cell_id").over(by_knowledge()).isNull()  # the same order as the lag, so one sort serves both
    rows = store.withColumn("was", changed(F.col("value"), before).cast("long")).withColumn("is_last", is_last)
    rows = rows.withColumn("vintage_count", F.count("*").over(whole_cell())).withColumn("value_revision_count", F.sum("was").over(whole_cell()))
    return rows.where("is_last").drop("is_last", "was")


def dirty_cells(edges: DataFrame, arrived: DataFrame) -> DataFrame:
    """Cells that the arriving observations reach through the lineage edges; ``mismatch`` counts those that are not the row's own."""
    reach = edges.where("relationship = 'observation_materializes_cell'").select(F.col("from_id").alias("observation_id"), F.col("to_id").alias("reached"))
    hit = arrived.select("observation_id", "cell_id").join(reach, "observation_id")
    return hit.groupBy(F.col("reached").alias("cell_id")).agg(F.count_if(F.col("reached") != F.col("cell_id")).alias("mismatch"))


def incremental_serving(serving: DataFrame, store: DataFrame, arrived: DataFrame, order: int) -> DataFrame:
    """Resolve the cells that an arrival touches and keep the others; ``store`` holds the arrival already."""
    dirty = arrived.select("cell_id").distinct()
    fresh = resolve_cells(store.join(dirty, "cell_id", "left_semi")).withColumn("recomputed_at_arrival", F.lit(order).cast("long"))
    kept = serving.join(dirty, "cell_id", "left_anti")
    return kept.unionByName(fresh.select(kept.columns))


def arrival_catalog(fact: DataFrame) -> DataFrame:
    """For each arrival: cells recomputed and untouched, and how the resolution of the recomputed ones changed.

    A running argmax gives the resolution before and after each row, so one pass serves all arrivals.
    """
    now = F.max(F.struct(*KNOWLEDGE, "value")).over(by_arrival().rowsBetween(Window.unboundedPreceding, 0))
    rows = fact.withColumn("now", now).withColumn("before", F.lag("now").over(by_arrival()))
    moved = F.col("before").isNotNull() & (F.col("now.vintage_id") != F.col("before.vintage_id"))
    by = rows.groupBy("arrival_order").agg(
        F.count("*").alias("dirty_cells"),
        F.count_if(F.col("before").isNull()).alias("inserted"),
        F.count_if(moved).alias("resolved_changed"),
        F.count_if(moved & (F.col("now.value") != F.col("before.value"))).alias("value_changed"),
        F.count_if(moved & (F.col("now.value") == F.col("before.value"))).alias("provenance_only"),
        F.count_if(F.col("before").isNotNull() & (F.col("now.vintage_id") == F.col("before.vintage_id"))).alias("unchanged"),
    )
    so_far = Window.orderBy("arrival_order").rowsBetween(Window.unboundedPreceding, 0)  # a row for each arrival
    return by.withColumn("store_rows", F.sum("dirty_cells").over(so_far)).withColumn("serving_rows", F.sum("inserted").over(so_far)).withColumn("untouched", F.col("serving_rows") - F.col("dirty_cells"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def asof_states(fact: DataFrame, last_order: int) -> DataFrame:
    """For each release bound, the latest vintage known by then: intervals in knowledge order, expanded."""
    order = F.dense_rank().over(Window.orderBy(*KNOWLEDGE))
    bounds = fact.select(*KNOWLEDGE).distinct().withColumn("known_order", order)  # a row for each release
    rows = fact.join(bounds.select("vintage_id", "known_order"), "vintage_id")
    until = F.lead("known_order").over(Window.partitionBy("cell_id").orderBy("known_order"))
    rows = rows.withColumn("known_until", F.coalesce(until - 1, F.lit(last_order)))
    return rows.withColumn("bound_order", F.explode(F.sequence("known_order", "known_until"))).drop("known_until")


def asof_lookup(requests: DataFrame, fact: DataFrame) -> DataFrame:
    """The observation of a cell known at a request's date, null before the first.

    Requests and facts stand in one order by date, and a request takes the last fact
    before it: the work is a sort of each cell's rows, not requests times vintages.
    """
    known = fact.select("cell_id", F.col("vintage_date").alias("at"), F.struct(*KNOWLEDGE).alias("order"), F.struct("observation_id", "value_lexeme").alias("v"))
    asked = requests.select("*", F.col("as_of").alias("at"), F.lit(True).alias("asked"))
    both = known.withColumn("asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    w = Window.partitionBy("cell_id").orderBy("at", "asked", "order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("found", F.last("v", ignorenulls=True).over(w)).where("asked")
    return found.select(*requests.columns, "found.observation_id", "found.value_lexeme")


def all_strategies(fact: DataFrame, scores: DataFrame, last_order: int) -> DataFrame:
    """The served state of all four strategies: strategy, cell_id, observation_id."""
    out = None
    for name, state in (
        ("B0", overwrite_state(fact)),
        ("B1", full_snapshots(fact, last_order).where(F.col("snapshot_order") == last_order)),
        ("B2", select_single_source(fact, scores)),
        ("B3", resolve_cells(fact)),
    ):
        rows = state.select(F.lit(name).alias("strategy"), "cell_id", "observation_id")
        out = rows if out is None else out.unionByName(rows)
    return out
