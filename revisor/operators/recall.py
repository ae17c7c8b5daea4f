"""Recall: can a published value still be had under each strategy, and what is lost where it cannot.

A request has request_id, observation_id, cell_id, vintage_id, source_id, domain,
value and value_lexeme.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.operators.model import latest_by_cell
from revisor.operators.strategies import symmetric_difference


def recall_current(requests: DataFrame, serving: DataFrame) -> DataFrame:
    """B0 and B2: a request is met only if its observation is the one served."""
    served = serving.select("cell_id", F.col("observation_id").alias("served_id"), F.col("value_lexeme").alias("served_lexeme"))
    rows = requests.join(served, "cell_id", "left")
    hit = F.coalesce(F.col("served_id") == F.col("observation_id"), F.lit(False))
    result = F.when(F.col("served_id").isNull(), "not_served").when(hit, "exact").when(F.col("served_lexeme") == F.col("value_lexeme"), "same_value_other_vintage").otherwise("lost")
    return rows.select("request_id", "observation_id", "cell_id", "served_id", hit.alias("available"), result.alias("result"))


def recall_snapshots(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """B1: the snapshots that hold a request's observation."""
    found = snapshots.groupBy("observation_id").agg(F.sort_array(F.collect_set("snapshot_order")).alias("orders"))
    rows = requests.join(found, "observation_id", "left")
    return rows.select(
        "request_id",
        "observation_id",
        F.col("orders").isNotNull().alias("available"),
        F.get("orders", F.lit(0)).alias("first_order"),
        F.element_at("orders", -1).alias("last_order"),
        F.array_join("orders", ",").alias("matching_orders"),
    )


def recall_vintage_key(requests: DataFrame, store: DataFrame) -> DataFrame:
    """B3: look-up by cell and vintage; identity, number and text must all be those asked for."""
    held = store.select("cell_id", "vintage_id", F.col("observation_id").alias("held_id"), F.col("value").alias("held_value"), F.col("value_lexeme").alias("held_lexeme"))
    rows = requests.join(held, ["cell_id", "vintage_id"], "left")
    exact = (F.col("held_id") == F.col("observation_id")) & (F.col("held_value") == F.col("value")) & (F.col("held_lexeme") == F.col("value_lexeme"))
    return rows.select("request_id", "observation_id", F.col("held_id").isNotNull().alias("available"), F.coalesce(exact, F.lit(False)).alias("exact"))


def recall_audit(requests: DataFrame, strategies: DataFrame, facts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Addressability worked out anew: strategy, request, access class, matches and failure class.

    ``strategies``: strategy, cell_id, observation_id, historical (whether the row is
    served or only retained); a strategy serves one row of a cell.  ``names``: all its
    strategies; where they are not given, a pass over it finds them.  A request is joined
    once with what all strategies hold, and expanded to a row for each at the end.
    """
    names = names or sorted(r[0] for r in strategies.select("strategy").distinct().collect())  # few
    own = lambda n: F.col("strategy") == n
    at = range(len(names))
    held = strategies.groupBy("observation_id").agg(*(F.min(F.when(own(n), F.col("historical"))).alias(f"history{i}") for i, n in enumerate(names)))
    values = facts.select(F.col("observation_id").alias("served_id"), F.col("value").alias("v"), F.col("value_lexeme").alias("l"))
    # What a cell serves is the same row under most strategies: each is looked up once.
    served = strategies.where("not historical").groupBy("cell_id", F.col("observation_id").alias("served_id")).agg(*(F.max(own(n)).alias(f"by{i}") for i, n in enumerate(names)))
    of = lambda c, i: F.max(F.when(F.col(f"by{i}"), F.col(c))).alias(f"{c}{i}")
    served = served.join(values, "served_id", "left").groupBy("cell_id").agg(*(of(c, i) for c in ("v", "l") for i in at))
    rows = requests.select("request_id", "cell_id", "observation_id", "value", "value_lexeme").join(held, "observation_id", "left").join(served, "cell_id", "left")
    each = F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(f"history{i}").alias("only_history"), F.col(f"v{i}").alias("served_value"), F.col(f"l{i}").alias("served_lexeme")) for i, n in enumerate(names)))
    rows = rows.select("request_id", "value", "value_lexeme", F.explode(each).alias("s")).select("*", "s.*")
    found = F.col("only_history").isNotNull()
    access = F.when(found & ~F.col("only_history"), "serving").when(found, "historical").otherwise("unavailable")
    lexeme = F.coalesce(found | (F.col("served_lexeme") == F.col("value_lexeme")), F.lit(False))
    number = F.coalesce(found | (F.col("served_value") == F.col("value")), F.lit(False))
    failure = F.when(found, "none").when(lexeme, "duplicate_value").otherwise("material")
    return rows.select("strategy", "request_id", access.alias("access_class"), found.alias("identity_match"), number.alias("decimal_match"), lexeme.alias("lexeme_match"), failure.alias("failure_class"))


def recall_metrics(audit: DataFrame) -> DataFrame:
    """Requests, successes by class, failures and rate of each strategy."""
    return audit.groupBy("strategy").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("access_class") == "serving").alias("serving"),
        F.count_if(F.col("access_class") == "historical").alias("historical"),
        F.count_if(F.col("access_class") == "unavailable").alias("failures"),
        F.round(F.avg(F.col("identity_match").cast("double")), 4).alias("recall_rate"),
    )


def repeatability(measured: DataFrame, keys: list[str], values: list[str], expected: DataFrame) -> DataFrame:
    """Whether a key's values are the same in every repetition, and those expected."""
    by = measured.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("distinct_results"), F.min(F.struct(*values)).alias("v"), F.count("*").alias("repetitions"))
    want = expected.select(*keys, F.struct(*values).alias("want"))
    return by.join(want, keys, "left").select(*keys, "repetitions", (F.col("distinct_results") == 1).alias("repeatable"), F.coalesce(F.col("v") == F.col("want"), F.lit(False)).alias("as_expected"))


def lost_requests(requests: DataFrame, serving: DataFrame) -> DataFrame:
    """Requests whose observation no row of ``serving`` (strategy, cell_id, observation_id, value) is, with the value served instead."""
    s = serving.select("strategy", "cell_id", F.col("observation_id").alias("served_id"), F.col("value").alias("served_value"))
    rows = requests.join(s, "cell_id").where("served_id <> observation_id")
    return rows.withColumn("material", F.col("served_value") != F.col("value"))


def failure_profile(lost: DataFrame) -> DataFrame:
    """Lost requests by strategy, source, domain and level of area: all, with another value, with the same value."""
    return lost.groupBy("strategy", "source_id", "domain", "geo_level").agg(
        F.count("*").alias("lost"), F.count_if("material").alias("material"), F.count_if(~F.col("material")).alias("duplicate_value")
    )


def failure_cases(lost: DataFrame) -> DataFrame:
    """A row for each material loss with what was asked, what is served, and the difference."""
    rows = lost.where("material")
    return rows.select("strategy", "request_id", "cell_id", "observation_id", "served_id", "value", "served_value", (F.col("value") - F.col("served_value")).alias("delta"))


def superseded_serving(serving: DataFrame, fact: DataFrame) -> DataFrame:
    """Served rows that are not the latest of their cell and say another value than it."""
    latest = latest_by_cell(fact, ["observation_id", "value"]).select("cell_id", F.col("observation_id").alias("latest_id"), F.col("value").alias("latest_value"))
    return serving.join(latest, "cell_id").where((F.col("observation_id") != F.col("latest_id")) & (F.col("value") != F.col("latest_value")))


def failure_synthesis(profile: DataFrame, all_strategies: list[str], costs: DataFrame, metrics: DataFrame) -> DataFrame:
    """For each kind of failure: total, strategies affected, strategies free of it, and the cheapest of all with full recall.

    ``costs``: strategy, cost.  ``metrics``: strategy, recall_rate; ties go to the first name.
    """
    full = metrics.where("recall_rate >= 1").join(costs, "strategy").agg(F.min_by("strategy", F.struct("cost", "strategy")).alias("cheapest_full_recall"))
    long = profile.select("strategy", F.explode(F.create_map(F.lit("material"), "material", F.lit("duplicate_value"), "duplicate_value")).alias("failure", "n"))
    by = long.groupBy("failure").agg(F.sum("n").alias("total"), F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("strategy")))).alias("hit"))
    free = F.sort_array(F.array_except(F.array(*map(F.lit, all_strategies)), "hit"))
    return by.select("failure", "total", F.array_join("hit", ",").alias("affected"), F.array_join(free, ",").alias("free")).crossJoin(full)  # one row


def propagation_rate(injected: DataFrame, serving: DataFrame) -> DataFrame:
    """Share of injected revisions that each scenario and strategy serves."""
    seen = serving.select("scenario_id", "strategy", F.col("observation_id").alias("injected_id")).distinct()
    names = seen.select("strategy").distinct()
    every = injected.select("scenario_id", "injected_id").crossJoin(names)  # as many rows as strategies
    hit = every.join(seen.withColumn("hit", F.lit(1)), ["scenario_id", "strategy", "injected_id"], "left")
    return hit.groupBy("scenario_id", "strategy").agg(F.count("*").alias("admitted"), F.count("hit").alias("served"), (F.count("hit") / F.count("*")).alias("rate"))


def state_matches_expected(served: DataFrame, expected: DataFrame, untouched: DataFrame) -> DataFrame:
    """mismatches: rows of the served state that differ from expected cells and, for the others, the untouched state."""
    columns = ["cell_id", "observation_id"]
    want = expected.select(columns).unionByName(untouched.join(expected.select("cell_id"), "cell_id", "left_anti").select(columns))
    return symmetric_difference(served.select(columns), want).agg(F.count("*").alias("mismatches"))


def derived_vs_measured(derived: DataFrame, measured: DataFrame) -> DataFrame:
    """Official recalls worked out (all recalls less revised cells) against those measured."""
    rows = derived.join(measured, ["scenario_id", "strategy"])
    return rows.select("scenario_id", "strategy", "derived", "measured", (F.col("derived") == F.col("measured")).alias("agrees"))


def expected_arrival_states(catalog: DataFrame) -> DataFrame:
    """Rows and states that each strategy should hold after each arrival; the catalog has a row for each arrival."""
    so_far = Window.orderBy("arrival_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = catalog.withColumn("cells", F.sum("inserted").over(so_far)).withColumn("stored", F.sum("input_rows").over(so_far))
    rows = rows.withColumn("snapshots", F.sum("cells").over(so_far))
    per = F.create_map(F.lit("B0"), "cells", F.lit("B1"), "snapshots", F.lit("B2"), "cells", F.lit("B3"), "stored")
    return rows.select("arrival_order", F.explode(per).alias("strategy", "expected_rows"))
