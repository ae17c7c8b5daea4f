"""Comparison of releases cell by cell, and the classes of their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisor.functions.identity import decimal_of, identity, last_place, merge_flags

#: What makes two published values comparable; the unit counts, unlike in a cell's identity.
CELL = ["indicator_key", "series_key", "observed_period", "geo_level", "geo_code", "unit"]
OBSERVATION = ["indicator_key", "series_key", "observed_period", "geo_level", "geo_code", "unit", "source_id", "release_date"]


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    by_source = F.sort_array(F.collect_list(F.struct("source_id", "value_lexeme")))  # bounded by the number of sources
    return rows.groupBy(*keys).agg(
        F.count_distinct("source_id").alias("snapshot_count"),
        F.count_distinct("value").alias("distinct_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.to_json(by_source).alias("source_values"),
        (F.count("*") - F.count_distinct("source_id")).alias("repeated"),
    )


def compare_snapshots(rows: DataFrame, keys: list[str] = CELL, expected: int | None = None) -> DataFrame:
    """Cells over all snapshots: missing in some, exact, or with differing values.  ``repeated`` must be 0."""
    by = _grouped(rows, keys)
    count = F.lit(expected) if expected else F.col("all_snapshots")
    if not expected:
        by = by.crossJoin(rows.agg(F.count_distinct("source_id").alias("all_snapshots")))  # one row
    status = F.when(F.col("snapshot_count") < count, "missing_snapshot").when(F.col("distinct_values") == 1, "exact_match").otherwise("value_mismatch")
    return by.withColumn("status", status)


def compare_sparse(rows: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """As ``compare_snapshots``, but sources may be absent: a cell of one source is not compared."""
    by = _grouped(rows, keys)
    status = F.when(F.col("snapshot_count") == 1, "single_source").when(F.col("distinct_values") == 1, "exact_match").otherwise("value_mismatch")
    return by.withColumn("status", status)


def pivot_discrepancies(rows: DataFrame, sources: list[str], keys: list[str] = CELL) -> DataFrame:
    """Cells that are not equal in all sources, values side by side; a gap is told from a difference."""
    side = [F.max(F.when(F.col("source_id") == s, F.col("value_lexeme"))).alias(f"value_{s}") for s in sources]
    by = rows.groupBy(*keys).agg(*side, F.count_distinct("source_id").alias("n"), F.count_distinct("value").alias("d"))
    out = by.where((F.col("n") < len(sources)) | (F.col("d") > 1))
    return out.withColumn("kind", F.when(F.col("n") < len(sources), "coverage_gap").otherwise("unclassified_difference")).drop("n", "d")


def release_candidates(compared: DataFrame, rule: dict[str, str]) -> DataFrame:
    """Mismatches with the candidate cause that a rule gives for their indicator, else a release revision."""
    known = F.create_map(*(F.lit(x) for kv in rule.items() for x in kv)) if rule else F.create_map().cast("map<string,string>")
    return compared.where("status = 'value_mismatch'").withColumn("candidate", F.coalesce(F.try_element_at(known, F.col("indicator_key")), F.lit("release_revision_candidate")))


def classify_difference(compared: DataFrame, published: Column, updated: Column) -> DataFrame:
    """Mismatches: rounding where the spread is within one unit of the last published place, else a revision where the source was updated later."""
    step = last_place(F.col("places"))
    label = F.when(F.col("spread") <= step, "last_digit_difference").when(updated > published, "candidate_revision").otherwise("unclassified_difference")
    return compared.where("status = 'value_mismatch'").withColumn("classification", label)


def granularity_report(rows: DataFrame, keys: list[str], parent: str, child: str) -> DataFrame:
    """A parent's value against the plain mean of its children; groups without one parent and some child are left out."""
    up, down = F.col("geo_level") == parent, F.col("geo_level") == child
    by = rows.groupBy(*keys).agg(
        F.count_if(up).alias("parents"),
        F.max(F.when(up, F.col("value"))).alias("parent_value"),
        F.count_if(down).alias("children"),
        F.min(F.when(down, F.col("value"))).alias("child_min"),
        F.max(F.when(down, F.col("value"))).alias("child_max"),
        F.sum(F.when(down, F.col("value"))).alias("child_sum"),
    )
    mean = F.col("child_sum").cast("double") / F.col("children")
    return by.where("parents = 1 and children > 0").select(
        *keys,
        "parent_value",
        "children",
        "child_min",
        "child_max",
        F.round(mean, 4).alias("child_mean"),
        F.round(F.col("parent_value").cast("double") - mean, 4).alias("gap"),
        F.col("parent_value").between(F.col("child_min"), F.col("child_max")).alias("in_range"),
    )


def indicator_summary(compared: DataFrame, by: list[str]) -> DataFrame:
    """Overlap, agreement and the largest spread of each group."""
    overlap = F.count_if(F.col("snapshot_count") > 1)
    differ = F.count_if(F.col("status") == "value_mismatch")
    return compared.groupBy(*by).agg(
        F.count("*").alias("cells"),
        overlap.alias("overlap"),
        F.count_if(F.col("status") == "exact_match").alias("exact"),
        differ.alias("mismatch"),
        F.count_if(F.col("snapshot_count") == 1).alias("missing"),
        F.round(differ / F.nullif(overlap, F.lit(0)), 4).alias("mismatch_rate"),
        F.max("spread").alias("max_spread"),
    )


def domain_summary(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """Observations and cells of each domain, compared and not."""
    counts = rows.groupBy("domain").agg(F.count("*").alias("observations"))
    cells = compared.groupBy("domain").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("status") != "single_source").alias("compared"),
        F.count_if(F.col("status") == "exact_match").alias("exact"),
        F.count_if(F.col("status") == "value_mismatch").alias("mismatch"),
        F.count_if(F.col("status") == "single_source").alias("single"),
    )
    return counts.join(cells, "domain")


def scope_overlap(rows: DataFrame, one: str, two: str, by: str, keys: list[str]) -> DataFrame:
    """Keys in either source and in both, and the range of periods, for each group."""
    flags = rows.groupBy(by, *keys).agg(F.max((F.col("source_id") == one).cast("int")).alias("a"), F.max((F.col("source_id") == two).cast("int")).alias("b"), F.min("observed_period").alias("p0"), F.max("observed_period").alias("p1"))
    out = flags.groupBy(by).agg(
        F.sum("a").alias("in_one"), F.sum("b").alias("in_two"), F.sum(F.col("a") * F.col("b")).alias("in_both"), F.min("p0").alias("first_period"), F.max("p1").alias("last_period")
    )
    return out.withColumn("status", F.when(F.col("in_both") == 0, "disjoint").when((F.col("in_both") == F.col("in_one")) & (F.col("in_both") == F.col("in_two")), "same_scope").otherwise("partial_overlap"))


def apply_coverage(inventory: DataFrame, coverage: DataFrame) -> DataFrame:
    """The inventory with derived status and flags where there are some, and whether a row changed."""
    c = coverage.select("indicator_key", F.col("status").alias("new_status"), F.col("flags").alias("new_flags"))
    rows = inventory.join(c, "indicator_key", "left")
    status, flags = F.coalesce("new_status", "status"), merge_flags(F.col("flags"), F.col("new_flags"))
    same = status.eqNullSafe(F.col("status")) & flags.eqNullSafe(F.col("flags"))
    return rows.select("indicator_key", status.alias("status"), flags.alias("flags"), (~same).alias("changed"))


def validate_inventory(rows: DataFrame, sources: DataFrame, statuses: list[str]) -> DataFrame:
    """rule, key: a row for each violation of the inventory's rules."""
    def broken(rule: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(rule).alias("rule"), F.col("indicator_key").alias("key"))

    known = sources.select(F.col("source_id").alias("source"))
    listed = rows.select("indicator_key", F.explode(F.split("sources", ";")).alias("source")).where("source <> ''")
    return (
        broken("missing_key", rows.where(F.coalesce(F.trim("indicator_key"), F.lit("")) == ""))
        .unionByName(broken("duplicate_key", rows.groupBy("indicator_key").count().where("count > 1")))
        .unionByName(broken("unknown_status", rows.where(~F.col("status").isin(statuses))))
        .unionByName(broken("unknown_source", listed.join(known, "source", "left_anti").select("indicator_key").distinct()))
        .unionByName(broken("verified_without_source", rows.where((F.col("status") == "verified") & (F.coalesce("sources", F.lit("")) == ""))))
    )


def ingest_union(datasets: dict[str, DataFrame], domains: DataFrame, batch: str, keys: list[str]) -> DataFrame:
    """Datasets as one, with domain and batch; problem names what is wrong with a row, null if nothing."""
    out = None
    for name, rows in datasets.items():
        part = rows.withColumn("input_dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    rows = out.join(domains, "domain_key", "left").withColumn("ingestion_batch_id", F.lit(batch))
    seen = out.groupBy("input_dataset", *keys).agg(F.count("*").alias("n_same"))
    rows = rows.join(seen, ["input_dataset", *keys])
    problem = F.when(F.col("domain").isNull(), "unmapped").when(decimal_of(F.col("value_lexeme")).isNull(), "not_finite").when(F.col("n_same") > 1, "duplicate")
    return rows.withColumn("problem", problem).drop("n_same")


def ingestion_inventory(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("indicator_key").alias("indicators"), F.min("observed_period").alias("first_period"), F.max("observed_period").alias("last_period"))


def classify_events(mismatches: DataFrame, gaps: DataFrame, singles: DataFrame, rules: DataFrame) -> DataFrame:
    """Three kinds of events (kind, label, key, detail) with an id and the rule of their kind and label; a missing rule is named."""
    rows = None
    for kind, part in (("difference", mismatches), ("granularity", gaps.where("gap <> 0")), ("coverage", singles)):
        part = part.select(F.lit(kind).alias("input_kind"), F.col("label").alias("input_label"), F.col("key"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("event_id", identity("input_kind", "input_label", "key"))
    out = rows.join(rules, ["input_kind", "input_label"], "left")
    return out.withColumn("classification", F.coalesce("classification", F.lit("missing_rule")))


def release_change(mismatches: DataFrame, candidate: str, changed: str, pair: tuple[str, str]) -> DataFrame:
    """``mismatches`` with the label ``changed`` for candidates that two dated releases both published, with different values."""
    values = F.from_json("source_values", "array<struct<source_id:string,value_lexeme:string>>")
    lexeme = lambda source: F.get(F.filter(values, lambda v: v["source_id"] == source), F.lit(0))["value_lexeme"]
    one, two = map(lexeme, pair)
    both = (F.col("label") == candidate) & F.coalesce(decimal_of(one) != decimal_of(two), F.lit(False))
    return mismatches.withColumn("label", F.when(both, changed).otherwise(F.col("label")))


def missing_rules(events: DataFrame) -> DataFrame:
    """The kinds and labels of events that no rule covers, with their number: each is a violation."""
    return events.where("classification = 'missing_rule'").groupBy("input_kind", "input_label").agg(F.count("*").alias("events"))


def classification_summary(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("events"))


#: What each criterion must reach (fixed values).
GATE = {"mismatch_domains": 3.0, "core_share": 0.70, "confirmed_core_share": 0.70, "direct_traces": 1.0}


def gate_metrics(events: DataFrame, core: list[str]) -> DataFrame:
    """criterion, value, passed: are the differences widespread, explained and traceable."""
    is_core, confirmed = F.col("cause_family").isin(core), F.col("evidence_level") == "confirmed"
    one = events.agg(
        F.count_distinct("domain").cast("double").alias("mismatch_domains"),
        F.coalesce(F.avg(is_core.cast("double")), F.lit(0.0)).alias("core_share"),
        F.coalesce(F.avg((is_core & confirmed).cast("double")), F.lit(0.0)).alias("confirmed_core_share"),
        F.count_if(confirmed).cast("double").alias("direct_traces"),
    )
    out = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.round(F.col(k), 4).alias("value"), (F.round(F.col(k), 4) >= v).alias("passed")) for k, v in GATE.items()))).alias("c"))
    return out.select("c.*")


def promote_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Reviewed evidence overrides the class of candidates; the original class stays beside it.

    Evidence counts if it names where it was found (``reference``) and a source of its
    own (``source_id``), one that is not among the event's (``sources``, an array).
    """
    rows = events.join(evidence.select("event_id", "promoted_classification", "reference", F.col("source_id").alias("evidence_source")), "event_id", "left")
    corroborates = (F.coalesce("reference", F.lit("")) != "") & F.coalesce(~F.array_contains("sources", F.col("evidence_source")), F.lit(False))
    may = F.col("classification").endswith("candidate") & corroborates
    new = F.when(may, F.coalesce("promoted_classification", "classification")).otherwise(F.col("classification"))
    refused = F.col("promoted_classification").isNotNull() & ~may
    out = {"original_classification": F.col("classification"), "classification": new, "refused": refused}
    return rows.withColumns(out).drop("promoted_classification", "reference", "evidence_source")


def revision_traces(events: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """The vintage rows behind each event in order: events have ``sources``, an array of source ids."""
    steps = events.select("event_id", *keys, F.posexplode("sources").alias("vintage_order", "source_id"))
    return steps.join(observations, [*keys, "source_id"]).withColumn("vintage_order", F.col("vintage_order") + 1)


def cause_distribution(events: DataFrame) -> DataFrame:
    """Events of each cause and their share."""
    by = events.groupBy("cause_family").agg(F.count("*").alias("events"))
    total = by.agg(F.sum("events").alias("total"))
    return by.crossJoin(total).select("cause_family", "events", F.round(F.col("events") / F.col("total"), 4).alias("share"))  # one row for each cause


def inventory_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))
