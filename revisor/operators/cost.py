"""Cost and stability of the strategies, from tables of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.operators.medians import exact_median

#: Spread that makes a point doubtful, shift that is still stable, spread of bytes read that still repeats (fixed values).
DOUBT, STABLE, REPEATS = 0.20, 0.05, 0.001


def footprint(objects: DataFrame, listing: DataFrame, by: list[str]) -> DataFrame:
    """Objects, bytes and rows of each group; missing and drifted count objects the listing lacks or sizes otherwise."""
    once = objects.dropDuplicates(["path"]).join(listing.select("path", F.col("size").alias("listed")), "path", "left")
    return once.groupBy(*by).agg(
        F.count("*").alias("objects"),
        F.sum("size").alias("bytes"),
        F.sum("records").alias("records"),
        F.count_if(F.col("listed").isNull()).alias("missing"),
        F.count_if(F.col("listed") != F.col("size")).alias("drifted"),
    )


def footprint_spread(footprints: DataFrame, by: list[str]) -> DataFrame:
    """Least, median and most bytes and objects of each group over its repetitions."""
    each = [f(c).alias(f"{c}_{name}") for c in ("bytes", "objects") for name, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    return footprints.groupBy(*by).agg(F.count("*").alias("repetitions"), *each)


def unreferenced(listing: DataFrame, referenced: DataFrame, by: list[str]) -> DataFrame:
    """Listed objects that nothing refers to."""
    return listing.join(referenced.select("path").distinct(), "path", "left_anti").groupBy(*by).agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def storage_delta(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """After less baseline of each measure: one conditional aggregate over both phases."""
    at = lambda m, p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col(m))), F.lit(0))
    return rows.groupBy(*by).agg(*((at(m, "after") - at(m, "baseline")).alias(f"{m}_delta") for m in measures))


def timing_audit(rows: DataFrame, by: list[str], expected: list[str]) -> DataFrame:
    """Whether the statements of each run have the frozen labels in order."""
    labels = F.transform(F.sort_array(F.collect_list(F.struct("index", "label"))), lambda x: x["label"])  # bounded by a run's statements
    return rows.groupBy(*by).agg(labels.alias("labels"), F.count("*").alias("statements")).select(*by, "statements", (F.col("labels") == F.array(*map(F.lit, expected))).alias("in_sequence"))


def per_repetition(timing: DataFrame, by: list[str]) -> DataFrame:
    """Seconds of each phase in each repetition."""
    phase = lambda p: F.sum(F.when(F.col("phase") == p, F.col("seconds")).otherwise(0.0))
    return timing.groupBy(*by, "repetition").agg(phase("write").alias("write_s"), phase("maintenance").alias("maintenance_s"), F.sum("seconds").alias("total_s"))


def apply_cost(timing: DataFrame, by: list[str]) -> DataFrame:
    """Median, least and most of the repetitions' sums, by strategy and point."""
    return per_repetition(timing, by).groupBy(*by).agg(
        F.count("*").alias("repetitions"),
        F.median("write_s").alias("write_median"),
        F.median("maintenance_s").alias("maintenance_median"),
        F.median("total_s").alias("total_median"),
        F.min("total_s").alias("total_min"),
        F.max("total_s").alias("total_max"),
    )


def apply_report(costs: DataFrame, storage: DataFrame, recall: DataFrame, revisions: DataFrame, by: list[str]) -> DataFrame:
    """``apply_cost`` with bytes before, after and added (medians of the repetitions), the rate of recall, and of revisions that are served.

    ``storage``: repetition, baseline_bytes, after_bytes, data_bytes added, of a table each.
    ``recall``: requests, exact.  ``revisions``: admitted, served.  Without requests or
    admitted revisions a rate is null.
    """
    sums = storage.groupBy(*by, "repetition").agg(F.sum("baseline_bytes").alias("before"), F.sum("after_bytes").alias("after"), F.sum("data_bytes").alias("data"))
    added = F.col("after") - F.col("before")
    sizes = sums.groupBy(*by).agg(
        F.median("before").alias("before_bytes_median"),
        F.median("after").alias("after_bytes_median"),
        F.median(added).alias("added_bytes_median"),
        F.min(added).alias("added_bytes_min"),
        F.max(added).alias("added_bytes_max"),
        F.median("data").alias("data_bytes_median"),
    )  # a row for each repetition
    rate = lambda df, part, whole, name: df.groupBy(*by).agg(F.round(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), 4).alias(name))
    out = costs.join(sizes, by, "left").join(rate(recall, "exact", "requests", "recall_rate"), by, "left").join(rate(revisions, "served", "admitted", "propagation_rate"), by, "left")
    return out.withColumn("metadata_bytes_median", F.col("added_bytes_median") - F.col("data_bytes_median"))


def arrival_cost(costs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cost of each arrival with the bytes it added over the one before."""
    w = Window.partitionBy("strategy").orderBy("point")
    return costs.join(sizes, ["strategy", "point"]).withColumn("bytes_added", F.col("bytes") - F.coalesce(F.lag("bytes").over(w), F.lit(0)))


def breakeven(costs: DataFrame, incremental: str) -> DataFrame:
    """Smallest measured point where the incremental strategy is no longer cheaper than another; nothing is interpolated."""
    own = costs.where(F.col("strategy") == incremental).select("point", F.col("total_median").alias("own"))
    rows = costs.where(F.col("strategy") != incremental).join(own, "point")
    dearer = F.col("own") >= F.col("total_median")
    by = rows.groupBy("strategy").agg(F.min(F.when(dearer, F.col("point"))).alias("breakeven_point"), F.every(dearer).alias("always"), F.some(dearer).alias("ever"))
    return by.select("strategy", "breakeven_point", F.when(F.col("always"), "never_cheaper").when(~F.col("ever"), "always_cheaper").otherwise("crosses").alias("direction"))


def linear_cost(costs: DataFrame, measure: str) -> DataFrame:
    """Least-squares line of a measure over the points, and the share of maintenance."""
    return costs.groupBy("strategy").agg(
        F.regr_intercept(measure, "point").alias("intercept"),
        F.regr_slope(measure, "point").alias("slope"),
        F.min(measure).alias("least"),
        F.max(measure).alias("most"),
        (F.sum("maintenance_median") / F.nullif(F.sum("total_median"), F.lit(0.0))).alias("maintenance_share"),
    )


def trend_resolved(costs: DataFrame) -> DataFrame:
    """A trend is resolved if the ranges at both ends are disjoint and the medians never turn."""
    w = Window.partitionBy("strategy").orderBy("point")
    rows = costs.withColumn("before", F.lag("total_median").over(w))
    up, down = F.coalesce(F.col("before") <= F.col("total_median"), F.lit(True)), F.coalesce(F.col("before") >= F.col("total_median"), F.lit(True))
    by = rows.groupBy("strategy").agg(
        F.min_by(F.struct("total_min", "total_max"), "point").alias("a"), F.max_by(F.struct("total_min", "total_max"), "point").alias("b"), (F.every(up) | F.every(down)).alias("monotone")
    )
    disjoint = (F.col("a.total_max") < F.col("b.total_min")) | (F.col("b.total_max") < F.col("a.total_min"))
    return by.select("strategy", disjoint.alias("ends_disjoint"), "monotone", (disjoint & F.col("monotone")).alias("resolved"))


def project_crossing(lines: DataFrame, trends: DataFrame, incremental: str, largest: float) -> DataFrame:
    """Where two fitted lines would cross: a projection with its status, and a number only if either trend is resolved."""
    lines = lines.join(trends.select("strategy", "resolved"), "strategy")
    own = lines.where(F.col("strategy") == incremental).select(F.col("intercept").alias("i0"), F.col("slope").alias("s0"), F.col("resolved").alias("r0"))
    rows = lines.where(F.col("strategy") != incremental).crossJoin(own)  # one row
    at = (F.col("i0") - F.col("intercept")) / F.nullif(F.col("slope") - F.col("s0"), F.lit(0.0))
    rows = rows.withColumn("at", at).withColumn("resolved", F.col("resolved") | F.col("r0"))
    status = (
        F.when(~F.col("resolved"), "flat_within_the_measured_ranges")
        .when(F.col("at").isNull(), "no_projection_possible")
        .when(F.col("at") <= 0, "lines_diverge")
        .when(F.col("at") > largest, "outside_measured_range")
        .otherwise("inside_measured_range_but_not_observed")
    )
    return rows.select("strategy", F.when(F.col("resolved") & (F.col("at") > 0), F.round("at")).alias("crossing"), status.alias("status"))


def doubt_rule(timing: DataFrame, by: list[str], threshold: float = DOUBT) -> DataFrame:
    """Points whose write times spread over more than ``threshold`` of their median."""
    spread = F.max("write_s") - F.min("write_s")
    ratio = spread / F.nullif(F.median("write_s"), F.lit(0.0))
    return per_repetition(timing, by).groupBy(*by).agg(ratio.alias("spread_ratio")).withColumn("doubtful", F.coalesce(F.col("spread_ratio") > threshold, F.lit(False)))


def pool_measurements(reported: DataFrame, extra: DataFrame, by: list[str], stable: float = STABLE) -> DataFrame:
    """Reported and pooled medians of each point, and whether they agree."""
    a = exact_median(reported, by, "seconds").withColumnRenamed("median", "reported_median")
    ran = extra.groupBy(*by).agg(F.count("*").alias("extra_runs"))
    b = exact_median(reported.select(*by, "seconds").unionByName(extra.select(*by, "seconds")), by, "seconds").withColumnRenamed("median", "pooled_median")
    rows = a.join(b, by).join(ran, by, "left").withColumn("extra_runs", F.coalesce("extra_runs", F.lit(0)))
    shift = F.abs(F.col("pooled_median") - F.col("reported_median")) / F.nullif(F.col("reported_median"), F.lit(0.0))
    status = F.when(F.col("extra_runs") == 0, "not_rerun").when(shift <= stable, "stable").otherwise("shifted")
    return rows.withColumn("shift", shift).withColumn("status", status)


def read_statistics(rows: DataFrame, by: list[str], counters: list[str], measure: str, tolerance: float = REPEATS) -> DataFrame:
    """Sums by repetition: counters must repeat exactly, the measure within a tolerance."""
    sums = rows.groupBy(*by, "repetition").agg(*(F.sum(c).alias(c) for c in (*counters, measure)))
    spread = (F.max(measure) - F.min(measure)) / F.nullif(F.max(measure), F.lit(0))
    return sums.groupBy(*by).agg(
        (F.count_distinct(F.struct(*counters)) == 1).alias("counters_repeat"),
        (spread <= tolerance).alias("within_tolerance"),
        F.median(measure).alias("median"),
        F.min(measure).alias("least"),
        F.max(measure).alias("most"),
    )


def cost_of_recall(recall: DataFrame, failures: DataFrame, lines: DataFrame, reads: DataFrame) -> DataFrame:
    """Recall, material failures, cost of a revision and bytes read of each strategy, with a verdict."""
    rows = recall.join(failures, "strategy", "left").join(lines, "strategy", "left").join(reads, "strategy", "left")
    verdict = F.when(F.col("recall_rate") >= 1, "full_recall").when(F.coalesce("material", F.lit(0)) > 0, "loses_values").otherwise("loses_provenance_only")
    return rows.select("strategy", "recall_rate", F.coalesce("material", F.lit(0)).alias("material"), "slope", "bytes_read", verdict.alias("verdict"))


def sweep_matrix(costs: DataFrame, strategies: list[str], measure: str) -> DataFrame:
    """One row for each point, a column for each strategy."""
    return costs.groupBy("point").pivot("strategy", strategies).agg(F.first(measure))


def figure_points(costs: DataFrame, measures: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Long form for plots: series, x, y and its range, for each measure (median, least, most columns)."""
    each = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(y).alias("y"), F.col(lo).alias("y_min"), F.col(hi).alias("y_max")) for n, (y, lo, hi) in measures.items()))
    return costs.select(F.col("strategy").alias("series"), F.col("point").alias("x"), F.explode(each).alias("m")).select("series", "x", "m.*")


def key_numbers(one_row: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Named numbers from a one-row table: metric, value, unit, derivation."""
    each = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(d).alias("derivation")) for c, (u, d) in names.items()))
    return one_row.select(F.explode(each).alias("k")).select("k.*")


def validation_rows(violations: DataFrame, checked: DataFrame) -> DataFrame:
    """invariant, passed, checked_rows, violations, from rules with their violations and a one-row count."""
    return violations.crossJoin(checked).select(F.col("rule").alias("invariant"), (F.col("violations") == 0).alias("passed"), "checked_rows", "violations")  # one row


def output_inventory(rows: DataFrame, output: str, source: str) -> DataFrame:
    """Rows, and the sources used, of each output."""
    return rows.groupBy(output).agg(F.count("*").alias("rows"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))
