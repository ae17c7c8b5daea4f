"""Queries over measurements: cost, break-even, stability, reads and tidy outputs.

Line items stand for measurements: strategy is return flag and line status, point
the line number, repetition the supplier modulo 3, phase the parity of the part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from revisor.operators import cost, medians, model, recall
from revisor.plans.bridge import fact, releases, sql, table
from revisor.plans.registry import query
from revisor.plans.vintage_queries import _BROKEN, _RULES, _broken, _constraints, _AUDIT, _METRICS, _audit_of, _lost_of, _stored


def _timing(spark, d):
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("strategy"),
        F.col("l_linenumber").cast("long").alias("point"),
        (F.col("l_suppkey") % 3 + 1).cast("long").alias("repetition"),
        F.when(F.col("l_partkey") % 2 == 0, "write").otherwise("maintenance").alias("phase"),
        F.col("l_quantity").cast("double").alias("seconds"),
        "l_orderkey",
    )


_T = """timing AS (SELECT l_returnflag || l_linestatus AS strategy, CAST(l_linenumber AS BIGINT) AS point, CAST(l_suppkey % 3 + 1 AS BIGINT) AS repetition, CASE WHEN l_partkey % 2 = 0 THEN 'write' ELSE 'maintenance' END AS phase,
        CAST(l_quantity AS DOUBLE) AS seconds, l_orderkey FROM lineitem),
    rep AS (SELECT strategy, point, repetition, sum(CASE WHEN phase = 'write' THEN seconds ELSE 0 END) AS write_s, sum(CASE WHEN phase = 'maintenance' THEN seconds ELSE 0 END) AS maintenance_s, sum(seconds) AS total_s FROM timing GROUP BY 1, 2, 3),
    costs AS (SELECT strategy, point, count(*) AS repetitions, median(write_s) AS write_median, median(maintenance_s) AS maintenance_median, median(total_s) AS total_median, min(total_s) AS total_min, max(total_s) AS total_max FROM rep GROUP BY 1, 2),
    lowest AS (SELECT min(strategy) AS s0 FROM costs)"""  # fmt: skip


def _costs(spark, d):
    return cost.apply_cost(_timing(spark, d), ["strategy", "point"])


#: The strategy that stands for the incremental one.
INCREMENTAL = "AF"


@query("footprint_fold", """WITH o AS (SELECT CAST(l_partkey AS VARCHAR) AS path, count(*) AS records FROM lineitem GROUP BY 1), l AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand, CAST(p_size AS BIGINT) * 1024 AS size FROM part)
    SELECT p_brand, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(records) AS BIGINT) AS records, CAST(0 AS BIGINT) AS missing, count(*) FILTER (length(path) = 2) AS drifted FROM o JOIN l USING (path) GROUP BY 1""")  # fmt: skip
def footprint_fold(spark, d):
    listing = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_brand", (F.col("p_size").cast("long") * 1024).alias("size"))
    objects = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.count("*").alias("records")).join(listing, "path")
    changed = listing.select("path", (F.col("size") + F.when(F.length("path") == 2, 1).otherwise(0)).alias("size"))
    return cost.footprint(objects, changed, ["p_brand"])


@query("footprint_spread", """WITH f AS (SELECT p_brand, p_size % 3 AS repetition, CAST(sum(CAST(p_size AS BIGINT) * 1024) AS BIGINT) AS bytes, count(*) AS objects FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1, 2)
    SELECT p_brand, count(*) AS repetitions, min(bytes) AS bytes_min, median(bytes) AS bytes_median, max(bytes) AS bytes_max, min(objects) AS objects_min, median(objects) AS objects_median, max(objects) AS objects_max FROM f GROUP BY 1""")  # fmt: skip
def footprint_spread(spark, d):
    listing = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_brand", (F.col("p_size") % 3).alias("repetition"), (F.col("p_size").cast("long") * 1024).alias("size"))
    objects = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("records")).join(listing, "path")
    return cost.footprint_spread(cost.footprint(objects, listing, ["p_brand", "repetition"]), ["p_brand"])


@query("unreferenced_objects", """SELECT p_brand, count(*) AS objects, CAST(sum(CAST(p_size AS BIGINT) * 1024) AS BIGINT) AS bytes FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1""")
def unreferenced_objects(spark, d):
    listing = table(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_brand", (F.col("p_size").cast("long") * 1024).alias("size"))
    return cost.unreferenced(listing, table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("path")), ["p_brand"])


@query("storage_delta", f"""WITH {_T} SELECT strategy, coalesce(sum(seconds) FILTER (phase = 'maintenance'), 0) - coalesce(sum(seconds) FILTER (phase = 'write'), 0) AS bytes_delta,
    CAST(coalesce(sum(repetition) FILTER (phase = 'maintenance'), 0) - coalesce(sum(repetition) FILTER (phase = 'write'), 0) AS BIGINT) AS rows_delta FROM timing GROUP BY 1""")  # fmt: skip
def storage_delta(spark, d):
    rows = _timing(spark, d).select("strategy", F.when(F.col("phase") == "write", "baseline").otherwise("after").alias("phase"), F.col("seconds").alias("bytes"), F.col("repetition").alias("rows"))
    return cost.storage_delta(rows, ["strategy"], ["bytes", "rows"])


@query("timing_audit", "SELECT l_orderkey, count(*) AS statements, string_agg(CAST(l_linenumber AS VARCHAR), '' ORDER BY l_linenumber) = '1234' AS in_sequence FROM lineitem GROUP BY 1")
def timing_audit(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("index"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("label"))
    return cost.timing_audit(rows, ["l_orderkey"], ["s1", "s2", "s3", "s4"])


@query("apply_cost", f"WITH {_T} SELECT * FROM costs")
def apply_cost(spark, d):
    return _costs(spark, d)


@query("apply_report", f"""WITH {_T}, st AS (SELECT strategy, point, repetition, count(*) * 100 AS before, count(*) * 100 + CAST(sum(seconds) AS BIGINT) AS after, CAST(sum(repetition) AS BIGINT) AS data FROM timing GROUP BY 1, 2, 3),
    z AS (SELECT strategy, point, median(before) AS before_bytes_median, median(after) AS after_bytes_median, median(after - before) AS added_bytes_median, min(after - before) AS added_bytes_min, max(after - before) AS added_bytes_max, median(data) AS data_bytes_median FROM st GROUP BY 1, 2),
    rc AS (SELECT strategy, point, round(count(*) FILTER (repetition = 1) / count(*), 4) AS recall_rate, round(count(*) FILTER (phase = 'write' AND seconds > 25) / nullif(count(*) FILTER (phase = 'write' AND point < 7), 0), 4) AS propagation_rate FROM timing GROUP BY 1, 2)
    SELECT *, added_bytes_median - data_bytes_median AS metadata_bytes_median FROM costs JOIN z USING (strategy, point) JOIN rc USING (strategy, point)""")  # fmt: skip
def apply_report(spark, d):
    rows, by = _timing(spark, d), ["strategy", "point"]
    hundred = F.lit(100).cast("long")
    storage = rows.select(*by, "repetition", hundred.alias("baseline_bytes"), (hundred + F.col("seconds").cast("long")).alias("after_bytes"), F.col("repetition").alias("data_bytes"))
    recalled = rows.select(*by, F.lit(1).alias("requests"), (F.col("repetition") == 1).cast("int").alias("exact"))
    write = F.col("phase") == "write"
    revised = rows.select(*by, (write & (F.col("point") < 7)).cast("int").alias("admitted"), (write & (F.col("seconds") > 25)).cast("int").alias("served"))
    return cost.apply_report(_costs(spark, d), storage, recalled, revised, by)


@query("exact_median", f"WITH {_T} SELECT strategy, phase, median(seconds * point) AS median FROM timing GROUP BY 1, 2")
def exact_median(spark, d):
    rows = _timing(spark, d).withColumn("x", F.col("seconds") * F.col("point"))
    return medians.exact_median(rows, ["strategy", "phase"], "x")


@query("arrival_cost", f"WITH {_T}, z AS (SELECT strategy, point, count(*) AS bytes FROM timing GROUP BY 1, 2) SELECT c.*, bytes, bytes - coalesce(lag(bytes) OVER (PARTITION BY strategy ORDER BY point), 0) AS bytes_added FROM costs c JOIN z USING (strategy, point)")
def arrival_cost(spark, d):
    sizes = _timing(spark, d).groupBy("strategy", "point").agg(F.count("*").alias("bytes"))
    return cost.arrival_cost(_costs(spark, d), sizes)


@query("breakeven", f"""WITH {_T}, j AS (SELECT c.strategy, c.point, o.total_median >= c.total_median AS dearer FROM costs c JOIN costs o ON c.point = o.point AND o.strategy = '{INCREMENTAL}' WHERE c.strategy <> '{INCREMENTAL}')
    SELECT strategy, min(point) FILTER (dearer) AS breakeven_point, CASE WHEN bool_and(dearer) THEN 'never_cheaper' WHEN NOT bool_or(dearer) THEN 'always_cheaper' ELSE 'crosses' END AS direction FROM j GROUP BY 1""")  # fmt: skip
def breakeven(spark, d):
    return cost.breakeven(_costs(spark, d), INCREMENTAL)


_LINES = "lines AS (SELECT strategy, regr_intercept(total_median, point) AS intercept, regr_slope(total_median, point) AS slope, min(total_median) AS least, max(total_median) AS most, sum(maintenance_median) / nullif(sum(total_median), 0) AS maintenance_share FROM costs GROUP BY 1)"


def _lines(spark, d):
    return cost.linear_cost(_costs(spark, d), "total_median")


@query("linear_cost", f"WITH {_T}, {_LINES} SELECT strategy, round(intercept, 4) AS intercept, round(slope, 4) AS slope, least, most, round(maintenance_share, 4) AS maintenance_share FROM lines")
def linear_cost(spark, d):
    return _lines(spark, d).withColumns({c: F.round(c, 4) for c in ("intercept", "slope", "maintenance_share")})


@query("trend_resolved", f"""WITH {_T}, b AS (SELECT *, lag(total_median) OVER (PARTITION BY strategy ORDER BY point) AS before FROM costs),
    e AS (SELECT strategy, arg_min(total_min, point) AS a0, arg_min(total_max, point) AS a1, arg_max(total_min, point) AS b0, arg_max(total_max, point) AS b1,
          bool_and(coalesce(before <= total_median, true)) OR bool_and(coalesce(before >= total_median, true)) AS monotone FROM b GROUP BY 1)
    SELECT strategy, a1 < b0 OR b1 < a0 AS ends_disjoint, monotone, (a1 < b0 OR b1 < a0) AND monotone AS resolved FROM e""")  # fmt: skip
def trend_resolved(spark, d):
    return cost.trend_resolved(_costs(spark, d))


#: Costs of which some strategies' rise with the point beyond their spread, so that their trends are resolved.
_RISING = "rising AS (SELECT strategy, point, " + ", ".join(f"{c} + CASE WHEN strategy IN ('AF', 'NO') THEN 1e9 * point WHEN strategy = 'RF' THEN -1e9 * point ELSE 0 END AS {c}" for c in ("total_median", "total_min", "total_max")) + ", maintenance_median FROM costs)"


def _rising(spark, d):
    more = F.when(F.col("strategy").isin("AF", "NO"), F.lit(1e9) * F.col("point")).when(F.col("strategy") == "RF", F.lit(-1e9) * F.col("point")).otherwise(0.0)
    return _costs(spark, d).withColumns({c: F.col(c) + more for c in ("total_median", "total_min", "total_max")})


@query("project_crossing", f"""WITH {_T}, {_RISING}, ln AS (SELECT strategy, regr_intercept(total_median, point) AS intercept, regr_slope(total_median, point) AS slope FROM rising GROUP BY 1),
    b AS (SELECT *, lag(total_median) OVER (PARTITION BY strategy ORDER BY point) AS before FROM rising),
    e AS (SELECT strategy, (arg_min(total_max, point) < arg_max(total_min, point) OR arg_max(total_max, point) < arg_min(total_min, point))
          AND (bool_and(coalesce(before <= total_median, true)) OR bool_and(coalesce(before >= total_median, true))) AS resolved FROM b GROUP BY 1),
    x AS (SELECT l.strategy, e.resolved OR f.resolved AS resolved, l.slope - o.slope AS gap, (o.intercept - l.intercept) / nullif(l.slope - o.slope, 0) AS crossing
          FROM ln l JOIN e USING (strategy), ln o JOIN e f USING (strategy) WHERE o.strategy = '{INCREMENTAL}' AND l.strategy <> '{INCREMENTAL}')
    SELECT strategy, CASE WHEN resolved AND crossing > 0 THEN round(crossing) END AS crossing,
           CASE WHEN NOT resolved THEN 'flat_within_the_measured_ranges' WHEN crossing IS NULL THEN 'no_projection_possible' WHEN crossing <= 0 THEN 'lines_diverge' WHEN crossing > 7 THEN 'outside_measured_range'
                ELSE 'inside_measured_range_but_not_observed' END AS status FROM x""")  # fmt: skip
def project_crossing(spark, d):
    rows = _rising(spark, d)
    return cost.project_crossing(cost.linear_cost(rows, "total_median"), cost.trend_resolved(rows), INCREMENTAL, 7)


@query("doubt_rule", f"WITH {_T} SELECT strategy, point, (max(write_s) - min(write_s)) / nullif(median(write_s), 0) AS spread_ratio, coalesce((max(write_s) - min(write_s)) / nullif(median(write_s), 0) > 0.2, false) AS doubtful FROM rep GROUP BY 1, 2")
def doubt_rule(spark, d):
    return cost.doubt_rule(_timing(spark, d), ["strategy", "point"])


@query("pool_measurements", f"""WITH {_T}, a AS (SELECT strategy, point, median(seconds) AS reported_median FROM timing WHERE phase = 'write' GROUP BY 1, 2), r AS (SELECT strategy, point, count(*) AS extra_runs FROM timing WHERE phase = 'maintenance' AND point > 2 GROUP BY 1, 2),
    b AS (SELECT strategy, point, median(seconds) AS pooled_median FROM timing WHERE phase = 'write' OR point > 2 GROUP BY 1, 2)
    SELECT strategy, point, reported_median, pooled_median, coalesce(extra_runs, 0) AS extra_runs, abs(pooled_median - reported_median) / nullif(reported_median, 0) AS shift,
           CASE WHEN coalesce(extra_runs, 0) = 0 THEN 'not_rerun' WHEN abs(pooled_median - reported_median) / nullif(reported_median, 0) <= 0.05 THEN 'stable' ELSE 'shifted' END AS status
    FROM a JOIN b USING (strategy, point) LEFT JOIN r USING (strategy, point)""")  # fmt: skip
def pool_measurements(spark, d):
    rows = _timing(spark, d)
    return cost.pool_measurements(rows.where("phase = 'write'"), rows.where("phase = 'maintenance' AND point > 2"), ["strategy", "point"])


@query("read_statistics", f"""WITH {_T}, s AS (SELECT strategy, repetition, CAST(sum(point) AS BIGINT) AS files, sum(seconds) AS bytes FROM timing GROUP BY 1, 2)
    SELECT strategy, count(DISTINCT files) = 1 AS counters_repeat, (max(bytes) - min(bytes)) / nullif(max(bytes), 0) <= 0.001 AS within_tolerance, median(bytes) AS median, min(bytes) AS least, max(bytes) AS most FROM s GROUP BY 1""")  # fmt: skip
def read_statistics(spark, d):
    rows = _timing(spark, d).withColumnRenamed("point", "files").withColumnRenamed("seconds", "bytes")
    return cost.read_statistics(rows, ["strategy"], ["files"], "bytes")


@query("cost_of_recall", sql(f"""WITH {_AUDIT}, m AS ({_METRICS}), l AS (SELECT 'B0' AS strategy, count(*) AS material FROM fact f JOIN current c USING (cell_id) WHERE f.observation_id <> c.observation_id AND f.value <> c.value
        UNION ALL SELECT 'B2', count(*) FROM fact f JOIN selected c USING (cell_id) WHERE f.observation_id <> c.observation_id AND f.value <> c.value), {_T}, {_LINES},
    names AS (SELECT strategy, 'B' || CAST(row_number() OVER (ORDER BY strategy) - 1 AS VARCHAR) AS b FROM lines)
    SELECT m.strategy, recall_rate, coalesce(material, 0) AS material, round(slope, 4) AS slope, bytes_read, CASE WHEN recall_rate >= 1 THEN 'full_recall' WHEN coalesce(material, 0) > 0 THEN 'loses_values' ELSE 'loses_provenance_only' END AS verdict
    FROM m LEFT JOIN l ON l.strategy = m.strategy LEFT JOIN names n ON n.b = m.strategy LEFT JOIN lines ON lines.strategy = n.strategy LEFT JOIN (SELECT strategy, count(*) AS bytes_read FROM timing GROUP BY 1) t ON t.strategy = n.strategy""", "fact", "current", "selected"))  # fmt: skip
def cost_of_recall(spark, d):
    from pyspark.sql.window import Window

    lines = _lines(spark, d)
    names = lines.select("strategy", F.concat(F.lit("B"), (F.row_number().over(Window.orderBy("strategy")) - 1).cast("string")).alias("b"))  # a row for each strategy
    rows = _stored(spark, d)
    failures = _lost_of(rows).groupBy("strategy").agg(F.count_if("material").alias("material"))
    reads = _timing(spark, d).groupBy("strategy").agg(F.count("*").alias("bytes_read")).join(names, "strategy").drop("strategy").withColumnRenamed("b", "strategy")
    slopes = lines.join(names, "strategy").drop("strategy").withColumnRenamed("b", "strategy").select("strategy", F.round("slope", 4).alias("slope"))
    return cost.cost_of_recall(recall.recall_metrics(_audit_of(rows)), failures, slopes, reads)


_FLAGS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query("sweep_matrix", f"WITH {_T} SELECT point, " + ", ".join(f"max(total_median) FILTER (strategy = '{s}') AS {s}" for s in _FLAGS) + " FROM costs GROUP BY 1")
def sweep_matrix(spark, d):
    return cost.sweep_matrix(_costs(spark, d), _FLAGS, "total_median")


@query("figure_points", f"WITH {_T} SELECT strategy AS series, point AS x, 'total' AS measure, total_median AS y, total_min AS y_min, total_max AS y_max FROM costs UNION ALL SELECT strategy, point, 'write', write_median, write_median, write_median FROM costs")
def figure_points(spark, d):
    return cost.figure_points(_costs(spark, d), {"total": ("total_median", "total_min", "total_max"), "write": ("write_median", "write_median", "write_median")})


@query("key_numbers", sql("""WITH k AS (SELECT CAST(count(*) AS DOUBLE) AS observations, CAST(count(DISTINCT cell_id) AS DOUBLE) AS cells, CAST(count(DISTINCT vintage_id) AS DOUBLE) AS releases FROM fact)
    SELECT 'observations' AS metric, observations AS value, 'rows' AS unit, 'count of the fact' AS derivation FROM k UNION ALL SELECT 'cells', cells, 'cells', 'distinct cells' FROM k UNION ALL SELECT 'releases', releases, 'releases', 'distinct vintages' FROM k""", "fact"))  # fmt: skip
def key_numbers(spark, d):
    one = fact(spark, d).agg(F.count("*").alias("observations"), F.count_distinct("cell_id").alias("cells"), F.count_distinct("vintage_id").alias("releases"))
    return cost.key_numbers(one, {"observations": ("rows", "count of the fact"), "cells": ("cells", "distinct cells"), "releases": ("releases", "distinct vintages")})


@query("validation_rows", sql(f"WITH {_BROKEN}, v AS ({_RULES}) SELECT rule AS invariant, violations = 0 AS passed, (SELECT count(*) FROM broken) AS checked_rows, violations FROM v", "fact"))
def validation_rows(spark, d):
    return cost.validation_rows(_constraints(spark, d), _broken(spark, d).agg(F.count("*").alias("checked_rows")))


@query("output_inventory", sql("SELECT domain, count(*) AS rows, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM fact GROUP BY 1", "fact"))
def output_inventory(spark, d):
    return cost.output_inventory(fact(spark, d), "domain", "source_id")
