"""Operators on small literal tables: the fixture of three releases, order, replays and refusals."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from revisor.functions import identity as fn
from revisor.operators import compare, cost, inject, lineage, model, recall, strategies
from revisor.plans.bridge import LINEAGE
from revisor.sources import files, versions

#: 14 cells in each of two releases, 10 of them in the third; 4 values change at the second, 10 at the third.
RELEASES = [("a", date(2024, 1, 1), 1, 14), ("b", date(2024, 2, 1), 2, 14), ("c", date(2024, 3, 1), 3, 10)]


@pytest.fixture(scope="module")
def fact(spark):
    rows = []
    for source, day, order, n in RELEASES:
        for cell in range(n):
            value = {1: 100 + cell, 2: 100 + cell + (1 if cell < 4 else 0), 3: 200 + cell}[order]
            rows.append((f"cell{cell:02d}", f"{source}{cell:02d}", f"v-{source}", source, "d0", float(value), f"{value}.00", "amount", f"rec{cell}", day, datetime(day.year, day.month, day.day, 1), order, 2))
    columns = "cell_id string, observation_id string, vintage_id string, source_id string, domain string, value double, value_lexeme string, unit string, source_record_id string, vintage_date date, retrieved_at timestamp, arrival_order int, places int"
    return spark.createDataFrame(rows, columns).withColumn("value", F.col("value").cast("decimal(18,2)")).cache()


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_operations_of_each_release(fact):
    got = _rows(strategies.overwrite_operations(fact), "arrival_order", "input_rows", "inserted", "overwritten", "value_changed", "same_value")
    assert got == [(1, 14, 14, 0, 0, 0), (2, 14, 0, 14, 4, 10), (3, 10, 0, 10, 10, 0)]


def test_dirty_cells_of_each_arrival(fact):
    got = _rows(strategies.arrival_catalog(fact), "arrival_order", "dirty_cells", "untouched", "store_rows")
    assert got == [(1, 14, 0, 14), (2, 14, 0, 28), (3, 10, 4, 38)]


def test_snapshots_are_the_asof_states(fact):
    a = strategies.full_snapshots(fact, 3).select(F.col("snapshot_order").cast("int"), "cell_id", "observation_id")
    b = strategies.asof_states(fact, 3).select(F.col("bound_order").cast("int").alias("snapshot_order"), "cell_id", "observation_id")
    assert a.count() == 42 and strategies.symmetric_difference(a, b).count() == 0
    last = a.where("snapshot_order = 3").select("cell_id", "observation_id")
    assert strategies.symmetric_difference(last, strategies.overwrite_state(fact).select("cell_id", "observation_id")).count() == 0


def test_resolution_does_not_depend_on_arrival(fact):
    late = fact.withColumn("arrival_order", 4 - F.col("arrival_order"))
    columns = ["cell_id", "observation_id", "vintage_count", "value_revision_count"]
    assert strategies.symmetric_difference(strategies.resolve_cells(fact).select(columns), strategies.resolve_cells(late).select(columns)).count() == 0


def test_incremental_is_full(fact):
    columns = ["cell_id", "observation_id", "vintage_count"]
    serving = strategies.resolve_cells(fact.where("arrival_order = 1")).select(columns).withColumn("recomputed_at_arrival", F.lit(1).cast("long"))
    for order in (2, 3):
        serving = strategies.incremental_serving(serving, fact.where(F.col("arrival_order") <= order), fact.where(F.col("arrival_order") == order), order)
    assert strategies.symmetric_difference(serving.select(columns), strategies.resolve_cells(fact).select(columns)).count() == 0
    assert serving.where("recomputed_at_arrival = 3").count() == 10


def test_a_replayed_arrival_adds_nothing(fact):
    assert strategies.vintage_store(fact, fact.where("arrival_order = 3")).count() == 0


def test_selected_and_discarded_are_the_input(spark, fact):
    scores = spark.createDataFrame([("a", 0.5, 3), ("b", 0.9, 1), ("c", 0.9, 2)], "source_id string, trust_score double, source_rank long")
    chosen, lost = strategies.select_single_source(fact, scores), strategies.discarded_candidates(fact, scores)
    both = chosen.select("observation_id").unionByName(lost.select("observation_id"))
    assert strategies.symmetric_difference(both, fact.select("observation_id")).count() == 0
    reasons = dict(lost.groupBy("reason").count().collect())
    assert reasons == {"lower_trust_score": 14, "tie_break_older_vintage": 10}


def test_recall_of_the_fixture(fact):
    asked = fact.withColumn("request_id", F.col("observation_id"))
    now = recall.recall_current(asked, strategies.overwrite_state(fact)).agg(F.avg(F.col("available").cast("double"))).first()[0]
    assert round(now, 4) == 0.3684
    assert recall.recall_snapshots(asked, strategies.full_snapshots(fact, 3)).where("not available").count() == 0
    assert recall.recall_vintage_key(asked, fact).where("not exact").count() == 0


def test_lookup_by_date(spark, fact):
    asked = spark.createDataFrame([(1, "cell00", date(2023, 1, 1)), (2, "cell00", date(2024, 1, 1)), (3, "cell00", date(2024, 2, 15)), (4, "none", date(2024, 2, 15))], "request_id int, cell_id string, as_of date")
    assert _rows(strategies.asof_lookup(asked, fact).fillna(""), "request_id", "observation_id") == [(1, ""), (2, "a00"), (3, "b00"), (4, "")]


def test_upsert(spark):
    old = spark.createDataFrame([("x", 1), ("y", 2)], "cell_id string, v int")
    new = spark.createDataFrame([("y", 3), ("z", 4)], "cell_id string, v int")
    assert _rows(strategies.upsert(old, new, ["v"]), "cell_id", "v") == [("x", 1), ("y", 3), ("z", 4)]


def test_nested_scenarios_are_prefixes(spark, fact):
    cells = fact.select("cell_id").distinct()
    ranked = inject.rank_universe(cells, "seed", 8)
    assert _rows(ranked, "cell_id") == _rows(inject.rank_universe(cells, "seed", 8), "cell_id")
    sizes = spark.createDataFrame([("s1", 2), ("s2", 8)], "scenario_id string, selection_count long")
    plan = inject.nested_scenarios(ranked, sizes, cells.agg(F.count("*").alias("cells")))
    one, two = ({r.cell_id for r in plan.where(F.col("scenario_id") == s).collect()} for s in ("s1", "s2"))
    assert one < two and len(two) == 8


@pytest.mark.parametrize(("value", "places", "unit", "after"), [("5.00", 2, "amount", "5.01"), ("100.0", 1, "percent", "99.9"), ("7", 0, "amount", "8")])
def test_mutation(spark, value, places, unit, after):
    rows = spark.createDataFrame([(value, places, unit)], "value string, places int, unit string").withColumn("value", F.col("value").cast("decimal(28,10)"))
    assert inject.mutate_one_unit(rows).first()["after_lexeme"] == after


def test_published_identity(spark):
    got = spark.range(1).select(fn.identity(*map(F.lit, ("sdg08_productivity_growth", "total", "2025", "province", "1300")))).first()[0]
    assert got == "f655daf9c7189ef53b78"
    assert spark.range(1).select(fn.identity(F.lit(None).cast("string"), F.lit("x")) == fn.identity(F.lit(""), F.lit("x"))).first()[0]


def test_expressions(spark):
    row = spark.sql("SELECT 'of 2019/20' AS label, 'a;b' AS f, 'b;c' AS g, 'p=1;var=42' AS loc, 'NaN' AS nan, '12.50' AS num").select(
        fn.year_of(F.col("label")), fn.merge_flags(F.col("f"), F.col("g")), fn.key_value(F.col("loc"), "var"), fn.decimal_of(F.col("nan")), fn.decimal_places(F.col("num")), fn.normalise_name(F.lit("<b>Kep. Riau</b>"))
    )
    assert tuple(row.first()) == (2019, "a;b;c", "42", None, 2, "KEPULAUANRIAU")


def test_compare_reports_repeated_rows(spark):
    columns = "indicator_key string, series_key string, observed_period string, geo_level string, geo_code string, unit string, source_id string, value double, value_lexeme string"
    key = ("i", "s", "2020", "n", "1", "u")
    rows = spark.createDataFrame([(*key, "x", 5.0, "5.00"), (*key, "x", 5.0, "5.00"), (*key, "y", 6.0, "6.00")], columns)
    got = compare.compare_snapshots(rows).first()
    assert got["status"] == "value_mismatch" and got["repeated"] == 1
    assert compare.compare_snapshots(rows.limit(0)).count() == 0


def test_conflicting_panel_rows_are_shown(spark, fact):
    again = fact.limit(1).withColumn("value", F.col("value") + 1).withColumn("retrieved_at", F.col("retrieved_at") - F.expr("INTERVAL 1 DAY"))
    assert model.dedup_panel(fact.unionByName(again)).where("conflict and not kept").count() == 1


def test_lineage_reaches_the_manifest(fact):
    g = fact.withColumn("manifest_sha256", F.sha2("source_id", 256))
    assert lineage.trace_upstream(lineage.lineage_edges(g, LINEAGE), g.select("cell_id").distinct()).count() == 38
    assert {r.violations for r in lineage.graph_integrity(lineage.lineage_nodes(g, LINEAGE), lineage.lineage_edges(g, LINEAGE)).collect()} == {0}


def test_orphans_and_dangling_edges_are_found(fact):
    g = fact.withColumn("manifest_sha256", F.sha2("source_id", 256))
    nodes, edges = lineage.lineage_nodes(g, LINEAGE), lineage.lineage_edges(g, LINEAGE)
    broken = dict(lineage.graph_integrity(nodes.where("node_type <> 'indicator_cell'"), edges).collect())
    assert broken["dangling_edge"] == 14


def test_doubtful_points(spark):
    rows = spark.createDataFrame([("s", 1, r, "write", t) for r, t in ((1, 10.0), (2, 10.5), (3, 14.0))], "strategy string, point int, repetition int, phase string, seconds double")
    assert cost.doubt_rule(rows, ["strategy", "point"]).first()["doubtful"]
    assert not cost.doubt_rule(rows.where("repetition < 3"), ["strategy", "point"]).first()["doubtful"]


def test_fitted_line(spark):
    rows = spark.createDataFrame([("s", x, 3.0 + 2 * x, 1.0, 5.0) for x in (1, 2, 4)], "strategy string, point int, m double, maintenance_median double, total_median double")
    got = cost.linear_cost(rows, "m").first()
    assert round(got["intercept"], 9) == 3 and round(got["slope"], 9) == 2


def test_csv_rows_of_wrong_length_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.scan_strict_csv(spark, f"file://{tmp_path}/x.csv", ["a", "b"], ["a"]).collect()
    with pytest.raises(ValueError):
        files.scan_strict_csv(spark, f"file://{tmp_path}/x.csv", ["a", "b"], ["c"])


def test_manifest_of_files_and_inputs(spark, tmp_path):
    spark.range(7).write.parquet(f"file://{tmp_path}/in")
    path = f"file://{tmp_path}/t"
    manifest = files.write_manifested(spark.read.parquet(f"file://{tmp_path}/in"), path)
    assert {r.kind: r.rows for r in manifest.groupBy("kind").agg(F.sum("rows").alias("rows")).collect()} == {"output": 7, "input": 7}
    listed = manifest.where("kind = 'output'")
    status = lambda found, m: {r.status for r in files.verify_manifest(found, m).collect()}
    found = files.file_digests(spark, path, "*.parquet").join(listed.select("name", "rows"), "name")
    assert status(found, listed) == {"ok"}
    assert status(found, listed.withColumn("sha256", F.lit("0" * 64))) == {"drifted"}
    assert status(found, listed.withColumn("rows", F.col("rows") + 1)) == {"rows_differ"}
    assert status(found.limit(0), listed) == {"missing"} and status(found, listed.limit(0)) == {"unlisted"}


def test_old_versions_are_dropped(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    versions.write_versions(spark.range(48).select("id", (F.col("id") % 12).alias("version")), path)
    assert versions.expire_versions(spark, path, keep=2) == list(range(10))
    assert {r.version for r in spark.read.parquet(path).collect()} == {10, 11} and len(list((tmp_path / "v").glob("version=*"))) == 2
    assert versions.expire_versions(spark, path, keep=2) == []


def test_one_version_is_read_as_of_a_date(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    versions.write_versions(spark.range(3000).select("id", (F.col("id") % 3 + 1).alias("version")), path)
    dates = spark.createDataFrame([(date(2024, k, 1), k) for k in (1, 2, 3)], "vintage_date date, version long")
    at = lambda y, m, d: versions.version_asof(spark, path, dates, F.lit(date(y, m, d)))
    assert at(2024, 2, 20).agg(F.count("*"), F.min("version"), F.max("version")).first()[:] == (1000, 2, 2)
    assert at(2024, 1, 1).count() == 1000 and at(2023, 12, 31).count() == 0
    found = at(2024, 2, 20)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString() and _scanned(found) == 1000  # partitions of the other versions are not read


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def test_bucketed_store_is_not_exchanged(spark, tmp_path):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("cell_id"), F.col("id").alias("vintage_date"), F.lit(0).alias("retrieved_at"), F.lit("v").alias("vintage_id"), F.col("id").cast("decimal(18,2)").alias("value"), F.lit(1).alias("arrival_order"))
    store = versions.write_bucketed(rows, "bucketed_store", f"file://{tmp_path}/store", 4)
    serving = versions.write_bucketed(strategies.resolve_cells(rows).withColumn("recomputed_at_arrival", F.lit(1).cast("long")), "bucketed_serving", f"file://{tmp_path}/serving", 4)
    try:
        arrived = rows.where("vintage_date < 40")
        after = strategies.incremental_serving(serving, store, arrived, 2)
        assert after.where("recomputed_at_arrival = 2").count() == 40 and after.count() == 5000
        text = _plan(after)
        for exchange in [line for line in text.splitlines() if "Exchange hashpartitioning" in line]:
            assert "cell_id" in exchange  # of the arrival, which is distinct by cell
        assert text.count("Exchange hashpartitioning") <= 2  # the arrival on either side; store and serving state have none
        assert "Bucketed: true" in after._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("bucketed_store", "bucketed_serving"):
            spark.sql(f"DROP TABLE {name}")


def test_dirty_cells_filter_the_stores_scan(spark, tmp_path):
    spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("cell_id"), "id").write.parquet(f"file://{tmp_path}/store")
    spark.range(100).select(F.sha2((F.col("id") * 7).cast("string"), 256).alias("cell_id"), "id").write.parquet(f"file://{tmp_path}/dirty")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the cells are too many to broadcast
    try:
        found = versions.reached_rows(spark.read.parquet(f"file://{tmp_path}/store"), spark.read.parquet(f"file://{tmp_path}/dirty").where("id >= 0"))
        assert found.count() == 100 and "might_contain" in _plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_constraints_read_the_fact_once(spark, fact, tmp_path):
    fact.write.parquet(f"file://{tmp_path}/fact")
    stored = spark.read.parquet(f"file://{tmp_path}/fact")
    releases = stored.select("vintage_id").distinct().where("vintage_id <> 'v-c'")
    bad = stored.withColumn("value_lexeme", F.when(F.col("cell_id") == "cell00", "?").otherwise(F.col("value_lexeme")))
    found = model.fact_constraints(bad, spark.createDataFrame(releases.collect(), "vintage_id string"), (2, 3))
    assert dict(found.collect()) == {"release_exists": 10, "lexeme_is_value": 3, "unique_observation": 0, "unique_cell_vintage_record": 0, "vintages_per_cell": 0, "one_cell_per_trace": 0}
    assert _plan(found).count("Scan parquet") == 1
    assert {r.violations for r in model.fact_constraints(stored.limit(0), releases, (2, 3)).collect()} == {0}
    seen = model.write_checked(bad, releases, f"file://{tmp_path}/checked")
    assert seen == {"rows": 38, "release_exists": 10, "lexeme_is_value": 3} and spark.read.parquet(f"file://{tmp_path}/checked").count() == 38


@pytest.mark.parametrize("few", [10_000, 5])
def test_medians_of_large_groups(spark, monkeypatch, few):
    import random
    import statistics

    from revisor.operators import medians

    monkeypatch.setattr(medians, "FEW", few)
    monkeypatch.setattr(medians, "BINS", 8)
    rng = random.Random(6)
    groups = {"even": [rng.gauss(0, 1) for _ in range(200)], "odd": [rng.random() for _ in range(201)], "ties": [1.0] * 90 + [2.0] * 90, "far": [0.0] * 50 + [1e12] * 50, "skew": [2.0**-k for k in range(60)], "one": [4.0], "two": [1.0, 2.0], "same": [3.0] * 40}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("odd", None), ("none", None)]
    got = medians.exact_median(spark.createDataFrame(rows, "g string, x double"), ["g"], "x")
    assert dict(got.collect()) == {g: statistics.median(own) for g, own in groups.items()}


def test_rows_that_repeat_in_an_arrival_are_refused(spark, fact):
    arrived = fact.where("arrival_order = 3")
    twice = arrived.unionByName(arrived.withColumn("observation_id", F.concat("observation_id", F.lit("x"))))
    taken = strategies.vintage_store(fact.where("arrival_order < 3"), twice)
    assert _rows(taken, "observation_id") == [(f"c{k:02d}",) for k in range(10)] and taken.columns == twice.columns
    refused = strategies.admitted(fact.where("arrival_order = 3 AND cell_id < 'cell05'"), twice).groupBy("refused").count().fillna("")
    assert _rows(refused, "refused", "count") == [("", 5), ("in_store", 10), ("repeated", 5)]


def test_sources_without_a_release_show(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, x int")
    known = spark.createDataFrame([("a", "v-a")], "source_id string, vintage_id string")
    assert _rows(model.with_releases(rows, known).fillna(""), "source_id", "problem") == [("a", ""), ("b", "unknown_release")]


def test_small_tables_alone_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(files, "MOST_ROWS", 5)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(files.small(spark.range(5))) and not hinted(files.small(spark.range(6)))


def test_modal_precision(spark):
    rows = spark.createDataFrame([("c", t) for t in ("0,12", "0,13", "0,121", "…", None)], "col string, token string")
    assert _rows(files.modal_precision_split(rows, "col", "token").fillna(""), "value", "note") == [("", "not_published"), ("", "not_published"), ("0.12", ""), ("0.12", "footnote_1"), ("0.13", "")]


def test_packed_series_problems(spark):
    rows = spark.createDataFrame([("k", "2018:9.00|2018:9.10|2019:x")], "k string, packed string")
    assert _rows(files.unpack_series(rows, "packed").fillna(""), "year", "problem") == [("2018", "duplicate_year"), ("2018", "duplicate_year"), ("2019", "not_numeric")]


# ------------------------------------------------------------------ stream of releases


def _stream(spark, schema, folder, log, progress):
    from revisor.streaming.arrivals import stream_arrivals

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream_arrivals(source, log, progress)
    query.awaitTermination()
    return query


def test_a_stream_of_releases(spark, fact, tmp_path):
    """Late, replayed and new releases one after another: the log serves what a full resolution gives."""
    from revisor.streaming import arrivals

    folder, log, progress = (f"file://{tmp_path}/{n}" for n in ("in", "log", "progress"))
    columns = ["cell_id", "observation_id", "vintage_count", "value_revision_count"]
    put = lambda order: fact.where(F.col("arrival_order") == order).coalesce(1).write.mode("append").parquet(folder)
    put(3)
    put(1)  # late: the third release is served already
    _stream(spark, fact.schema, folder, log, progress)
    served = arrivals.serving(spark.read.parquet(log))
    some = strategies.resolve_cells(fact.where("arrival_order <> 2"))
    assert strategies.symmetric_difference(served.select(columns), some.select(columns)).count() == 0
    put(3)  # a replay
    replay = _stream(spark, fact.schema, folder, log, progress)
    assert replay.lastProgress["numInputRows"] == 10 and sum(o["numRowsUpdated"] for o in replay.lastProgress["stateOperators"]) == 0
    assert strategies.symmetric_difference(arrivals.serving(spark.read.parquet(log)).select(columns), some.select(columns)).count() == 0
    put(2)
    _stream(spark, fact.schema, folder, log, progress)
    served = arrivals.serving(spark.read.parquet(log))
    assert strategies.symmetric_difference(served.select(columns), strategies.resolve_cells(fact).select(columns)).count() == 0
    folded = arrivals.fold(spark, log, f"file://{tmp_path}/folded")
    assert folded.count() == 14 and strategies.symmetric_difference(folded.select(columns), served.select(columns)).count() == 0


def test_a_batch_costs_what_it_touches(spark, tmp_path):
    """600 cells of a store of 20,000: state and log are written for 600."""
    schema = "cell_id string, vintage_id string, observation_id string, value decimal(18,2), value_lexeme string, vintage_date date, retrieved_at timestamp"
    folder, log, progress = (f"file://{tmp_path}/{n}" for n in ("in", "log", "progress"))

    def put(n, vintage, day):
        rows = spark.range(n).selectExpr("sha2(cast(id as string), 256) cell_id", f"'{vintage}' vintage_id", f"concat('{vintage}', id) observation_id", "cast(id as decimal(18,2)) value", "cast(id as string) value_lexeme", f"date'{day}' vintage_date", f"timestamp'{day} 01:00:00' retrieved_at")
        rows.coalesce(1).write.mode("append").parquet(folder)

    put(20_000, "a", "2024-01-01")
    _stream(spark, schema, folder, log, progress)
    put(600, "b", "2024-02-01")
    second = _stream(spark, schema, folder, log, progress)
    assert [o["numRowsUpdated"] for o in second.lastProgress["stateOperators"]] == [600, 600]
    by = {r.batch: r.n for r in spark.read.parquet(log).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert by == {0: 20_000, 1: 600}


# ------------------------------------------------------------------ coverage


def _listed(spark, entries):
    rows = [("v", r, d, str(code), str(label)) for r, d, values in entries for code, label in values]
    return spark.createDataFrame(rows, "variable string, response int, dimension string, code string, label string")


def test_profile_counts_listed_cells_years_and_missing_values(spark):
    from revisor.operators import coverage

    listed = _listed(spark, [(0, "unit", [(1100, "A"), (9999, "B")]), (0, "category", [(2001, "SD"), (2002, "SMP")]), (0, "year", [(123, "2023"), (125, "2025")]), (0, "period", [(0, "Tahun")])])
    cells = spark.createDataFrame([("v", "2026-01-02"), ("v", "2026-01-01")], "variable string, updated string")
    r = coverage.profile_variable(cells, listed, ["variable"]).first()
    assert (r.levels, r.years, r.year_gaps, r.observed_cells, r.expected_cells, r.density, r.last_update) == (["national", "province"], [2023, 2025], [2024], 2, 8, 0.25, "2026-01-02")
    assert (r.national_units, r.province_units, r.regency_units) == (1, 1, 0)


def test_units_that_are_no_areas_are_a_breakdown_of_the_nation(spark):
    from revisor.operators import coverage

    listed = _listed(spark, [(0, "unit", [(1, "SD"), (2, "SMP")]), (0, "year", [(115, "2015")]), (0, "period", [(0, "Tahun")]), (0, "unit_name", [("", "School level")])])
    r = coverage.profile_variable(spark.createDataFrame([("v", "x")], "variable string, updated string"), listed, ["variable"]).first()
    assert (r.levels, r.breakdowns, r.national_units, r.expected_cells) == (["national"], ["School level"], 1, 2)
    none = _listed(spark, [(0, "year", [(1, "no year")])])
    r = coverage.profile_variable(spark.createDataFrame([], "variable string, updated string"), none, ["variable"]).first()
    assert (r.levels, r.years, r.year_gaps, r.observed_cells, r.expected_cells, r.density) == ([], [], [], 0, 0, None)


def test_status_follows_evidence_and_levels(spark):
    from revisor.operators import coverage

    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (2, 0), (0, 0)], "missing int, evidence int")
    assert [r[0] for r in rows.select(coverage.derive_status(F.col("missing"), F.col("evidence"))).collect()] == ["verified", "partial", "partial", "unavailable", "unavailable"]


def test_gaps_close_by_any_interval(spark):
    from revisor.operators import coverage

    gaps = spark.createDataFrame([("a", y) for y in (2001, 2002, 2005, 2009)] + [("b", 2000), ("b", 2000)], "k string, year int")
    intervals = spark.createDataFrame([("a", 1999, 2010 - 9), ("a", 2001, 2001), ("a", 1990, 1991), ("a", 2004, 2006), ("a", 2005, 2005), ("b", 2001, 2003), ("c", 1, 2)], "k string, first_year int, last_year int")
    assert _rows(coverage.open_gaps(gaps, intervals, "k"), "k", "year") == [("a", 2002), ("a", 2009), ("b", 2000)]


# ------------------------------------------------------------------ best titles


@pytest.mark.parametrize("n_words, titles, hot", [(6, 40, 50_000), (40, 300, 20)])
def test_best_titles_are_those_of_all_pairs(spark, monkeypatch, n_words, titles, hot):
    import random
    from difflib import SequenceMatcher

    from revisor.operators import lexical

    monkeypatch.setattr(lexical, "HOT", hot)
    rng = random.Random(3)
    words = ["dan", "yang"] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n_words)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    queries, titles = [(i, text()) for i in range(12)], [(i, text()) for i in range(titles)]
    queries += [(100, "dan"), (101, ""), (102, None), (103, "zzzz of no title"), (104, "yang dan")]
    titles += [(1000, ""), (1001, None), (1002, "x"), (1003, titles[0][1]), (1004, titles[0][1].upper() + " !")]
    want = []
    for q, query in queries:
        query = query or ""
        own = set(query.split()) - set(lexical.STOPWORDS)
        scored = []
        for t, title in titles:
            bare = (title or "").lower().replace("!", "").strip()
            share = len(own & set(bare.split())) / max(1, len(own))
            scored.append((-round(lexical.COVERAGE * share + lexical.SEQUENCE * SequenceMatcher(None, query, bare).ratio(), 4), t))
        want += [(q, t, n) for n, (_, t) in enumerate(sorted(scored)[:3], 1)]
    got = lexical.lexical_candidates(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(titles, "title_id int, title string"), 3)
    assert _rows(got, "query_id", "title_id", "place") == sorted(want)


def test_few_pairs_are_looked_at(spark):
    """Queries that a title answers well reach it by their rare words: the pairs are far fewer than all."""
    import random

    from revisor.operators import lexical

    rng = random.Random(8)
    rare = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)]
    titles = [(i, " ".join(["common", "frequent", *rng.sample(rare, 4)])) for i in range(2000)]
    queries = [(i, titles[i * 7][1]) for i in range(40)]
    q = lexical._prepared(spark.createDataFrame(queries, "query_id int, query string"), "query_id", "query", lexical.STOPWORDS)
    t = lexical._prepared(spark.createDataFrame(titles, "title_id int, title string"), "title_id", "title", lexical.STOPWORDS)
    assert lexical.candidate_pairs(q, t, 1).count() < 0.02 * 40 * 2000
    best = lexical.lexical_candidates(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(titles, "title_id int, title string"), 1)
    assert _rows(best, "query_id", "title_id", "score") == [(i, i * 7, 1.0) for i in range(40)]


def test_no_titles(spark):
    from revisor.operators import lexical

    some, none = spark.createDataFrame([(1, "a b")], "query_id int, query string"), spark.createDataFrame([], "title_id int, title string")
    assert lexical.lexical_candidates(some, none, 3).count() == 0
    assert lexical.lexical_candidates(some.limit(0), none, 3).count() == 0


# ------------------------------------------------------------------ reachability


def test_reachable_in_cycles_and_at_any_depth(spark):
    from revisor.operators import reach

    edges = [(f"n{i}", "next", f"n{i + 1}") for i in range(9)] + [("n3", "back", "n1"), ("a", "one", "b"), ("b", "two", "a"), ("b", "three", "b"), ("a", "also", "b")]
    edges = spark.createDataFrame(edges, "from_id string, relationship string, to_id string")
    starts = spark.createDataFrame([("n0",), ("n8",), ("a",), ("nowhere",), ("n8",)], "start string")
    got = {(r.start, r.node): (r.hops, r.via) for r in reach.reachable(edges, starts).collect()}
    assert {n for s, n in got if s == "n0"} == {f"n{i}" for i in range(10)} and got["n0", "n9"] == (9, "next") and got["n0", "n1"] == (1, "next")
    assert {n for s, n in got if s == "a"} == {"a", "b"} and got["a", "b"] == (1, "also")
    assert {n for s, n in got if s == "nowhere"} == {"nowhere"} and len(got) == 10 + 2 + 2 + 1


def test_broken_hops_of_the_evidence_show(spark, fact):
    from revisor.operators import reach

    g = fact.withColumn("manifest_sha256", F.sha2("source_id", 256))
    audit = g.select(F.lit("B0").alias("strategy"), F.concat(F.lit("r-"), "observation_id").alias("request_id"), "observation_id")
    audit = audit.unionByName(audit.withColumn("strategy", F.lit("B3")))
    metrics = audit.groupBy("strategy").agg(F.count("*").alias("requests"))
    edges = reach.evidence_edges(audit, metrics).unionByName(lineage.lineage_edges(g, LINEAGE).select("from_id", "relationship", "to_id"))
    assert {r.complete for r in reach.evidence_closure(audit, edges).collect()} == {True}
    complete = lambda e: reach.evidence_closure(audit, e).where("complete").count()
    assert complete(edges.where("relationship <> 'table_supplies_figure_input'")) == 0
    assert complete(edges.where("relationship <> 'record_sources_observation' OR to_id NOT LIKE 'a0%'")) == 2 * 38 - 2 * 10
    one = edges.where("relationship = 'metric_published_in_table'").first()
    assert complete(edges.where(F.col("from_id") != one.from_id)) == 38


def test_impact_audit_finds_what_was_missed(fact):
    g = fact.withColumn("manifest_sha256", F.sha2("source_id", 256))
    edges = lineage.lineage_edges(g, LINEAGE)
    catalog = strategies.arrival_catalog(g)
    current = g.groupBy("cell_id").agg(F.max("arrival_order").alias("recomputed_at_arrival"))
    agrees = lambda *a: {r.arrival_order: r.agrees for r in lineage.impact_audit(g, *a).collect()}
    assert agrees(edges, catalog, current) == {1: True, 2: True, 3: True}
    stale = current.withColumn("recomputed_at_arrival", F.when(F.col("cell_id") == "cell00", 1).otherwise(F.col("recomputed_at_arrival")))
    assert agrees(edges, catalog, stale) == {1: True, 2: True, 3: False}
    under = catalog.withColumn("dirty_cells", F.when(F.col("arrival_order") == 3, 9).otherwise(F.col("dirty_cells")))
    assert agrees(edges, under, current) == {1: True, 2: True, 3: False}
    assert agrees(edges.where("from_id <> 'b03'"), catalog, current)[2] is False


# ------------------------------------------------------------------ digest trees


def _scanned(df):
    """Rows that the file scans of a plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, rows = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.finalPhysicalPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name.startswith("Scan parquet"):
                rows += node.metrics().get("numOutputRows").get().value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return rows


def _state(spark, n, changed=()):
    when = F.when(F.col("id").isin(*changed), "new").otherwise("old") if changed else F.lit("old")
    return spark.range(n).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20).alias("cell_id"), F.concat(when, F.col("id").cast("string")).alias("observation_id"))


def test_states_are_compared_from_the_root(spark, tmp_path):
    from revisor.operators import states

    one, two = (f"file://{tmp_path}/{n}" for n in ("one", "two"))
    a, b = _state(spark, 60_000), _state(spark, 60_003, changed=(5, 70, 900)).where("observation_id <> 'old77'")
    states.store_state(a, one, 1 << 16)
    states.store_state(b, two, 1 << 16)
    got = states.compare_states(spark, one, two, ["observation_id"], leaf_rows=200)
    want = a.join(b, "cell_id", "full_outer").where(~a.observation_id.eqNullSafe(b.observation_id)).count()
    assert want == 7 and _rows(got.groupBy("status").count(), "status", "count") == [("changed", 3), ("only_one", 1), ("only_two", 3)]
    assert _scanned(got) < 0.7 * 120_000  # row groups without a differing range are not read
    assert states.compare_states(spark, one, one, ["observation_id"]).count() == 0


def test_digest_does_not_depend_on_partitions(spark):
    from revisor.operators import states

    a = _state(spark, 3000).withColumn("k", F.lit(1))
    digest = lambda df, n=50: [tuple(r) for r in states.state_digest(df, ["k"], ["cell_id", "observation_id"], n).collect()]
    assert digest(a) == digest(a.orderBy("observation_id").repartition(7)) and digest(a)[0][1] == 3000
    assert digest(a) != digest(a.where("observation_id <> 'old8'")) and digest(a.where("k = 2")) == []
    leaves = states.digest_tree(a, ["k"], ["cell_id", "observation_id"], states.depth_of(a, ["k"], 50))
    assert leaves.orderBy(F.col("level").desc(), F.col("state_rows").desc()).first().state_rows <= 200
