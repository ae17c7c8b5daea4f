"""Queries that do their whole job, and plans whose work grows no faster than the input."""

from datetime import date

from pyspark.sql import functions as F

import __spark_entry__ as entry
from revisor.sources import versions

DIR = "/root/testdata/sf0.001"


def test_snapshot_read_covers_every_release(spark):
    got = {r.version: r.n for r in entry.queries()["snapshot_read"](spark, DIR).groupBy("version").agg(F.count("*").alias("n")).collect()}
    every = {r.version: r.n for r in entry.queries()["snapshot_union"](spark, DIR).groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got == every


def test_versions_as_of_several_dates(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    versions.write_versions(spark.range(3000).select("id", (F.col("id") % 3 + 1).alias("version")), path)
    releases = spark.createDataFrame([(date(2024, k, 1), k) for k in (1, 2, 3)], "vintage_date date, version long")
    asked = spark.createDataFrame([(date(2023, 12, 31),), (date(2024, 1, 1),), (date(2024, 1, 20),), (date(2024, 3, 9),)], "when date")
    got = versions.versions_asof(spark, path, releases, asked).groupBy("when").agg(F.count("*"), F.min("version"), F.max("version"))
    assert sorted(map(tuple, got.collect())) == [(date(2024, 1, 1), 1000, 1, 1), (date(2024, 1, 20), 1000, 1, 1), (date(2024, 3, 9), 1000, 3, 3)]


def test_closure_reaches_from_nodes_not_from_decisions(spark, monkeypatch):
    """What lies behind a metric or an artifact is found once for it; before, a frontier of every decision was moved."""
    from revisor.operators import reach

    audit = spark.createDataFrame([(s, f"r-{i}", f"o{i}") for s in ("B0", "B3") for i in range(40)], "strategy string, request_id string, observation_id string")
    edges = reach.evidence_edges(audit, audit.groupBy("strategy").agg(F.count("*").alias("requests")))
    core = [("m", "manifest_declares_artifact", "a"), ("n", "manifest_declares_artifact", "a"), ("z", "manifest_declares_artifact", "b")]
    core += [(a, "artifact_contains_record", f"rec{i}") for i in range(20) for a in ("a", "b")] + [(f"rec{i % 20}", "record_sources_observation", f"o{i}") for i in range(30)]
    edges = edges.unionByName(spark.createDataFrame(core, edges.schema))
    starts, plain = [], reach.reachable
    monkeypatch.setattr(reach, "reachable", lambda e, s: starts.append(s.distinct().count()) or plain(e, s))
    got = reach.evidence_closure(audit, edges).collect()
    assert len(got) == 80 and sum(starts) == 2 + 2
    assert {(r.record_id, r.artifact_id, r.manifest_id, r.complete) for r in got if r.request_id == "r-29"} == {("rec9", "b", "z", True)}
    assert {(r.observation_id, r.record_id, r.figure_id is not None, r.complete) for r in got if r.request_id == "r-33"} == {("o33", None, True, False)}


def test_rows_of_a_column_do_not_meet_in_one_task(spark):
    """The modal precision of few columns is broadcast whatever the size that Spark guesses."""
    from revisor.sources import files

    rows = spark.range(2000).select("id", (F.col("id") % 2).cast("string").alias("col"), F.concat("id", F.lit(",25")).alias("token"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if both sides were large
    try:
        out = files.modal_precision_split(rows, "col", "token")
        assert out.count() == 2000 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)



def test_audit_joins_a_request_once(spark):
    """Requests are joined with all strategies at once, not once for each; the names found are those given."""
    from revisor.operators import recall

    facts = spark.range(60).select(F.concat(F.lit("o"), "id").alias("observation_id"), F.concat(F.lit("c"), F.col("id") % 20).alias("cell_id"), (F.col("id") % 4).cast("decimal(18,2)").alias("value"), (F.col("id") % 4).cast("string").alias("value_lexeme"))
    last = facts.where("substr(observation_id, 2) >= 40").select("cell_id", "observation_id")
    held = last.select(F.lit("X").alias("strategy"), "*", F.lit(False).alias("historical"))
    held = held.unionByName(facts.select(F.lit("Y").alias("strategy"), "cell_id", "observation_id", (F.substring("observation_id", 2, 9).cast("int") < 40).alias("historical")))
    asked = facts.withColumn("request_id", F.concat(F.lit("r-"), "observation_id"))
    got, given = recall.recall_audit(asked, held, facts), recall.recall_audit(asked, held, facts, ["X", "Y"])
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, given.collect())) and len(rows) == 120
    found = {(r[0], r[2], r[5], r[6]): 0 for r in rows}
    assert set(found) == {("X", "serving", True, "none"), ("X", "unavailable", True, "duplicate_value"), ("Y", "serving", True, "none"), ("Y", "historical", True, "none")}


def test_queries_build_the_fact_once(spark, monkeypatch):
    """failure_synthesis, cost_of_recall and derived_vs_measured derive the fact once; before, up to three and seven times."""
    from revisor.plans import graph_queries, vintage_queries

    made = []
    for module in (graph_queries, vintage_queries):
        plain = module.fact
        monkeypatch.setattr(module, "fact", lambda *a, plain=plain: made.append(1) or plain(*a))
    for name in ("failure_synthesis", "cost_of_recall", "derived_vs_measured"):
        made.clear()
        entry.queries()[name](spark, DIR)
        assert len(made) == 1, name


def test_a_title_that_repeats_is_scored_once(spark, monkeypatch):
    """Copies of a title are found by their text; before, each was a pair to score."""
    from revisor.operators import lexical

    titles = [(i, f"word{i % 5} other{i % 5}" + "!" * (i % 2)) for i in range(200)]
    queries = spark.createDataFrame([(1, "word3 other3"), (2, "word4")], "query_id int, query string")
    seen, plain = [], lexical.candidate_pairs
    monkeypatch.setattr(lexical, "candidate_pairs", lambda q, t, k: seen.append(t.count()) or plain(q, t, k))
    got = lexical.lexical_candidates(queries, spark.createDataFrame(titles, "title_id int, title string"), 3)
    assert sorted((r.query_id, r.place, r.title_id) for r in got.collect()) == [(1, 1, 3), (1, 2, 8), (1, 3, 13), (2, 1, 4), (2, 2, 9), (2, 3, 14)]
    assert seen == [5]
