"""Queries over releases, strategies and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from revisor.operators import model, recall, states, strategies
from revisor.plans.bridge import AUTHORITY, RELEASES, fact, released, releases, sql
from revisor.plans.registry import query
from revisor.sources import files
from revisor.sources.files import scratch

LAST = len(RELEASES)


def _stored(spark, d):
    """The fact as a written table, for queries that read it many times."""
    path = scratch(spark, "fact")
    fact(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def _scores_of(rows):
    return strategies.trust_scores(rows, releases(rows.sparkSession), AUTHORITY)


def _scores(spark, d):
    return _scores_of(fact(spark, d))


def _requests_of(rows):
    return rows.withColumn("request_id", F.concat(F.lit("r-"), "observation_id"))


def _requests(spark, d):
    return _requests_of(fact(spark, d))


@query("release_dimension", sql("SELECT vintage_id, min(source_id) AS source_id, CAST(min(vintage_date) AS VARCHAR) AS vintage_date, count(DISTINCT (source_id, vintage_date)) - 1 AS conflicts FROM fact GROUP BY 1", "fact"))
def release_dimension(spark, d):
    out = model.release_dimension(fact(spark, d), ["source_id", "vintage_date"])
    return out.withColumn("vintage_date", F.col("vintage_date").cast("string"))


@query("observation_fact", sql("SELECT observation_id, cell_id, vintage_id, source_id, domain, observed_period, geo_code, CAST(value AS DOUBLE) AS value, value_lexeme, CAST(places AS BIGINT) AS places, CAST(arrival_order AS BIGINT) AS arrival_order FROM fact", "fact"))
def observation_fact(spark, d):
    return fact(spark, d).select(
        "observation_id", "cell_id", "vintage_id", "source_id", "domain", "observed_period", "geo_code", F.col("value").cast("double").alias("value"), "value_lexeme",
        F.col("places").cast("long").alias("places"), F.col("arrival_order").cast("long").alias("arrival_order"),
    )


#: The fact with rows that break each constraint, chosen by the area's code.
_BROKEN = """broken AS (SELECT observation_id, cell_id, vintage_id, source_id, source_record_id, value_lexeme, value FROM fact UNION ALL
    SELECT observation_id, cell_id, CASE CAST(geo_code AS BIGINT) % 50 WHEN 1 THEN 'gone' ELSE vintage_id END, source_id, CASE CAST(geo_code AS BIGINT) % 50 WHEN 3 THEN 'same' ELSE source_record_id END, value_lexeme,
           CASE CAST(geo_code AS BIGINT) % 50 WHEN 2 THEN value + 1 ELSE value END FROM fact WHERE CAST(geo_code AS BIGINT) % 50 < 4)"""
_RULES = """SELECT 'unique_observation' AS rule, count(*) AS violations FROM (SELECT observation_id FROM broken GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'unique_cell_vintage_record', count(*) FROM (SELECT 1 FROM broken GROUP BY cell_id, vintage_id, source_record_id HAVING count(*) > 1)
    UNION ALL SELECT 'release_exists', count(*) FROM broken WHERE vintage_id NOT IN (SELECT vintage_id FROM releases)
    UNION ALL SELECT 'lexeme_is_value', count(*) FROM broken WHERE TRY_CAST(value_lexeme AS DECIMAL(38,10)) IS DISTINCT FROM CAST(value AS DECIMAL(38,10))
    UNION ALL SELECT 'vintages_per_cell', count(*) FROM (SELECT cell_id FROM broken GROUP BY 1 HAVING count(DISTINCT vintage_id) NOT BETWEEN 1 AND 2)
    UNION ALL SELECT 'one_cell_per_trace', count(*) FROM (SELECT 1 FROM broken GROUP BY source_id, source_record_id HAVING count(DISTINCT cell_id) > 1)"""


def _broken(spark, d):
    rows, k = fact(spark, d), F.col("geo_code").cast("long") % 50
    c = ["observation_id", "cell_id", "vintage_id", "source_id", "source_record_id", "value_lexeme", "value"]
    planted = rows.where(k < 4).withColumns({
        "vintage_id": F.when(k == 1, "gone").otherwise(F.col("vintage_id")),
        "source_record_id": F.when(k == 3, "same").otherwise(F.col("source_record_id")),
        "value": F.when(k == 2, (F.col("value") + 1).cast("decimal(18,2)")).otherwise(F.col("value")),
    })
    return rows.select(c).unionByName(planted.select(c))


def _constraints(spark, d):
    return model.fact_constraints(_broken(spark, d), releases(spark), vintages=(1, 2))


@query("fact_constraints", sql(f"WITH {_BROKEN} {_RULES}", "fact"))
def fact_constraints(spark, d):
    """Constraints of the fact and planted rows; a cell may have two vintages, so those with more show as well."""
    return _constraints(spark, d)


@query("arrival_order", sql("SELECT source_id, dense_rank() OVER (ORDER BY vintage_date, retrieved_at, vintage_id) AS arrival_order FROM (SELECT DISTINCT source_id, vintage_date, retrieved_at, vintage_id FROM fact)", "fact"))
def arrival_order(spark, d):
    rows = fact(spark, d).select("source_id", "vintage_date", "retrieved_at", "vintage_id").distinct()
    return model.arrival_order(rows).select("source_id", "arrival_order")


#: Each row twice, the second with a later locator, an earlier retrieval in some areas, and another value or unit in some.
_PANEL = """panel AS (SELECT cell_id, source_id, observation_id, source_record_id, retrieved_at, value, value_lexeme, unit FROM fact
    UNION ALL SELECT cell_id, source_id, observation_id || 'x', source_record_id || 'x', CASE CAST(geo_code AS BIGINT) % 4 WHEN 1 THEN retrieved_at + INTERVAL 1 HOUR ELSE retrieved_at END, CASE CAST(geo_code AS BIGINT) % 7 WHEN 2 THEN value + 1 ELSE value END,
        value_lexeme, CASE CAST(geo_code AS BIGINT) % 11 WHEN 3 THEN 'other' ELSE unit END FROM fact)"""


@query("dedup_panel", sql(f"""WITH {_PANEL}, p AS (SELECT *, row_number() OVER w AS place, first_value(observation_id) OVER w AS kept_observation_id, first_value(value) OVER w AS v, first_value(unit) OVER w AS u FROM panel WINDOW w AS (PARTITION BY cell_id, source_id ORDER BY retrieved_at DESC, source_record_id))
    SELECT cell_id, source_id, source_record_id, place = 1 AS kept, kept_observation_id, value <> v OR unit <> u AS conflict FROM p""", "fact"))  # fmt: skip
def dedup_panel(spark, d):
    rows, k = fact(spark, d), F.col("geo_code").cast("long")
    more = {
        "observation_id": F.concat("observation_id", F.lit("x")),
        "source_record_id": F.concat("source_record_id", F.lit("x")),
        "retrieved_at": F.when(k % 4 == 1, F.col("retrieved_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("retrieved_at")),
        "value": F.when(k % 7 == 2, (F.col("value") + 1).cast("decimal(18,2)")).otherwise(F.col("value")),
        "unit": F.when(k % 11 == 3, "other").otherwise(F.col("unit")),
    }
    return model.dedup_panel(rows.unionByName(rows.withColumns(more))).select("cell_id", "source_id", "source_record_id", "kept", "kept_observation_id", "conflict")


@query("latest_by_cell", sql("SELECT cell_id, observation_id, value_lexeme, source_id FROM current", "current"))
def latest_by_cell(spark, d):
    return model.latest_by_cell(fact(spark, d), ["observation_id", "value_lexeme", "source_id"])


@query("overwrite_state", sql("SELECT cell_id, observation_id, value_lexeme, CAST(arrival_order AS BIGINT) AS applied_order, prev_observation_id AS replaced_observation_id FROM current", "current"))
def overwrite_state(spark, d):
    return strategies.overwrite_state(fact(spark, d)).select("cell_id", "observation_id", "value_lexeme", F.col("applied_order").cast("long").alias("applied_order"), "replaced_observation_id")


_OPS = """SELECT CAST(arrival_order AS BIGINT) AS arrival_order, count(*) AS input_rows, count(*) FILTER (prev_observation_id IS NULL) AS inserted,
    count(*) FILTER (prev_observation_id IS NOT NULL) AS overwritten, count(*) FILTER (prev_value <> value) AS value_changed, count(*) FILTER (prev_value = value) AS same_value FROM hist GROUP BY 1"""


@query("overwrite_operations", sql(f"WITH o AS ({_OPS}) SELECT *, CAST(sum(inserted) OVER (ORDER BY arrival_order) AS BIGINT) AS state_rows FROM o", "hist"))
def overwrite_operations(spark, d):
    return strategies.overwrite_operations(fact(spark, d)).withColumn("arrival_order", F.col("arrival_order").cast("long"))


@query("full_snapshots", sql("SELECT CAST(snapshot_order AS BIGINT) AS snapshot_order, cell_id, observation_id FROM states", "states"))
def full_snapshots(spark, d):
    return strategies.full_snapshots(fact(spark, d), LAST).select(F.col("snapshot_order").cast("long").alias("snapshot_order"), "cell_id", "observation_id")


#: Rows of a leaf of the digest tree; small, so that the small tables have inner nodes.
LEAF = 64
_DIGEST = f"""mx AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM states GROUP BY snapshot_order)), dp AS (SELECT min(k) AS depth FROM mx, range(12) t(k) WHERE n <= {LEAF} * pow(16, k)),
    tree AS (SELECT snapshot_order, depth AS level, substr(cell_id, 1, depth) AS prefix, count(*)::BIGINT AS n, sha256(string_agg(sha256(concat_ws(chr(31), cell_id, observation_id, value_lexeme)), '' ORDER BY cell_id)) AS d FROM states, dp GROUP BY 1, 2, 3
        UNION ALL SELECT snapshot_order, level - 1, substr(prefix, 1, level - 1), sum(n)::BIGINT, sha256(string_agg(d, '' ORDER BY prefix)) FROM tree WHERE level > 0 GROUP BY 1, 2, 3),
    dg AS (SELECT snapshot_order, n AS state_rows, d AS digest FROM tree WHERE level = 0)"""


@query("snapshot_catalog", sql(f"""WITH RECURSIVE {_DIGEST}, o AS ({_OPS}), s AS (SELECT snapshot_order, count(DISTINCT vintage_id) AS vintages FROM states GROUP BY 1)
    SELECT CAST(snapshot_order AS BIGINT) AS snapshot_order, input_rows, inserted, overwritten, value_changed, same_value, state_rows, vintages,
           digest AS state_digest, substr(sha256(concat_ws(chr(31), 'B1', snapshot_order, digest)), 1, 20) AS snapshot_key
    FROM o JOIN s ON arrival_order = snapshot_order JOIN dg USING (snapshot_order)""", "states"))  # fmt: skip
def snapshot_catalog(spark, d):
    return strategies.snapshot_catalog(fact(spark, d), LAST, LEAF).withColumn("snapshot_order", F.col("snapshot_order").cast("long"))


@query("trust_scores", sql("SELECT source_id, CAST(vintage_date AS VARCHAR) AS vintage_date, trust_score, source_rank FROM scores", "scores"))
def trust_scores(spark, d):
    return _scores(spark, d).withColumn("vintage_date", F.col("vintage_date").cast("string"))


@query("select_single_source", sql("SELECT cell_id, observation_id, source_id, trust_score, candidate_count, candidate_count - 1 AS discarded_candidate_count, selected_is_latest_vintage FROM selected", "selected"))
def select_single_source(spark, d):
    return strategies.select_single_source(fact(spark, d), _scores(spark, d)).select(
        "cell_id", "observation_id", "source_id", "trust_score", "candidate_count", "discarded_candidate_count", "selected_is_latest_vintage"
    )


_RANKED = "r AS (SELECT f.*, trust_score, row_number() OVER (PARTITION BY cell_id ORDER BY trust_score DESC, f.vintage_date DESC, f.source_id, observation_id) AS choice FROM fact f JOIN scores USING (source_id))"


@query("selection_preview", sql(f"""WITH {_RANKED}, b AS (SELECT cell_id, max(observation_id) FILTER (choice = 1) AS selected_id, max(observation_id) FILTER (choice = 2) AS runner_up_id,
        max(value) FILTER (choice = 1) AS v, arg_max(observation_id, arrival_order) AS latest_id, arg_max(value, arrival_order) AS lv FROM r GROUP BY 1)
    SELECT cell_id, selected_id, runner_up_id, latest_id, selected_id = latest_id AS is_latest, v = lv AS value_equals_latest FROM b""", "fact", "scores"))  # fmt: skip
def selection_preview(spark, d):
    return strategies.selection_preview(fact(spark, d), _scores(spark, d))


@query("discarded_candidates", sql(f"""WITH {_RANKED} SELECT a.cell_id, a.observation_id, b.observation_id AS selected_id,
        CASE WHEN a.trust_score < b.trust_score THEN 'lower_trust_score' WHEN a.vintage_date < b.vintage_date THEN 'tie_break_older_vintage'
             WHEN a.source_id > b.source_id THEN 'tie_break_source_id' ELSE 'tie_break_observation_id' END AS reason
    FROM r a JOIN r b ON a.cell_id = b.cell_id AND b.choice = 1 WHERE a.choice > 1""", "fact", "scores"))  # fmt: skip
def discarded_candidates(spark, d):
    return strategies.discarded_candidates(fact(spark, d), _scores(spark, d))


@query("vintage_store", sql("SELECT cell_id, vintage_id, observation_id FROM fact WHERE arrival_order > 2", "fact"))
def vintage_store(spark, d):
    rows = fact(spark, d)
    return strategies.vintage_store(rows.where("arrival_order <= 2"), rows).select("cell_id", "vintage_id", "observation_id")


@query("refused_rows", sql("""WITH a AS (SELECT cell_id, vintage_id, observation_id, arrival_order FROM fact WHERE arrival_order > 1 UNION ALL SELECT cell_id, vintage_id, observation_id || 'x', arrival_order FROM fact WHERE arrival_order > 1 AND cell_id < '4')
    SELECT cell_id, vintage_id, observation_id, CASE WHEN arrival_order <= 2 THEN 'in_store' WHEN observation_id LIKE '%x' THEN 'repeated' END AS refused FROM a""", "fact"))  # fmt: skip
def refused_rows(spark, d):
    """An arrival that replays a release of the store and repeats some of its own rows."""
    rows = fact(spark, d)
    new = rows.where("arrival_order > 1")
    arrived = new.unionByName(new.where("cell_id < '4'").withColumn("observation_id", F.concat("observation_id", F.lit("x"))))
    return strategies.admitted(rows.where("arrival_order <= 2"), arrived).select("cell_id", "vintage_id", "observation_id", "refused")


@query("unknown_releases", sql("""SELECT source_id, count(*) AS observations, count(*) FILTER (source_id IN ('error', 'view')) AS refused, CASE WHEN source_id IN ('error', 'view') THEN 'unknown_release' END AS problem FROM obs GROUP BY 1""", "obs"))
def unknown_releases(spark, d):
    """Observations by source where two of the sources have no release."""
    rows = released(spark, d, releases(spark).where("source_id NOT IN ('error', 'view')"))
    return rows.groupBy("source_id").agg(F.count("*").alias("observations"), F.count("problem").alias("refused"), F.max("problem").alias("problem"))


@query("resolve_cells", sql("""SELECT cell_id, arg_max(observation_id, arrival_order) AS observation_id, arg_max(value_lexeme, arrival_order) AS value_lexeme, count(*) AS vintage_count,
    count(*) FILTER (prev_value <> value) AS value_revision_count FROM hist GROUP BY 1""", "hist"))  # fmt: skip
def resolve_cells(spark, d):
    return strategies.resolve_cells(fact(spark, d)).select("cell_id", "observation_id", "value_lexeme", "vintage_count", "value_revision_count")


@query("incremental_serving", sql("""SELECT cell_id, arg_max(observation_id, arrival_order) AS observation_id, count(*) AS vintage_count, CAST(max(CASE WHEN arrival_order = 5 THEN 5 ELSE 4 END) AS BIGINT) AS recomputed_at_arrival
    FROM fact GROUP BY 1""", "fact"))  # fmt: skip
def incremental_serving(spark, d):
    rows = fact(spark, d)
    before = strategies.resolve_cells(rows.where("arrival_order < 5")).withColumn("recomputed_at_arrival", F.lit(4).cast("long"))
    after = strategies.incremental_serving(before, rows, rows.where("arrival_order = 5"), 5)
    return after.select("cell_id", "observation_id", "vintage_count", "recomputed_at_arrival")


@query("arrival_catalog", sql("""WITH o AS (SELECT CAST(arrival_order AS BIGINT) AS arrival_order, count(*) AS dirty_cells, count(*) FILTER (prev_observation_id IS NULL) AS inserted,
        count(*) FILTER (prev_observation_id IS NOT NULL) AS resolved_changed, count(*) FILTER (prev_value <> value) AS value_changed,
        count(*) FILTER (prev_value = value) AS provenance_only, CAST(0 AS BIGINT) AS unchanged FROM hist GROUP BY 1),
    c AS (SELECT *, CAST(sum(dirty_cells) OVER (ORDER BY arrival_order) AS BIGINT) AS store_rows, CAST(sum(inserted) OVER (ORDER BY arrival_order) AS BIGINT) AS serving_rows FROM o)
    SELECT *, serving_rows - dirty_cells AS untouched FROM c""", "hist"))  # fmt: skip
def arrival_catalog(spark, d):
    return strategies.arrival_catalog(fact(spark, d)).withColumn("arrival_order", F.col("arrival_order").cast("long"))


@query("late_arrivals", sql("""WITH r AS (SELECT *, CASE arrival_order WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE arrival_order END AS arrived FROM fact),
    w AS (SELECT *, lag(arrival_order) OVER o AS before, max(arrival_order) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r WINDOW o AS (PARTITION BY cell_id ORDER BY arrived)),
    x AS (SELECT w.*, t.value AS served FROM w LEFT JOIN fact t ON t.cell_id = w.cell_id AND t.arrival_order = w.top),
    o AS (SELECT CAST(arrived AS BIGINT) AS arrival_order, count(*) AS dirty_cells, count(*) FILTER (before IS NULL) AS inserted, count(*) FILTER (arrival_order > top) AS resolved_changed, count(*) FILTER (arrival_order > top AND value <> served) AS value_changed,
        count(*) FILTER (arrival_order > top AND value = served) AS provenance_only, count(*) FILTER (arrival_order < top) AS unchanged FROM x GROUP BY 1),
    c AS (SELECT *, CAST(sum(dirty_cells) OVER (ORDER BY arrival_order) AS BIGINT) AS store_rows, CAST(sum(inserted) OVER (ORDER BY arrival_order) AS BIGINT) AS serving_rows FROM o)
    SELECT *, serving_rows - dirty_cells AS untouched FROM c""", "fact"))  # fmt: skip
def late_arrivals(spark, d):
    """The catalog where the second release arrives last and the last one second: late rows leave the resolution as it is."""
    order = F.col("arrival_order")
    late = fact(spark, d).withColumn("arrival_order", F.when(order == 2, 5).when(order == 5, 2).otherwise(order))
    return strategies.arrival_catalog(late).withColumn("arrival_order", F.col("arrival_order").cast("long"))


@query("incremental_equals_full", sql("SELECT count(*) AS differing_rows, (SELECT count(DISTINCT cell_id) FROM fact) AS cells FROM fact WHERE false", "fact"))
def incremental_equals_full(spark, d):
    rows = fact(spark, d)
    columns = ["cell_id", "observation_id", "vintage_count", "value_revision_count"]
    before = strategies.resolve_cells(rows.where("arrival_order < 5")).select(columns).withColumn("recomputed_at_arrival", F.lit(4).cast("long"))
    after = strategies.incremental_serving(before, rows, rows.where("arrival_order = 5"), 5).select(columns)
    full = strategies.resolve_cells(rows).select(columns)
    return strategies.symmetric_difference(after, full).agg(F.count("*").alias("differing_rows")).crossJoin(full.agg(F.count("*").alias("cells")))  # one row each


@query("asof_states", sql("SELECT CAST(snapshot_order AS BIGINT) AS bound_order, cell_id, observation_id FROM states", "states"))
def asof_states(spark, d):
    return strategies.asof_states(fact(spark, d), LAST).select(F.col("bound_order").cast("long").alias("bound_order"), "cell_id", "observation_id")


@query("asof_lookup", sql("""SELECT 'r-' || f.observation_id AS request_id, (SELECT h.observation_id FROM hist h WHERE h.cell_id = f.cell_id AND h.vintage_date <= f.vintage_date - 1 ORDER BY h.vintage_date DESC LIMIT 1) AS observation_id FROM fact f""", "fact", "hist"))
def asof_lookup(spark, d):
    rows = fact(spark, d)
    asked = _requests(spark, d).select("request_id", "cell_id", F.date_sub("vintage_date", 1).alias("as_of"))
    return strategies.asof_lookup(asked, rows).select("request_id", "observation_id")


@query("run_all_strategies", sql("""SELECT 'B0' AS strategy, cell_id, observation_id FROM current UNION ALL SELECT 'B1', cell_id, observation_id FROM current
    UNION ALL SELECT 'B2', cell_id, observation_id FROM selected UNION ALL SELECT 'B3', cell_id, observation_id FROM current""", "current", "selected"))  # fmt: skip
def run_all_strategies(spark, d):
    rows = _stored(spark, d)
    return strategies.all_strategies(rows, _scores_of(rows), LAST)


def _snapshots(spark, d):
    return files.written(strategies.full_snapshots(fact(spark, d), LAST).select("snapshot_order", "cell_id", "observation_id", "value_lexeme"), "states")


@query("state_digest", sql(f"WITH RECURSIVE {_DIGEST} SELECT snapshot_order, state_rows, digest FROM dg", "states"))
def state_digest(spark, d):
    return states.state_digest(_snapshots(spark, d), ["snapshot_order"], ["cell_id", "observation_id", "value_lexeme"], LEAF)


@query("digest_tree", sql(f"WITH RECURSIVE {_DIGEST} SELECT snapshot_order, level, prefix, n AS state_rows, d AS digest FROM tree", "states"))
def digest_tree(spark, d):
    rows = _snapshots(spark, d)
    return states.digest_tree(rows, ["snapshot_order"], ["cell_id", "observation_id", "value_lexeme"], states.depth_of(rows, ["snapshot_order"], LEAF))


@query("compare_states", sql("""SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, CASE WHEN b.cell_id IS NULL THEN 'only_one' WHEN a.cell_id IS NULL THEN 'only_two' ELSE 'changed' END AS status
    FROM (SELECT * FROM states WHERE snapshot_order = 4 AND cell_id >= '2') a FULL JOIN (SELECT * FROM states WHERE snapshot_order = 5 AND cell_id < 'e') b ON a.cell_id = b.cell_id
    WHERE (a.observation_id, a.value_lexeme) IS DISTINCT FROM (b.observation_id, b.value_lexeme)""", "states"))  # fmt: skip
def compare_states(spark, d):
    """Two stored states, of which each lacks a range of cells, compared from the roots of their trees."""
    rows, paths = _snapshots(spark, d), [files.scratch(spark, "state") for _ in range(2)]
    for order, where, path in ((4, "cell_id >= '2'", paths[0]), (5, "cell_id < 'e'", paths[1])):
        states.store_state(rows.where(F.col("snapshot_order") == order).where(where).drop("snapshot_order"), path)
    return states.compare_states(spark, *paths, ["observation_id", "value_lexeme"], LEAF)


@query("late_release_noop", sql("SELECT cell_id, observation_id FROM current", "current"))
def late_release_noop(spark, d):
    """Releases that arrive in reverse: the resolution is by knowledge, so it is the same."""
    late = fact(spark, d).withColumn("arrival_order", F.lit(LAST + 1) - F.col("arrival_order"))
    return strategies.resolve_cells(late).select("cell_id", "observation_id")


# ---------------------------------------------------------------- recall


@query("recall_current", sql("""SELECT strategy, 'r-' || f.observation_id AS request_id, s.observation_id AS served_id, s.observation_id = f.observation_id AS available,
        CASE WHEN s.observation_id = f.observation_id THEN 'exact' WHEN s.value_lexeme = f.value_lexeme THEN 'same_value_other_vintage' ELSE 'lost' END AS result
    FROM fact f JOIN (SELECT 'B0' AS strategy, cell_id, observation_id, value_lexeme FROM current UNION ALL SELECT 'B2', cell_id, observation_id, value_lexeme FROM selected) s USING (cell_id)""", "fact", "current", "selected"))  # fmt: skip
def recall_current(spark, d):
    rows = _stored(spark, d)
    asked = _requests_of(rows)
    columns = ["request_id", "served_id", "available", "result"]
    b0 = recall.recall_current(asked, strategies.overwrite_state(rows)).select(F.lit("B0").alias("strategy"), *columns)
    b2 = recall.recall_current(asked, strategies.select_single_source(rows, _scores_of(rows))).select(F.lit("B2").alias("strategy"), *columns)
    return b0.unionByName(b2)


@query("recall_snapshots", sql("""SELECT 'r-' || observation_id AS request_id, true AS available, CAST(min(snapshot_order) AS BIGINT) AS first_order, CAST(max(snapshot_order) AS BIGINT) AS last_order,
    string_agg(CAST(snapshot_order AS VARCHAR), ',' ORDER BY snapshot_order) AS matching_orders FROM states GROUP BY observation_id""", "states"))  # fmt: skip
def recall_snapshots(spark, d):
    out = recall.recall_snapshots(_requests(spark, d), strategies.full_snapshots(fact(spark, d), LAST))
    return out.select("request_id", "available", F.col("first_order").cast("long").alias("first_order"), F.col("last_order").cast("long").alias("last_order"), "matching_orders")


@query("recall_vintage_key", sql("""SELECT 'r-' || observation_id AS request_id, arrival_order <> 4 AS available, arrival_order <> 4 AND cell_id >= '2' AND NOT (cell_id >= 'e' AND arrival_order = 1) AS exact FROM fact""", "fact"))
def recall_vintage_key(spark, d):
    """Against a store that lacks a release, writes some numbers otherwise and has some values wrong."""
    rows = fact(spark, d)
    wrong = (F.col("cell_id") >= "e") & (F.col("arrival_order") == 1)
    store = rows.where("arrival_order <> 4").withColumns({
        "value_lexeme": F.when(F.col("cell_id") < "2", F.concat("value_lexeme", F.lit("0"))).otherwise(F.col("value_lexeme")),
        "value": F.when(wrong, (F.col("value") + 1).cast("decimal(18,2)")).otherwise(F.col("value")),
    })
    return recall.recall_vintage_key(_requests_of(rows), store).select("request_id", "available", "exact")


def _held(rows):
    """strategy, cell_id, observation_id, historical of all that each strategy holds."""
    current = strategies.overwrite_state(rows)
    at = lambda df, name, history: df.select(F.lit(name).alias("strategy"), "cell_id", "observation_id", history.alias("historical"))
    b0 = at(current, "B0", F.lit(False))
    b2 = at(strategies.select_single_source(rows, _scores_of(rows)), "B2", F.lit(False))
    b1 = at(strategies.full_snapshots(rows, LAST), "B1", F.col("snapshot_order") < LAST)
    last = F.col("arrival_order") == F.max("arrival_order").over(strategies.whole_cell())
    b3 = at(rows.withColumn("served", last), "B3", ~F.col("served"))
    return b0.unionByName(b1).unionByName(b2).unionByName(b3)


def _audit(spark, d):
    return _audit_of(_stored(spark, d))


def _audit_of(rows):
    return recall.recall_audit(_requests_of(rows), _held(rows), rows, ["B0", "B1", "B2", "B3"])


_AUDIT = """audit AS (SELECT s.strategy, 'r-' || f.observation_id AS request_id,
        CASE WHEN s.observation_id = f.observation_id THEN 'serving' WHEN s.strategy IN ('B1', 'B3') THEN 'historical' ELSE 'unavailable' END AS access_class,
        s.observation_id = f.observation_id OR s.strategy IN ('B1', 'B3') AS identity_match,
        s.observation_id = f.observation_id OR s.strategy IN ('B1', 'B3') OR s.value = f.value AS decimal_match,
        s.observation_id = f.observation_id OR s.strategy IN ('B1', 'B3') OR s.value_lexeme = f.value_lexeme AS lexeme_match
    FROM fact f JOIN (SELECT strategy, cell_id, observation_id, value, value_lexeme FROM current, (VALUES ('B0'), ('B1'), ('B3')) v(strategy)
                      UNION ALL SELECT 'B2', cell_id, observation_id, value, value_lexeme FROM selected) s USING (cell_id))"""  # fmt: skip


@query("recall_audit", sql(f"WITH {_AUDIT} SELECT *, CASE WHEN identity_match THEN 'none' WHEN lexeme_match THEN 'duplicate_value' ELSE 'material' END AS failure_class FROM audit", "fact", "current", "selected"))
def recall_audit(spark, d):
    return _audit(spark, d)


_METRICS = f"""SELECT strategy, count(*) AS requests, count(*) FILTER (access_class = 'serving') AS serving, count(*) FILTER (access_class = 'historical') AS historical,
    count(*) FILTER (access_class = 'unavailable') AS failures, round(avg(CASE WHEN identity_match THEN 1.0 ELSE 0.0 END), 4) AS recall_rate FROM audit GROUP BY 1"""


@query("recall_metrics", sql(f"WITH {_AUDIT} {_METRICS}", "fact", "current", "selected"))
def recall_metrics(spark, d):
    return recall.recall_metrics(_audit(spark, d))


@query("recall_repeatability", sql("""WITH e AS (SELECT * FROM (SELECT cell_id, observation_id, row_number() OVER (PARTITION BY cell_id ORDER BY arrival_order DESC) AS k FROM fact WHERE arrival_order < 5) WHERE k = 1),
    a AS (SELECT 'r-' || f.observation_id AS request_id, f.observation_id = c.observation_id AS one, CASE WHEN f.cell_id < '4' THEN coalesce(f.observation_id = e.observation_id, false) ELSE f.observation_id = c.observation_id END AS three FROM fact f JOIN current c USING (cell_id) LEFT JOIN e USING (cell_id))
    SELECT request_id, CAST(3 AS BIGINT) AS repetitions, one = three AS repeatable, (one AND three) = one AS as_expected FROM a""", "fact", "current"))  # fmt: skip
def recall_repeatability(spark, d):
    """Three measurements of the served state, the third after a part of the cells has lost the last arrival."""
    rows = _stored(spark, d)
    now, before = strategies.overwrite_state(rows), strategies.overwrite_state(rows.where("arrival_order < 5"))
    columns = ["cell_id", "observation_id", "value_lexeme"]
    rolled_back = now.where("cell_id >= '4'").select(columns).unionByName(before.where("cell_id < '4'").select(columns))
    asked = _requests_of(rows)
    measured = None
    for n, state in enumerate((now, now, rolled_back), 1):
        one = recall.recall_current(asked, state).select("request_id", "available", F.lit(n).alias("repetition"))
        measured = one if measured is None else measured.unionByName(one)
    last = rows.join(now.select("cell_id", F.col("observation_id").alias("last_id")), "cell_id")
    expected = _requests_of(last).select("request_id", (F.col("observation_id") == F.col("last_id")).alias("available"))
    return recall.repeatability(measured, ["request_id"], ["available"], expected)


_LOST = """lost AS (SELECT s.strategy, f.*, s.observation_id AS served_id, s.value AS served_value FROM fact f
    JOIN (SELECT 'B0' AS strategy, cell_id, observation_id, value FROM current UNION ALL SELECT 'B2', cell_id, observation_id, value FROM selected) s USING (cell_id) WHERE s.observation_id <> f.observation_id)"""


def _lost(spark, d):
    return _lost_of(_stored(spark, d))


def _lost_of(rows):
    c = ["cell_id", "observation_id", "value"]
    served = strategies.overwrite_state(rows).select(F.lit("B0").alias("strategy"), *c).unionByName(strategies.select_single_source(rows, _scores_of(rows)).select(F.lit("B2").alias("strategy"), *c))
    return recall.lost_requests(_requests_of(rows), served)


_PROFILE = "SELECT strategy, source_id, domain, geo_level, count(*) AS lost, count(*) FILTER (value <> served_value) AS material, count(*) FILTER (value = served_value) AS duplicate_value FROM lost GROUP BY 1, 2, 3, 4"


@query("failure_profile", sql(f"WITH {_LOST} {_PROFILE}", "fact", "current", "selected"))
def failure_profile(spark, d):
    return recall.failure_profile(_lost(spark, d))


@query("failure_cases", sql(f"""WITH {_LOST} SELECT strategy, 'r-' || observation_id AS request_id, cell_id, observation_id, served_id, CAST(value AS DOUBLE) AS value, CAST(served_value AS DOUBLE) AS served_value,
    CAST(value - served_value AS DOUBLE) AS delta FROM lost WHERE value <> served_value""", "fact", "current", "selected"))  # fmt: skip
def failure_cases(spark, d):
    out = recall.failure_cases(_lost(spark, d))
    return out.withColumns({c: F.col(c).cast("double") for c in ("value", "served_value", "delta")})


@query("superseded_serving", sql("SELECT s.cell_id, s.observation_id, c.observation_id AS latest_id FROM selected s JOIN current c USING (cell_id) WHERE s.observation_id <> c.observation_id AND s.value <> c.value", "selected", "current"))
def superseded_serving(spark, d):
    rows = fact(spark, d)
    return recall.superseded_serving(strategies.select_single_source(rows, _scores(spark, d)), rows).select("cell_id", "observation_id", "latest_id")


#: Rows that each strategy holds stand for its cost.
_COST = "ct AS (SELECT 'B0' AS strategy, count(*) AS cost FROM current UNION ALL SELECT 'B1', count(*) FROM states UNION ALL SELECT 'B2', count(*) FROM selected UNION ALL SELECT 'B3', count(*) FROM fact)"


def _rows_held(rows):
    cells = rows.agg(F.count_distinct("cell_id").alias("c"), F.count("*").alias("n"))
    snapshots = strategies.full_snapshots(rows, LAST).agg(F.count("*").alias("s"))
    costs = F.array(*(F.struct(F.lit(b).alias("strategy"), F.col(c).alias("cost")) for b, c in (("B0", "c"), ("B1", "s"), ("B2", "c"), ("B3", "n"))))
    return cells.crossJoin(snapshots).select(F.explode(costs).alias("x")).select("x.*")  # one row


@query("failure_synthesis", sql(f"""WITH {_AUDIT}, mt AS ({_METRICS}), {_COST}, {_LOST}, p AS ({_PROFILE}), l AS (SELECT strategy, 'material' AS failure, material AS n FROM p UNION ALL SELECT strategy, 'duplicate_value', duplicate_value FROM p),
    h AS (SELECT failure, strategy, sum(n) AS n FROM l GROUP BY 1, 2)
    SELECT failure, CAST(sum(n) AS BIGINT) AS total, coalesce(string_agg(strategy, ',' ORDER BY strategy) FILTER (n > 0), '') AS affected,
           concat_ws(',', CASE WHEN count(*) FILTER (strategy = 'B0' AND n > 0) = 0 THEN 'B0' END, 'B1', CASE WHEN count(*) FILTER (strategy = 'B2' AND n > 0) = 0 THEN 'B2' END, 'B3') AS free,
           (SELECT arg_min(strategy, cost) FROM ct JOIN mt USING (strategy) WHERE recall_rate >= 1) AS cheapest_full_recall
    FROM h GROUP BY 1""", "fact", "current", "selected", "states"))  # fmt: skip
def failure_synthesis(spark, d):
    rows = _stored(spark, d)
    return recall.failure_synthesis(recall.failure_profile(_lost_of(rows)), ["B0", "B1", "B2", "B3"], _rows_held(rows), recall.recall_metrics(_audit_of(rows)))


@query("expected_arrival_states", sql(f"""WITH o AS ({_OPS}), c AS (SELECT arrival_order, sum(inserted) OVER (ORDER BY arrival_order) AS cells, sum(input_rows) OVER (ORDER BY arrival_order) AS stored FROM o),
    s AS (SELECT *, sum(cells) OVER (ORDER BY arrival_order) AS snapshots FROM c)
    SELECT arrival_order, strategy, CAST(CASE strategy WHEN 'B1' THEN snapshots WHEN 'B3' THEN stored ELSE cells END AS BIGINT) AS expected_rows FROM s, (VALUES ('B0'), ('B1'), ('B2'), ('B3')) v(strategy)""", "hist"))  # fmt: skip
def expected_arrival_states(spark, d):
    catalog = strategies.overwrite_operations(fact(spark, d)).withColumn("arrival_order", F.col("arrival_order").cast("long"))
    return recall.expected_arrival_states(catalog)
