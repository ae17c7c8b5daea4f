"""Queries over comparison, classification and column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from revisor.functions import identity as fn
from revisor.operators import compare, coverage, lexical
from revisor.operators.strategies import ROLES
from revisor.plans.bridge import fact, observations, releases, sql, table
from revisor.plans.registry import query

CELL_SQL = "indicator_key, series_key, observed_period, geo_level, geo_code, unit"
SOURCES = ["click", "error", "purchase", "signup", "view"]

# ---------------------------------------------------------------- expressions


@query("identity_hash", "SELECT p_partkey, substr(sha256(concat_ws(chr(31), coalesce(p_name, ''), coalesce(p_brand, ''), CAST(p_size AS VARCHAR))), 1, 20) AS id FROM part")
def identity_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.identity("p_name", "p_brand", "p_size").alias("id"))


@query("decimal_lexeme", """SELECT l_orderkey, l_linenumber, CAST(TRY_CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS DECIMAL(38,10)) AS DOUBLE) AS number, CAST(2 AS BIGINT) AS places, TRY_CAST(l_returnflag AS DECIMAL(38,10)) IS NULL AS flag_is_no_number, CAST(TRY_CAST(CAST(l_orderkey AS VARCHAR) || '000000000000000000' AS DECIMAL(38,10)) AS DOUBLE) AS large FROM lineitem""")
def decimal_lexeme(spark, d):
    rows = table(spark, d, "lineitem").withColumn("lexeme", F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return rows.select("l_orderkey", "l_linenumber", fn.decimal_of(F.col("lexeme")).cast("double").alias("number"), fn.decimal_places(F.col("lexeme")).cast("long").alias("places"), fn.decimal_of(F.col("l_returnflag")).isNull().alias("flag_is_no_number"), fn.decimal_of(F.concat(F.col("l_orderkey").cast("string"), F.lit("0" * 18))).cast("double").alias("large"))


@query("geo_level_code", """SELECT p_partkey, CASE WHEN c = 9999 THEN 'national' WHEN c < 1100 THEN 'non_spatial' WHEN c % 100 = 0 THEN 'province' ELSE 'regency' END AS geo_level
    FROM (SELECT p_partkey, p_partkey * 37 % 10000 AS c FROM part)""")  # fmt: skip
def geo_level_code(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.geo_level(F.col("p_partkey") * 37 % 10000).alias("geo_level"))


@query("normalise_name", """SELECT n_nationkey, CASE n WHEN 'DAERAHISTIMEWAYOGYAKARTA' THEN 'DIYOGYAKARTA' WHEN 'KEPULAUANBANGKABELITUNG' THEN 'KEPBANGKABELITUNG' WHEN 'KEPRIAU' THEN 'KEPULAUANRIAU' ELSE n END AS name
    FROM (SELECT n_nationkey, regexp_replace(upper(regexp_replace('<b>' || n_name || '</b>', '<[^>]*>', ' ', 'g')), '[^A-Z]', '', 'g') AS n FROM nation)""")  # fmt: skip
def normalise_name(spark, d):
    return table(spark, d, "nation").select("n_nationkey", fn.normalise_name(F.concat(F.lit("<b>"), "n_name", F.lit("</b>"))).alias("name"))


@query("eligible_only", sql("SELECT cell_id, observation_id FROM fact JOIN releases r USING (source_id) WHERE r.status = 'active' AND r.role IN ('indicator_values', 'indicator_values_and_definitions')", "fact"))
def eligible_only(spark, d):
    good = releases(spark).where("status = 'active'").where(F.col("role").isin(*ROLES)).select("source_id")
    return fact(spark, d).join(good, "source_id", "left_semi").select("cell_id", "observation_id")


@query("numeric_guard", """SELECT count(*) AS kept, (SELECT count(*) FROM events WHERE TRY_CAST(CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DECIMAL(38,10)) IS NULL) AS dropped
    FROM events WHERE TRY_CAST(CASE WHEN event_id % 7 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DECIMAL(38,10)) IS NOT NULL""")  # fmt: skip
def numeric_guard(spark, d):
    lexeme = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").agg(F.count_if(fn.is_number(lexeme)).alias("kept"), F.count_if(~fn.is_number(lexeme)).alias("dropped"))


@query("year_from_label", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders")
def year_from_label(spark, d):
    label = F.concat(F.lit("as of "), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" (prel. 12)"))
    return table(spark, d, "orders").select("o_orderkey", fn.year_of(label).cast("long").alias("year"))


@query("merge_flags", """SELECT p_partkey, array_to_string(list_filter([a, b, CASE WHEN c <> a AND c <> b THEN c END], lambda x: x IS NOT NULL), ';') AS flags
    FROM (SELECT p_partkey, p_brand AS a, 'size' || CAST(p_size % 5 AS VARCHAR) AS b, 'size' || CAST(p_size % 3 AS VARCHAR) AS c FROM part)""")  # fmt: skip
def merge_flags(spark, d):
    size = lambda n: F.concat(F.lit("size"), (F.col("p_size") % n).cast("string"))
    one = F.concat_ws(";", "p_brand", size(5))
    return table(spark, d, "part").select("p_partkey", fn.merge_flags(one, F.concat_ws(";", size(3), "p_brand")).alias("flags"))


@query("constant_provenance", sql("SELECT observation_id, CASE WHEN source_id IN ('click', 'view') THEN 'api' ELSE 'publication' END AS source_channel, CASE WHEN source_id IN ('click', 'view') THEN 'retrieved' ELSE 'published' END AS vintage_basis, 'run-1' AS transformation_run_id FROM fact", "fact"))
def constant_provenance(spark, d):
    api = F.col("source_id").isin("click", "view")
    return fact(spark, d).select("observation_id", F.when(api, "api").otherwise("publication").alias("source_channel"), F.when(api, "retrieved").otherwise("published").alias("vintage_basis"), F.lit("run-1").alias("transformation_run_id"))


@query("extract_kv", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS variable FROM events")
def extract_kv(spark, d):
    key = F.when(F.col("event_id") % 3 == 0, F.lit("novar")).otherwise(F.lit("var"))
    locator = F.concat(F.lit("src=1;"), key, F.lit("="), F.col("user_id").cast("string"), F.lit(";p=2"))
    return table(spark, d, "events").select("event_id", fn.key_value(locator, "var").alias("variable"))


@query("arrival_filter", sql("SELECT cell_id, observation_id FROM fact WHERE arrival_order = 3", "fact"))
def arrival_filter(spark, d):
    return fact(spark, d).where("arrival_order = 3").select("cell_id", "observation_id")


@query("null_mismatch_guard", sql("SELECT observation_id, coalesce(prev_value <> value, false) AS changed FROM hist", "hist"))
def null_mismatch_guard(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("cell_id").orderBy("arrival_order")
    return fact(spark, d).select("observation_id", fn.changed(F.col("value"), F.lag("value").over(w)).alias("changed"))


# ---------------------------------------------------------------- comparison

_BY = f"""by_cell AS (SELECT {CELL_SQL}, min(domain) AS domain, count(DISTINCT source_id) AS snapshot_count, count(DISTINCT value) AS distinct_values, CAST(min(value) AS DOUBLE) AS min_value, CAST(max(value) AS DOUBLE) AS max_value,
    CAST(max(value) - min(value) AS DOUBLE) AS spread, max(arrival_order) AS last_order, min(vintage_date) AS first_date, max(vintage_date) AS last_date FROM fact GROUP BY {CELL_SQL})"""
_SPARSE = f"{_BY}, compared AS (SELECT *, CASE WHEN snapshot_count = 1 THEN 'single_source' WHEN distinct_values = 1 THEN 'exact_match' ELSE 'value_mismatch' END AS status FROM by_cell)"
_OUT = ["observed_period", "geo_code", "snapshot_count", "distinct_values", "min_value", "max_value", "spread", "status"]


def _shown(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("min_value", "max_value", "spread")}).select(*_OUT)


def _compared(spark, d):
    rows = fact(spark, d)
    out = compare.compare_sparse(rows, [*compare.CELL, "domain"])
    return out


@query("compare_snapshots", sql(f"WITH {_BY} SELECT {', '.join(_OUT[:-1])}, CASE WHEN snapshot_count < 5 THEN 'missing_snapshot' WHEN distinct_values = 1 THEN 'exact_match' ELSE 'value_mismatch' END AS status FROM by_cell", "fact"))
def compare_snapshots(spark, d):
    return _shown(compare.compare_snapshots(observations(spark, d)))


@query("compare_sparse", sql(f"WITH {_SPARSE} SELECT {', '.join(_OUT)} FROM compared", "fact"))
def compare_sparse(spark, d):
    return _shown(compare.compare_sparse(observations(spark, d)))


_SIDE = ", ".join(f"max(value_lexeme) FILTER (source_id = '{s}') AS value_{s}" for s in SOURCES)


@query("pivot_discrepancies", sql(f"""SELECT observed_period, geo_code, {", ".join("value_" + s for s in SOURCES)}, CASE WHEN n < 5 THEN 'coverage_gap' ELSE 'unclassified_difference' END AS kind
    FROM (SELECT {CELL_SQL}, {_SIDE}, count(DISTINCT source_id) AS n, count(DISTINCT value) AS d FROM fact GROUP BY {CELL_SQL}) WHERE n < 5 OR d > 1""", "fact"))  # fmt: skip
def pivot_discrepancies(spark, d):
    return compare.pivot_discrepancies(observations(spark, d), SOURCES).drop("indicator_key", "series_key", "geo_level", "unit")


@query("release_candidates", sql(f"WITH {_SPARSE} SELECT observed_period, geo_code, spread, 'release_revision_candidate' AS candidate FROM compared WHERE status = 'value_mismatch'", "fact"))
def release_candidates(spark, d):
    out = compare.release_candidates(compare.compare_sparse(observations(spark, d)), {"methodology_index": "methodology_candidate"})
    return out.select("observed_period", "geo_code", F.col("spread").cast("double").alias("spread"), "candidate")


@query("classify_difference", sql(f"""WITH {_SPARSE} SELECT observed_period, geo_code, CASE WHEN spread <= 0.01 THEN 'last_digit_difference' WHEN last_date > first_date THEN 'candidate_revision' ELSE 'unclassified_difference' END AS classification FROM compared WHERE status = 'value_mismatch'""", "fact"))
def classify_difference(spark, d):
    rows = fact(spark, d)
    status = F.when(F.count_distinct("value") > 1, "value_mismatch").otherwise("exact_match").alias("status")
    by = rows.groupBy(*compare.CELL).agg(status, (F.max("value") - F.min("value")).alias("spread"), F.max("places").alias("places"), F.min("vintage_date").alias("first"), F.max("vintage_date").alias("last"))
    return compare.classify_difference(by, F.col("first"), F.col("last")).select("observed_period", "geo_code", "classification")


def _hierarchy(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mean = F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("*")
    value = (F.floor(mean * 100 + 0.5) / 100).cast("decimal(18,2)")
    child = c.groupBy("r_name", "c_mktsegment", "n_name").agg(value.alias("value")).select("r_name", "c_mktsegment", F.lit("nation").alias("geo_level"), "value")
    parent = c.groupBy("r_name", "c_mktsegment").agg(value.alias("value")).select("r_name", "c_mktsegment", F.lit("region").alias("geo_level"), "value")
    return child.unionByName(parent)


_HIER = """h AS (SELECT r_name, c_mktsegment, n_name, CAST(floor(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS value
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
    p AS (SELECT r_name, c_mktsegment, CAST(floor(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS value
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""  # fmt: skip


@query("granularity_report", f"""WITH {_HIER} SELECT r_name, c_mktsegment, CAST(p.value AS DOUBLE) AS parent_value, count(*) AS children, CAST(min(h.value) AS DOUBLE) AS child_min, CAST(max(h.value) AS DOUBLE) AS child_max,
    round(CAST(sum(h.value) AS DOUBLE) / count(*), 4) AS child_mean, round(CAST(p.value AS DOUBLE) - CAST(sum(h.value) AS DOUBLE) / count(*), 4) AS gap, p.value BETWEEN min(h.value) AND max(h.value) AS in_range
    FROM h JOIN p USING (r_name, c_mktsegment) GROUP BY r_name, c_mktsegment, p.value""")  # fmt: skip
def granularity_report(spark, d):
    out = compare.granularity_report(_hierarchy(spark, d), ["r_name", "c_mktsegment"], "region", "nation")
    return out.withColumns({c: F.col(c).cast("double") for c in ("parent_value", "child_min", "child_max")})


@query("indicator_summary", sql(f"""WITH {_SPARSE} SELECT domain, count(*) AS cells, count(*) FILTER (snapshot_count > 1) AS overlap, count(*) FILTER (status = 'exact_match') AS exact, count(*) FILTER (status = 'value_mismatch') AS mismatch,
    count(*) FILTER (snapshot_count = 1) AS missing, round(count(*) FILTER (status = 'value_mismatch') / nullif(count(*) FILTER (snapshot_count > 1), 0), 4) AS mismatch_rate, max(spread) AS max_spread FROM compared GROUP BY 1""", "fact"))  # fmt: skip
def indicator_summary(spark, d):
    return compare.indicator_summary(_compared(spark, d), ["domain"]).withColumn("max_spread", F.col("max_spread").cast("double"))


@query("domain_summary", sql(f"""WITH {_SPARSE}, c AS (SELECT domain, count(*) AS cells, count(*) FILTER (status <> 'single_source') AS compared, count(*) FILTER (status = 'exact_match') AS exact, count(*) FILTER (status = 'value_mismatch') AS mismatch,
    count(*) FILTER (status = 'single_source') AS single FROM compared GROUP BY 1) SELECT * FROM (SELECT domain, count(*) AS observations FROM fact GROUP BY 1) JOIN c USING (domain)""", "fact"))  # fmt: skip
def domain_summary(spark, d):
    return compare.domain_summary(fact(spark, d), _compared(spark, d))


@query("scope_overlap", sql("""WITH f AS (SELECT domain, observed_period, geo_code, max(CAST(source_id = 'click' AS INT)) AS a, max(CAST(source_id = 'view' AS INT)) AS b FROM fact GROUP BY 1, 2, 3)
    SELECT domain, CAST(sum(a) AS BIGINT) AS in_one, CAST(sum(b) AS BIGINT) AS in_two, CAST(sum(a * b) AS BIGINT) AS in_both, min(observed_period) AS first_period, max(observed_period) AS last_period,
           CASE WHEN sum(a * b) = 0 THEN 'disjoint' WHEN sum(a * b) = sum(a) AND sum(a * b) = sum(b) THEN 'same_scope' ELSE 'partial_overlap' END AS status FROM f GROUP BY 1""", "fact"))  # fmt: skip
def scope_overlap(spark, d):
    return compare.scope_overlap(fact(spark, d), "click", "view", "domain", ["observed_period", "geo_code"]).drop("p0", "p1")


#: Orders as the values of variables: a segment is a variable, of which one has no areas, two have gaps in their years, one begins late and one has two kinds of period.
_CODE = "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_nationkey + 1 WHEN c_nationkey = 0 THEN 9999 WHEN c_nationkey < 13 THEN 1100 + 100 * c_nationkey ELSE 1101 + 100 * c_nationkey END"
_KEPT = """NOT (c_mktsegment = 'BUILDING' AND year = 1995) AND NOT (c_mktsegment = 'FURNITURE' AND year IN (1994, 1995)) AND NOT (c_mktsegment = 'AUTOMOBILE' AND year < 1996)"""


def _cells(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumns({"year": F.year("o_orderdate"), "code": F.expr(_CODE).cast("string")}).where(_KEPT)
    period = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("year") % 2 == 0), "Semester").otherwise("Tahun").alias("period")
    return o.groupBy(F.col("c_mktsegment").alias("variable"), "code", F.col("o_orderpriority").alias("category"), "year", period).agg(F.max("o_orderdate").cast("string").alias("updated"))


def _listed(spark, d):
    cells = _cells(spark, d)
    entry = lambda df, name, code, label: df.select("variable", F.lit(0).alias("response"), F.lit(name).alias("dimension"), code.cast("string").alias("code"), label.cast("string").alias("label")).distinct()
    c = F.col
    customers = table(spark, d, "customer").select(c("c_mktsegment").alias("variable"), F.expr(_CODE).cast("string").alias("code"))
    variables = customers.select("variable").distinct()
    years = entry(cells, "year", c("year"), F.concat(F.lit("Tahun "), c("year").cast("string"))).unionByName(entry(variables, "year", F.lit(1998), F.lit("Tahun 1998")))
    return (
        entry(customers, "unit", c("code"), c("code"))
        .unionByName(entry(cells, "category", c("category"), c("category")))
        .unionByName(entry(variables.where("variable = 'AUTOMOBILE'"), "category", F.lit("0"), F.lit("Tidak ada")))
        .unionByName(years.distinct())
        .unionByName(entry(cells, "period", c("period"), c("period")))
        .unionByName(entry(variables, "unit_name", F.lit(""), F.concat(F.lit("units of "), c("variable"))))
    )


_PROFILE = f"""cells AS (SELECT c_mktsegment AS variable, CAST({_CODE} AS VARCHAR) AS code, o_orderpriority AS category, year, CASE WHEN c_mktsegment = 'MACHINERY' AND year % 2 = 0 THEN 'Semester' ELSE 'Tahun' END AS period, CAST(max(o_orderdate) AS VARCHAR) AS updated
        FROM (SELECT *, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey) WHERE {_KEPT} GROUP BY 1, 2, 3, 4, 5),
    us AS (SELECT DISTINCT c_mktsegment AS variable, CAST({_CODE} AS BIGINT) AS code FROM customer),
    lu AS (SELECT variable, count(*) AS units, count(*) FILTER (code = 9999) AS nat, count(*) FILTER (code BETWEEN 1100 AND 9998 AND code % 100 = 0) AS prov, count(*) FILTER (code BETWEEN 1100 AND 9998 AND code % 100 <> 0) AS reg FROM us GROUP BY 1),
    ly AS (SELECT variable, list_sort(list(DISTINCT year)) AS years FROM (SELECT variable, year FROM cells UNION SELECT variable, 1998 FROM lu) GROUP BY 1),
    lc AS (SELECT variable, count(DISTINCT category) + CASE WHEN variable = 'AUTOMOBILE' THEN 1 ELSE 0 END AS n, string_agg(DISTINCT category, ';' ORDER BY category) AS categories, count(DISTINCT period) AS periods,
                  string_agg(DISTINCT period, ';' ORDER BY period) AS period_types, count(*) AS observed_cells, max(updated) AS last_update FROM cells GROUP BY 1),
    profiles AS (SELECT variable, nat + prov + reg = 0 AS breakdown, CASE WHEN nat + prov + reg = 0 THEN 'national' ELSE concat_ws(';', CASE WHEN nat > 0 THEN 'national' END, CASE WHEN prov > 0 THEN 'province' END, CASE WHEN reg > 0 THEN 'regency' END) END AS levels,
        CASE WHEN nat + prov + reg = 0 THEN 1 ELSE nat END AS national_units, prov AS province_units, reg AS regency_units, CASE WHEN nat + prov + reg = 0 AND units > 1 THEN 'units of ' || variable ELSE '' END AS breakdowns, categories, period_types, years,
        list_filter(range(years[1], years[-1] + 1), lambda y: NOT list_contains(years, y)) AS gaps, observed_cells, units * n * len(years) * periods AS expected_cells, round(observed_cells / (units * n * len(years) * periods), 4) AS density, last_update
        FROM lu JOIN ly USING (variable) JOIN lc USING (variable))"""  # fmt: skip


def _profiles(spark, d):
    return coverage.profile_variable(_cells(spark, d), _listed(spark, d), ["variable"])


@query("profile_variable", f"""WITH {_PROFILE} SELECT variable, levels, national_units, province_units, regency_units, breakdowns, categories, period_types, array_to_string(years, ';') AS years,
    coalesce(array_to_string(gaps, ';'), '') AS year_gaps, observed_cells, expected_cells, density, last_update FROM profiles""")  # fmt: skip
def profile_variable(spark, d):
    joined = {c: F.array_join(c, ";") for c in ("levels", "breakdowns", "categories", "period_types", "years", "year_gaps")}
    return _profiles(spark, d).withColumns(joined)


#: Indicators with their proposed levels and sources, their variables, and publications that speak of them.
_INVENTORY = """('full', 'national;province;regency', 'api'), ('gap', 'national', 'api'), ('filled', 'national', 'api'), ('published', 'national;province', 'api;book'), ('late', 'national', 'book'),
    ('missing_all', 'district', 'api'), ('derived', 'national', 'api'), ('derived_short', 'national;district', 'api'), ('none', 'national', 'api'), ('ghost', 'national', 'api'), ('book_only', 'province', 'book')"""
_MAPPED = """('full', 'MACHINERY'), ('gap', 'BUILDING'), ('filled', 'BUILDING'), ('filled', 'MACHINERY'), ('published', 'FURNITURE'), ('late', 'AUTOMOBILE'), ('missing_all', 'HOUSEHOLD'), ('derived', 'BUILDING'), ('derived_short', 'BUILDING'), ('ghost', 'GHOST')"""
_PUBLISHED = """('published', 'book_1995', 'regency', 1995, 1996), ('published', 'book_1994', 'province', 1993, 1994), ('book_only', 'book_2000', 'province;regency', 2000, 2003), ('derived', 'book_2001', 'national', NULL, NULL)"""
_DERIVED = ("derived", "derived_short", "none")
SPAN = 5
_COVER = f"""{_PROFILE}, i AS (SELECT * FROM (VALUES {_INVENTORY}) t(indicator_key, proposed, proposed_sources)), m AS (SELECT * FROM (VALUES {_MAPPED}) t(indicator_key, variable)),
    b AS (SELECT * FROM (VALUES {_PUBLISHED}) t(indicator_key, source_id, levels, first_year, last_year)), own AS (SELECT * FROM m JOIN profiles USING (variable)),
    covered AS (SELECT indicator_key, unnest(years) AS year FROM own UNION SELECT indicator_key, unnest(range(first_year, last_year + 1)) FROM b WHERE first_year IS NOT NULL),
    op AS (SELECT DISTINCT indicator_key, year FROM (SELECT indicator_key, unnest(gaps) AS year FROM own) ANTI JOIN covered USING (indicator_key, year)),
    lv AS (SELECT indicator_key, list(DISTINCT level) AS levels FROM (SELECT indicator_key, unnest(string_split(levels, ';')) AS level FROM own UNION SELECT indicator_key, unnest(string_split(levels, ';')) FROM b) GROUP BY 1),
    a AS (SELECT indicator_key, proposed, proposed_sources, (SELECT count(*) FROM m WHERE m.indicator_key = i.indicator_key) AS variables, (SELECT count(*) FROM own o WHERE o.indicator_key = i.indicator_key) AS profiles,
             (SELECT count(DISTINCT source_id) FROM b WHERE b.indicator_key = i.indicator_key) + (SELECT count(*) FROM own o WHERE o.indicator_key = i.indicator_key AND observed_cells > 0) AS evidence,
             list_filter(['national', 'province', 'regency'], lambda x: list_contains(coalesce(lv.levels, []), x)) AS verified, (SELECT min(year) FROM covered c WHERE c.indicator_key = i.indicator_key) AS period_start, (SELECT max(year) FROM covered c WHERE c.indicator_key = i.indicator_key) AS period_end,
             coalesce((SELECT string_agg(year, ';' ORDER BY year) FROM op WHERE op.indicator_key = i.indicator_key), '') AS period_gaps, (SELECT list(DISTINCT x) FROM (SELECT unnest(string_split(period_types, ';')) AS x FROM own o WHERE o.indicator_key = i.indicator_key)) AS kinds,
             coalesce((SELECT sum(observed_cells) FROM own o WHERE o.indicator_key = i.indicator_key), 0)::BIGINT AS observed_cells, (SELECT max(last_update) FROM own o WHERE o.indicator_key = i.indicator_key) AS last_update FROM i LEFT JOIN lv USING (indicator_key)),
    e AS (SELECT *, len(list_filter(string_split(proposed, ';'), lambda x: NOT list_contains(verified, x))) AS missing, indicator_key IN {_DERIVED} AND evidence > 0 AS needs FROM a),
    cover AS (SELECT indicator_key, variables, coalesce(array_to_string(verified, ';'), '') AS verified_levels, period_start, period_end, period_gaps, observed_cells, last_update,
        CASE WHEN evidence = 0 THEN 'unavailable' WHEN missing > 0 OR needs THEN 'partial' ELSE 'verified' END AS status,
        CASE WHEN evidence = 0 THEN 'no_exact_free_series_confirmed' WHEN missing > 0 THEN 'geography_shortfall' WHEN needs THEN 'derivation_required' ELSE 'free_source_confirmed_full_geography' END AS reason,
        concat_ws(';', CASE WHEN needs THEN 'derivation_required' END, CASE WHEN missing > 0 AND evidence > 0 THEN 'geography_shortfall' END, CASE WHEN variables > 1 THEN 'multi_variable' END, CASE WHEN period_gaps <> '' THEN 'period_gap' END,
            CASE WHEN period_end - period_start + 1 < {SPAN} THEN 'short_series' END, CASE WHEN len(kinds) > 1 OR kinds[1] NOT IN ('Tahun', 'Tahunan') THEN 'subannual_periods' END, CASE WHEN profiles > 0 AND proposed_sources NOT LIKE '%api%' THEN 'webapi_found_unproposed' END) AS flags FROM e)"""  # fmt: skip


def _inventory(spark):
    rows = spark.sql(f"SELECT * FROM VALUES {_INVENTORY} AS t(indicator_key, proposed, proposed_sources)")
    return rows.withColumns({c: F.split(c, ";") for c in ("proposed", "proposed_sources")})


def _coverage(spark, d):
    mapped = spark.sql(f"SELECT * FROM VALUES {_MAPPED} AS t(indicator_key, variable)")
    published = spark.sql(f"SELECT indicator_key, source_id, split(levels, ';') AS levels, first_year, last_year FROM VALUES {_PUBLISHED} AS t(indicator_key, source_id, levels, first_year, last_year)")
    return coverage.indicator_coverage(_inventory(spark), mapped, _profiles(spark, d), published, ["variable"], "api", SPAN, _DERIVED)


@query("indicator_coverage", f"WITH {_COVER} SELECT * FROM cover")
def indicator_coverage(spark, d):
    return _coverage(spark, d)


@query("derive_status", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unavailable' WHEN o_orderkey % 3 > 0 THEN 'partial' ELSE 'verified' END AS status FROM orders")
def derive_status(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", coverage.derive_status(k % 3, k % 4).alias("status"))


@query("apply_coverage", f"""WITH {_COVER}, v AS (SELECT indicator_key, 'unavailable' AS status, CASE WHEN indicator_key = 'none' THEN '' ELSE 'old' END AS flags FROM i)
    SELECT v.indicator_key, c.status, concat_ws(';', nullif(v.flags, ''), nullif(c.flags, '')) AS flags, c.status <> 'unavailable' OR c.flags <> '' AS changed FROM v JOIN cover c USING (indicator_key)""")  # fmt: skip
def apply_coverage(spark, d):
    old = F.when(F.col("indicator_key") == "none", "").otherwise("old").alias("flags")
    return compare.apply_coverage(_inventory(spark).select("indicator_key", F.lit("unavailable").alias("status"), old), _coverage(spark, d))


@query("validate_inventory", """WITH i AS (SELECT CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS indicator_key, p_brand AS b, CASE p_size % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' WHEN 2 THEN 'odd' ELSE 'unavailable' END AS status,
        CASE WHEN p_size % 8 = 0 THEN '' WHEN p_size % 5 = 0 THEN 'click;ghost' ELSE 'click;view' END AS sources FROM part)
    SELECT 'missing_key' AS rule, indicator_key AS key FROM i WHERE trim(indicator_key) = '' UNION ALL SELECT 'duplicate_key', indicator_key FROM i GROUP BY indicator_key HAVING count(*) > 1
    UNION ALL SELECT 'unknown_status', indicator_key FROM i WHERE status NOT IN ('verified', 'partial', 'unavailable')
    UNION ALL SELECT DISTINCT 'unknown_source', indicator_key FROM i WHERE sources LIKE '%ghost%' UNION ALL SELECT 'verified_without_source', indicator_key FROM i WHERE status = 'verified' AND sources = ''""")  # fmt: skip
def validate_inventory(spark, d):
    size = F.col("p_size")
    status = F.when(size % 4 == 0, "verified").when(size % 4 == 1, "partial").when(size % 4 == 2, "odd").otherwise("unavailable")
    listed = F.when(size % 8 == 0, "").when(size % 5 == 0, "click;ghost").otherwise("click;view")
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("p_name")).alias("indicator_key"), status.alias("status"), listed.alias("sources"))
    return compare.validate_inventory(rows, releases(spark), ["verified", "partial", "unavailable"])


@query("ingest_union", sql("""WITH u AS (SELECT 'early' AS input_dataset, source_record_id, value_lexeme, domain AS domain_key, observation_id FROM fact WHERE arrival_order <= 3
        UNION ALL SELECT 'late', source_record_id, value_lexeme, domain, observation_id FROM fact WHERE arrival_order > 3)
    SELECT input_dataset, observation_id, CASE domain_key WHEN 'd4' THEN NULL ELSE 'D-' || domain_key END AS domain, 'batch-1' AS ingestion_batch_id, CASE WHEN domain_key = 'd4' THEN 'unmapped' END AS problem FROM u""", "fact"))  # fmt: skip
def ingest_union(spark, d):
    rows = fact(spark, d).withColumnRenamed("domain", "domain_key")
    domains = spark.sql("SELECT * FROM VALUES ('d0', 'D-d0'), ('d1', 'D-d1'), ('d2', 'D-d2'), ('d3', 'D-d3') AS t(domain_key, domain)")
    out = compare.ingest_union({"early": rows.where("arrival_order <= 3"), "late": rows.where("arrival_order > 3")}, domains, "batch-1", ["observation_id"])
    return out.select("input_dataset", "observation_id", "domain", "ingestion_batch_id", "problem")


@query("ingestion_inventory", sql("SELECT domain, source_id, geo_level, count(*) AS rows, count(DISTINCT indicator_key) AS indicators, min(observed_period) AS first_period, max(observed_period) AS last_period FROM fact GROUP BY 1, 2, 3", "fact"))
def ingestion_inventory(spark, d):
    return compare.ingestion_inventory(fact(spark, d), ["domain", "source_id", "geo_level"])


RULES = (
    ("difference", "small", "rounding", "last_digit", "confirmed"),
    ("difference", "large", "revision_candidate", "revision", "candidate"),
    ("difference", "changed", "published_release_change", "revision", "confirmed"),
    ("granularity", "gap", "granularity", "aggregation", "confirmed"),
)
_RULES = ", ".join(str(r) for r in RULES)
_EVENTS = f"""{_SPARSE}, {_HIER}, rules AS (SELECT * FROM (VALUES {_RULES}) t(input_kind, input_label, classification, cause_family, evidence_level)),
    raw AS (SELECT 'difference' AS input_kind, CASE WHEN spread <= 100 THEN 'small' WHEN p.value <> q.value THEN 'changed' ELSE 'large' END AS input_label, observed_period || '|' || geo_code AS key
        FROM compared LEFT JOIN (SELECT observed_period, geo_code, value FROM fact WHERE source_id = 'purchase') p USING (observed_period, geo_code) LEFT JOIN (SELECT observed_period, geo_code, value FROM fact WHERE source_id = 'signup') q USING (observed_period, geo_code)
        WHERE status = 'value_mismatch'
        UNION ALL SELECT 'granularity', 'gap', r_name || '|' || c_mktsegment FROM h JOIN p USING (r_name, c_mktsegment) GROUP BY r_name, c_mktsegment, p.value HAVING round(CAST(p.value AS DOUBLE) - CAST(sum(h.value) AS DOUBLE) / count(*), 4) <> 0
        UNION ALL SELECT 'coverage', 'single', observed_period || '|' || geo_code FROM compared WHERE status = 'single_source'),
    ev AS (SELECT input_kind, input_label, key, substr(sha256(concat_ws(chr(31), input_kind, input_label, key)), 1, 20) AS event_id, coalesce(classification, 'missing_rule') AS classification, cause_family, evidence_level
           FROM raw LEFT JOIN rules USING (input_kind, input_label))"""  # fmt: skip


def _events(spark, d):
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS t(input_kind, input_label, classification, cause_family, evidence_level)")
    compared = compare.compare_sparse(observations(spark, d)).withColumn("key", F.concat_ws("|", "observed_period", "geo_code"))
    differ = compared.where("status = 'value_mismatch'").withColumn("label", F.when(F.col("spread") <= 100, "small").otherwise("large"))
    gaps = compare.granularity_report(_hierarchy(spark, d), ["r_name", "c_mktsegment"], "region", "nation").withColumn("label", F.lit("gap")).withColumn("key", F.concat_ws("|", "r_name", "c_mktsegment"))
    single = compared.where("status = 'single_source'").withColumn("label", F.lit("single"))
    return compare.classify_events(compare.release_change(differ, "large", "changed", ("purchase", "signup")), gaps, single, rules)


@query("classify_events", sql(f"WITH {_EVENTS} SELECT event_id, input_kind, input_label, key, classification, cause_family, evidence_level FROM ev", "fact"))
def classify_events(spark, d):
    return _events(spark, d)


@query("missing_rules", sql(f"WITH {_EVENTS} SELECT input_kind, input_label, count(*) AS events FROM ev WHERE classification = 'missing_rule' GROUP BY 1, 2", "fact"))
def missing_rules(spark, d):
    return compare.missing_rules(_events(spark, d))


@query("classification_summary", sql(f"WITH {_EVENTS} SELECT classification, cause_family, evidence_level, count(*) AS events FROM ev GROUP BY 1, 2, 3", "fact"))
def classification_summary(spark, d):
    return compare.classification_summary(_events(spark, d), ["classification", "cause_family", "evidence_level"])


@query("gate_metrics", sql(f"""WITH {_EVENTS}, m AS (SELECT 'd' || CAST(length(key) % 5 AS VARCHAR) AS domain, coalesce(cause_family IN ('revision', 'last_digit'), false) AS core, coalesce(evidence_level = 'confirmed', false) AS conf FROM ev),
    g AS (SELECT CAST(count(DISTINCT domain) AS DOUBLE) AS d, round(avg(CAST(core AS INT)), 4) AS c, round(avg(CAST(core AND conf AS INT)), 4) AS cc, CAST(count(*) FILTER (conf) AS DOUBLE) AS t FROM m)
    SELECT 'mismatch_domains' AS criterion, d AS value, d >= 3 AS passed FROM g UNION ALL SELECT 'core_share', c, c >= 0.7 FROM g UNION ALL SELECT 'confirmed_core_share', cc, cc >= 0.7 FROM g UNION ALL SELECT 'direct_traces', t, t >= 1 FROM g""", "fact"))  # fmt: skip
def gate_metrics(spark, d):
    rows = _events(spark, d).withColumn("domain", F.concat(F.lit("d"), (F.length("key") % 5).cast("string"))).fillna("", ["cause_family", "evidence_level"])
    return compare.gate_metrics(rows, ["revision", "last_digit"])


@query("promote_evidence", sql(f"""WITH {_EVENTS}, x AS (SELECT event_id, classification, substr(event_id, 1, 1) < '8' AS reviewed, classification = 'revision_candidate' AND substr(event_id, 2, 1) >= '4' AND substr(event_id, 3, 1) >= '4' AS may FROM ev)
    SELECT event_id, CASE WHEN reviewed AND may THEN 'confirmed_revision' ELSE classification END AS classification, classification AS original_classification, reviewed AND NOT may AS refused FROM x""", "fact"))  # fmt: skip
def promote_evidence(spark, d):
    """Evidence for half of the events; some of it names no reference, and some a source that is the event's own."""
    rows = _events(spark, d).withColumn("sources", F.array(F.lit("purchase"), F.lit("signup")))
    digit = lambda i: F.substring("event_id", i, 1)
    evidence = rows.where(digit(1) < "8").select("event_id", F.lit("confirmed_revision").alias("promoted_classification"), F.when(digit(2) >= "4", "annex").alias("reference"), F.when(digit(3) >= "4", "bulletin").otherwise("signup").alias("source_id"))
    return compare.promote_evidence(rows, evidence).select("event_id", "classification", "original_classification", "refused")


@query("revision_traces", sql(f"""WITH {_SPARSE}, e AS (SELECT observed_period, geo_code FROM compared WHERE status = 'value_mismatch')
    SELECT observed_period || '|' || geo_code AS event_id, CAST(row_number() OVER (PARTITION BY observed_period, geo_code ORDER BY f.source_id) AS BIGINT) AS vintage_order, f.source_id, value_lexeme FROM e JOIN fact f USING (observed_period, geo_code)""", "fact"))  # fmt: skip
def revision_traces(spark, d):
    rows = observations(spark, d)
    sources = F.sort_array(F.collect_list("source_id"))  # bounded by the number of sources
    events = rows.groupBy("observed_period", "geo_code").agg(sources.alias("sources"), F.count_distinct("value").alias("n")).where("n > 1").withColumn("event_id", F.concat_ws("|", "observed_period", "geo_code"))
    out = compare.revision_traces(events, rows.select("observed_period", "geo_code", "source_id", "value_lexeme"), ["observed_period", "geo_code"])
    return out.select("event_id", F.col("vintage_order").cast("long").alias("vintage_order"), "source_id", "value_lexeme")


@query("cause_distribution", sql(f"WITH {_EVENTS} SELECT cause_family, count(*) AS events, round(count(*) / (SELECT count(*) FROM ev), 4) AS share FROM ev GROUP BY 1", "fact"))
def cause_distribution(spark, d):
    return compare.cause_distribution(_events(spark, d))


def _lexical(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    titles = table(spark, d, "pages").select(F.col("page_id").alias("title_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return queries, titles


_WORDS = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ('', " + ", ".join(f"'{w}'" for w in lexical.STOPWORDS) + "))"


@query("token_coverage", f"""WITH q AS (SELECT item_id AS query_id, {_WORDS.format("text")} AS words FROM benchmark), t AS (SELECT page_id AS title_id, {_WORDS.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS words FROM pages),
    a AS (SELECT query_id, len(words) AS n, unnest(words) AS word FROM q), b AS (SELECT title_id, unnest(words) AS word FROM t)
    SELECT query_id, title_id, count(*) / any_value(n) AS coverage FROM a JOIN b USING (word) GROUP BY 1, 2""")  # fmt: skip
def token_coverage(spark, d):
    return lexical.token_coverage(*_lexical(spark, d))


@query("lexical_candidates")
def lexical_candidates(spark, d):
    return lexical.lexical_candidates(*_lexical(spark, d), k=5)


@query("inventory_summary", sql(f"WITH {_SPARSE} SELECT domain, status, count(*) AS n FROM compared GROUP BY 1, 2", "fact"))
def inventory_summary(spark, d):
    return compare.inventory_summary(_compared(spark, d), ["domain", "status"])
