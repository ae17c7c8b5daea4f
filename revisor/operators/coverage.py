"""What the listed dimensions and values of variables, and publications, prove of an indicator's areas and years.

A variable's payload lists its units, categories, years and periods, whether or not a
value stands where they meet.  Years of variables and spans of publications are joined
as intervals: in order of their starts, a year is covered if the largest end so far is
not before it, so no year is compared with each interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.functions.identity import geo_level, year_of

#: Levels of areas from the widest, names of a whole year as a period, and of no category (fixed values; the caller may pass others).
LEVELS = ("national", "province", "regency")
ANNUAL = ("Tahun", "Tahunan")
NO_CATEGORY = "Tidak ada"
DIMENSIONS = ("unit", "category", "year", "period")


def profile_variable(cells: DataFrame, listed: DataFrame, by: list[str], no_category: str = NO_CATEGORY) -> DataFrame:
    """Listed and filled cells of each variable, its levels, years and their gaps, kinds of period and last update.

    ``cells``: a row for each value, with ``updated``.  ``listed``: a row for each entry
    of a response's dimension (``response``, ``dimension``, ``code``, ``label``), where
    ``dimension`` is unit, category, year or period, or ``unit_name`` for what the units
    are.  A response has as many cells as its dimensions' entries multiply to; those
    that may be absent count as one.  Units that are no areas are a breakdown of a
    national series.
    """
    d = F.col("dimension")
    entries = listed.groupBy(*by, "response").agg(*(F.count_if(d == n).alias(n) for n in DIMENSIONS))
    one = lambda n: F.greatest(F.col(n), F.lit(1))
    possible = entries.groupBy(*by).agg(F.sum(F.col("unit") * one("category") * F.col("year") * one("period")).alias("expected_cells"))
    level = geo_level(F.col("code").cast("long"))
    areas = {n: F.count_distinct(F.when((d == "unit") & (level == n), F.col("code"))).alias(f"{n}_units") for n in LEVELS}
    names = lambda when, what: F.sort_array(F.collect_set(F.when(when, what)))
    found = listed.groupBy(*by).agg(
        F.count_distinct(F.when(d == "unit", F.col("code"))).alias("units"),
        *areas.values(),
        names(d == "unit_name", F.nullif(F.trim("label"), F.lit(""))).alias("unit_names"),
        names((d == "category") & (F.col("label") != no_category), F.col("label")).alias("categories"),
        names(d == "period", F.trim("label")).alias("period_types"),
        names(d == "year", year_of(F.col("label"))).alias("years"),  # bounded by the years of a calendar
    )
    filled = cells.groupBy(*by).agg(F.count("*").alias("observed_cells"), F.max("updated").alias("last_update"))
    rows = found.join(possible, by).join(filled, by, "left")
    no_area = sum((F.col(f"{n}_units") for n in LEVELS), F.lit(0)) == 0
    breakdown = no_area & (F.col("units") > 0)
    levels = F.filter(F.array(*(F.when(F.col(f"{n}_units") > 0, n) for n in LEVELS)), lambda x: x.isNotNull())
    first, last = F.element_at("years", 1), F.element_at("years", -1)
    gaps = F.when(F.size("years") > 0, F.array_except(F.sequence(first, last), F.col("years"))).otherwise(F.col("years"))
    observed = F.coalesce("observed_cells", F.lit(0))
    return rows.select(
        *by,
        F.when(breakdown, F.array(F.lit(LEVELS[0]))).otherwise(levels).alias("levels"),
        F.when(breakdown, 1).otherwise(F.col("national_units")).cast("long").alias("national_units"),
        "province_units",
        "regency_units",
        F.when(breakdown & (F.col("units") > 1), F.col("unit_names")).otherwise(F.array().cast("array<string>")).alias("breakdowns"),
        "categories",
        "period_types",
        "years",
        gaps.alias("year_gaps"),
        observed.alias("observed_cells"),
        "expected_cells",
        F.round(observed / F.nullif("expected_cells", F.lit(0)), 4).alias("density"),
        "last_update",
    )


def open_gaps(gaps: DataFrame, intervals: DataFrame, by: str) -> DataFrame:
    """The years of ``gaps`` (by, year) that no interval (by, first_year, last_year) covers, each once."""
    spans = intervals.groupBy(by, F.col("first_year").alias("year")).agg(F.max("last_year").alias("until"))  # a row for each year of a calendar
    both = spans.withColumn("gap", F.lit(False)).unionByName(gaps.select(by, "year").distinct().withColumn("gap", F.lit(True)), allowMissingColumns=True)
    reach = F.max("until").over(Window.partitionBy(by).orderBy("year", "gap").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("reach", reach).where(F.col("gap") & ~F.coalesce(F.col("reach") >= F.col("year"), F.lit(False))).select(by, "year")


def derive_status(missing: Column, evidence: Column) -> Column:
    """unavailable without evidence, partial if proposed levels are missing (all of them or some), else verified."""
    return F.when(evidence == 0, "unavailable").when(missing > 0, "partial").otherwise("verified")


def _reason(status: Column, missing: Column) -> Column:
    return F.when(status == "unavailable", "no_exact_free_series_confirmed").when(missing > 0, "geography_shortfall").when(status == "partial", "derivation_required").otherwise("free_source_confirmed_full_geography")


def indicator_coverage(inventory: DataFrame, mapped: DataFrame, profiles: DataFrame, publications: DataFrame, variable: list[str], source: str, minimum_span: int, derived: tuple[str, ...] = (), annual: tuple[str, ...] = ANNUAL) -> DataFrame:
    """For each indicator what its variables and publications prove, its status with the reason, and flags for what they lack.

    ``inventory``: indicator_key, proposed, proposed_sources (arrays).  ``mapped``:
    indicator_key and the columns ``variable``, which may name variables without a
    profile.  ``publications``: indicator_key, source_id, levels (array), first_year,
    last_year.  ``source`` is the one that the profiles are of; ``derived`` are
    indicators that need a transformation before a variable can be called theirs.
    """
    key, none = "indicator_key", F.array().cast("array<string>")
    keys = mapped.groupBy(key).agg(F.count("*").alias("variables"))
    own = mapped.join(profiles, variable)
    sets = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    by_profile = own.groupBy(key).agg(
        F.count("*").alias("profiles"), sets("levels").alias("own_levels"), sets("period_types").alias("period_types"), F.sum("observed_cells").alias("observed_cells"), F.max("last_update").alias("last_update")
    )
    by_publication = publications.groupBy(key).agg(F.collect_set("source_id").alias("sources"), sets("levels").alias("published_levels"))
    points = own.select(key, F.explode("years").alias("first_year")).withColumn("last_year", F.col("first_year"))
    spans = publications.where("first_year IS NOT NULL AND last_year >= first_year").select(key, "first_year", "last_year")
    intervals = points.unionByName(spans)
    ends = intervals.groupBy(key).agg(F.min("first_year").alias("period_start"), F.max("last_year").alias("period_end"))
    gaps = open_gaps(own.select(key, F.explode("year_gaps").alias("year")), intervals, key)
    gaps = gaps.groupBy(key).agg(F.sort_array(F.collect_list("year")).alias("period_gaps"))
    rows = inventory
    for part in (keys, by_profile, by_publication, ends, gaps):
        rows = rows.join(part, key, "left")
    c = lambda name, other: F.coalesce(F.col(name), other)
    levels = F.array_union(c("own_levels", none), c("published_levels", none))
    observed = c("observed_cells", F.lit(0))
    rows = rows.select(
        *inventory.columns,
        c("variables", F.lit(0)).alias("variables"),
        F.filter(F.array(*map(F.lit, LEVELS)), lambda x: F.array_contains(levels, x)).alias("verified"),
        ((observed > 0).cast("int") + F.size(c("sources", none))).alias("evidence"),
        c("profiles", F.lit(0)).alias("profiles"),
        "period_start",
        "period_end",
        c("period_gaps", F.array().cast("array<int>")).alias("period_gaps"),
        c("period_types", none).alias("period_types"),
        observed.alias("observed_cells"),
        "last_update",
    )
    missing = F.size(F.array_except("proposed", "verified"))
    proved = derive_status(missing, F.col("evidence"))
    needs = F.col(key).isin(list(derived)) & (F.col("evidence") > 0)
    status = F.when(needs & (proved == "verified"), "partial").otherwise(proved)
    flags = {  # in the order of their names
        "derivation_required": needs,
        "geography_shortfall": (missing > 0) & (F.col("evidence") > 0),
        "multi_variable": F.col("variables") > 1,
        "period_gap": F.size("period_gaps") > 0,
        "short_series": F.coalesce(F.col("period_end") - F.col("period_start") + 1 < minimum_span, F.lit(False)),
        "subannual_periods": (F.size("period_types") > 1) | F.exists("period_types", lambda p: ~p.isin(list(annual))),
        "webapi_found_unproposed": (F.col("profiles") > 0) & ~F.array_contains("proposed_sources", source),
    }
    named = F.array_join(F.filter(F.array(*(F.when(v, n) for n, v in flags.items())), lambda f: f.isNotNull()), ";")
    return rows.select(key, "variables", F.array_join("verified", ";").alias("verified_levels"), "period_start", "period_end", F.array_join("period_gaps", ";").alias("period_gaps"), "observed_cells", "last_update", status.alias("status"), _reason(status, missing).alias("reason"), named.alias("flags"))
