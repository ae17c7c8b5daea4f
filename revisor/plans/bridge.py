"""The given tables as observations, releases and the other inputs of the operators, in Spark and in SQL.

``sql(body, *names)`` puts the common table expressions of the same names before a body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisor.functions.identity import decimal_places, identity
from revisor.operators.lineage import NODES
from revisor.operators.model import with_releases

#: source, release date, role, format, publisher, status: five sources.
RELEASES = (
    ("click", "2024-02-01", "indicator_values_and_definitions", "json", "office", "active"),
    ("error", "2024-02-02", "indicator_values", "pdf", "office", "active"),
    ("purchase", "2024-02-03", "indicator_values_and_definitions", "csv", "office", "active"),
    ("signup", "2024-02-04", "indicator_values_and_definitions", "csv", "office", "active"),
    ("view", "2024-02-05", "indicator_values", "json", "agency", "paused"),
)
AUTHORITY = "office"
SIZES = (1, 2, 4, 8, 16, 38)
#: Columns that stand for the batch, run and version of an observation, which the given tables lack.
LINEAGE = NODES | {"ingestion_batch": ("vintage_date",), "transformation_run": ("vintage_date", "domain"), "transformation_version": ("unit",)}
SEED = "20260912"

_REL = ", ".join(f"('{s}', DATE '{d}', TIMESTAMP '{d} 01:00:00', {i}, '{role}', '{form}', '{publisher}', '{status}')" for i, (s, d, role, form, publisher, status) in enumerate(RELEASES, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def releases(spark: SparkSession) -> DataFrame:
    """One row for each release; the table is as long as RELEASES."""
    rows = spark.sql(f"SELECT * FROM VALUES {_REL} AS t(source_id, vintage_date, retrieved_at, arrival_order, role, format, publisher, status)")
    sha = F.sha2(F.col("source_id"), 256)
    return rows.withColumn("manifest_sha256", sha).withColumn("vintage_id", identity("source_id", "vintage_date", "manifest_sha256"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One published value for each user, day and event type."""
    events = table(spark, sf_dir, "events")
    by = events.groupBy(
        F.col("event_type").alias("source_id"), F.date_format("ts", "yyyy-MM-dd").alias("observed_period"), F.col("user_id").cast("string").alias("geo_code")
    ).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("raw"), F.min("event_id").cast("string").alias("source_record_id"))
    value = (F.floor(F.col("raw").cast("double") / 50) * 50).cast("decimal(18,2)")
    return by.select(
        "source_id",
        F.concat(F.lit("d"), (F.col("geo_code").cast("long") % 5).cast("string")).alias("domain"),
        F.lit("value").alias("indicator_key"),
        F.lit("total").alias("series_key"),
        "observed_period",
        F.lit("user").alias("geo_level"),
        "geo_code",
        F.lit("amount").alias("unit"),
        value.alias("value"),
        value.cast("string").alias("value_lexeme"),
        "source_record_id",
    )


def released(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None) -> DataFrame:
    """Observations with their release, and ``problem`` where they have none."""
    dim = releases(spark) if dim is None else dim
    return with_releases(observations(spark, sf_dir), dim.select("source_id", "vintage_id", "vintage_date", "retrieved_at", "arrival_order"))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of known releases with their identities; ``released`` shows the others."""
    keys = ("indicator_key", "series_key", "observed_period", "geo_level", "geo_code")
    rows = released(spark, sf_dir).where("problem IS NULL").drop("problem")
    rows = rows.withColumn("cell_id", identity(*keys))
    return rows.withColumn("observation_id", identity("cell_id", "vintage_id", "source_record_id")).withColumn("places", decimal_places(F.col("value_lexeme")))


def _id(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(f'coalesce(CAST({p} AS VARCHAR), \'\')' for p in parts)})), 1, 20)"


CTES = {
    "releases": f"""SELECT *, sha256(source_id) AS manifest_sha256, {_id("source_id", "vintage_date", "sha256(source_id)")} AS vintage_id
        FROM (VALUES {_REL}) t(source_id, vintage_date, retrieved_at, arrival_order, role, format, publisher, status)""",
    "obs": """SELECT source_id, 'd' || CAST(CAST(geo_code AS BIGINT) % 5 AS VARCHAR) AS domain, 'value' AS indicator_key, 'total' AS series_key, observed_period,
               'user' AS geo_level, geo_code, 'amount' AS unit, value, CAST(value AS VARCHAR) AS value_lexeme, source_record_id
        FROM (SELECT event_type AS source_id, strftime(ts, '%Y-%m-%d') AS observed_period, CAST(user_id AS VARCHAR) AS geo_code,
                     CAST(floor(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 50) * 50 AS DECIMAL(18,2)) AS value, CAST(min(event_id) AS VARCHAR) AS source_record_id
              FROM events GROUP BY 1, 2, 3)""",
    "fact": f"""SELECT *, {_id("cell_id", "vintage_id", "source_record_id")} AS observation_id, length(split_part(value_lexeme, '.', 2)) AS places
        FROM (SELECT o.*, r.vintage_id, r.vintage_date, r.retrieved_at, r.arrival_order,
                     {_id("indicator_key", "series_key", "observed_period", "geo_level", "geo_code")} AS cell_id
              FROM obs o JOIN releases r USING (source_id))""",
    "hist": """SELECT *, lag(observation_id) OVER w AS prev_observation_id, lag(value) OVER w AS prev_value, lead(arrival_order) OVER w AS next_arrival,
                      row_number() OVER (PARTITION BY cell_id ORDER BY arrival_order DESC) AS from_last
        FROM fact WINDOW w AS (PARTITION BY cell_id ORDER BY arrival_order)""",
    "current": "SELECT * FROM hist WHERE from_last = 1",
    "states": "SELECT h.*, s.snapshot_order FROM hist h JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS snapshot_order) s ON h.arrival_order <= s.snapshot_order AND s.snapshot_order < coalesce(h.next_arrival, 6)",
    "scores": """SELECT source_id, vintage_date, trust_score, row_number() OVER (ORDER BY trust_score DESC, vintage_date DESC, source_id) AS source_rank FROM (
        SELECT r.source_id, r.vintage_date, CAST(round(0.30 * (CASE WHEN publisher = 'office' THEN 1 ELSE 0 END) + 0.20 * p.provenance
                 + 0.20 * (CASE role WHEN 'indicator_values' THEN 0.75 ELSE 1.0 END) + 0.15 * (CASE format WHEN 'pdf' THEN 0.75 ELSE 1.0 END) + 0.15 * p.cells / t.cells, 6) AS DOUBLE) AS trust_score
        FROM releases r JOIN (SELECT source_id, avg(CASE WHEN source_record_id <> '' THEN 1.0 ELSE 0.0 END) AS provenance, count(DISTINCT cell_id) AS cells FROM fact GROUP BY 1) p USING (source_id)
             CROSS JOIN (SELECT count(DISTINCT cell_id) AS cells FROM fact) t)""",
    "selected": """SELECT * FROM (SELECT f.*, s.trust_score, s.source_rank, count(*) OVER (PARTITION BY cell_id) AS candidate_count,
               f.arrival_order = max(f.arrival_order) OVER (PARTITION BY cell_id) AS selected_is_latest_vintage,
               row_number() OVER (PARTITION BY cell_id ORDER BY trust_score DESC, f.vintage_date DESC, f.source_id, observation_id) AS choice
               FROM fact f JOIN scores s USING (source_id)) WHERE choice = 1""",
}
_NEEDS = {"fact": ("obs", "releases"), "hist": ("fact",), "current": ("hist",), "states": ("hist",), "scores": ("fact", "releases"), "selected": ("fact", "scores")}


def _with(names, seen: dict[str, None]) -> dict[str, None]:
    for n in names:
        _with(_NEEDS.get(n, ()), seen)
        seen[n] = None
    return seen


def sql(body: str, *names: str) -> str:
    found = _with(names, {})
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in found)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
