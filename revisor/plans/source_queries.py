"""Queries over scans and sinks.  Files are derived from the given tables and written to a shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revisor.operators.strategies import full_snapshots, incremental_serving, overwrite_state, resolve_cells
from revisor.plans.bridge import RELEASES, fact, releases, sql, table
from revisor.plans.registry import query
from revisor.sources import files, versions
from revisor.streaming import arrivals

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]


def _csv(spark, d):
    path = files.scratch(spark, "csv")
    table(spark, d, "customer").select(*(F.col(c).cast("string") for c in _CUSTOMER)).write.option("header", True).csv(path)
    return path


@query("scan_strict_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def scan_strict_csv(spark, d):
    return files.scan_strict_csv(spark, _csv(spark, d), _CUSTOMER, ["c_custkey"]).drop("c_acctbal")


@query("scan_typed_projection", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def scan_typed_projection(spark, d):
    staged = files.scan_strict_csv(spark, _csv(spark, d), _CUSTOMER, _CUSTOMER)
    return files.typed(staged, {"c_custkey": "long", "c_name": "string", "c_nationkey": "long", "c_acctbal": "double"})


def _payloads(spark, d):
    """JSON cubes, one for each segment: nations (code hundred times the key and one) by status by year."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = (1100 + F.col("n_nationkey") * 100).cast("string")
    cells = o.groupBy("c_mktsegment", code.alias("area"), F.col("n_name").alias("area_name"), F.col("o_orderstatus").alias("cat"), F.year("o_orderdate").cast("string").alias("year")).agg(F.count("*").cast("string").alias("n"))
    dims = lambda v, label: F.array_sort(F.collect_set(F.struct(F.col(v).alias("val"), F.col(label).alias("label"))))
    by = cells.groupBy("c_mktsegment").agg(
        dims("area", "area_name").alias("vervar"), dims("cat", "cat").alias("turvar"), dims("year", "year").alias("tahun"),
        F.map_from_entries(F.collect_list(F.struct(F.concat("area", F.lit("7"), "cat", "year", F.lit("0")), "n"))).alias("datacontent"),
    )
    one = lambda v: F.array(F.struct(F.lit(v).alias("val"), F.lit("all").alias("label")))
    payload = F.to_json(F.struct("vervar", one("7").alias("var"), "turvar", "tahun", one("0").alias("turtahun"), "datacontent", F.lit("2024-02-01").alias("last_update")))
    return by.select("c_mktsegment", payload.alias("payload"))


_CUBE = """cube AS (SELECT c_mktsegment, CAST(1100 + n_nationkey * 100 AS VARCHAR) AS geo_code, n_name AS geo_name, o_orderstatus AS category, CAST(year(o_orderdate) AS VARCHAR) AS observed_period, CAST(count(*) AS VARCHAR) AS value_lexeme
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, 5)"""


@query("scan_json_cube", f"WITH {_CUBE} SELECT '7' AS series_key, geo_code, geo_name, 'province' AS geo_level, category, observed_period, value_lexeme, true AS numeric FROM cube")
def scan_json_cube(spark, d):
    return files.scan_json_cube(_payloads(spark, d), F.col("payload")).drop("place", "c_mktsegment")


@query("cube_report", f"""WITH {_CUBE} SELECT c_mktsegment, count(*) + count(*) FILTER (geo_code = '1200') AS cells, count(*) FILTER (observed_period = '1995') + count(*) FILTER (observed_period = '1995' AND geo_code = '1200') AS skipped,
    2 * count(*) FILTER (geo_code = '1200') AS duplicates FROM cube GROUP BY 1""")  # fmt: skip
def cube_report(spark, d):
    """The cubes with one area listed twice, and with a dash for the numbers of one year."""
    twice = F.regexp_replace("payload", r'(\{"val":"1200","label":"[^"]*"\})', "$1,$1")
    dashed = F.regexp_replace(twice, r'("\d+7[A-Z]?\d*1995\d*"):"\d+"', '$1:"-"')
    return files.cube_report(files.scan_json_cube(_payloads(spark, d).withColumn("payload", dashed), F.col("payload")), ["c_mktsegment"])


@query("scan_json_series", f"WITH {_CUBE} SELECT observed_period, '7' AS series_key, '9999' AS geo_code, geo_name, 'national' AS geo_level, category, value_lexeme, true AS numeric FROM cube WHERE geo_code = '1100' AND category = 'F'")
def scan_json_series(spark, d):
    """The cube's areas recoded as the nation, so that its national rows are read."""
    national = _payloads(spark, d).withColumn("payload", F.regexp_replace("payload", '"1100', '"9999'))
    years = table(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("year")).distinct()
    return files.scan_json_series(national, F.col("payload"), "F", years).drop("place", "c_mktsegment")


@query("scan_json_restricted", f"""WITH {_CUBE}, w AS (SELECT DISTINCT geo_code, observed_period FROM cube WHERE category = 'F' UNION SELECT DISTINCT geo_code, '1900' FROM cube),
    f AS (SELECT geo_code, observed_period, arg_min(value_lexeme, c_mktsegment) AS value_lexeme FROM cube WHERE category = 'F' GROUP BY 1, 2)
    SELECT geo_code, observed_period, value_lexeme, value_lexeme IS NULL AS missing FROM w LEFT JOIN f USING (geo_code, observed_period)""")  # fmt: skip
def scan_json_restricted(spark, d):
    """Wanted are the nations' years of one status, and a year that no payload has; the first payload is that of the first segment."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select((1100 + F.col("n_nationkey") * 100).cast("string").alias("geo_code"), F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate").cast("string")).alias("year"))
    keys = rows.select("geo_code", F.explode(F.array("year", F.lit("1900"))).alias("observed_period")).where("observed_period is not null").distinct().withColumn("category", F.lit("F"))
    got = files.scan_json_restricted(_payloads(spark, d), F.col("payload"), keys, ["geo_code", "observed_period", "category"], ["c_mktsegment"])
    return got.select("geo_code", "observed_period", "value_lexeme", "missing")


@query("unpack_series", """SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS VARCHAR) AS value_lexeme, CAST(NULL AS VARCHAR) AS problem FROM orders GROUP BY 1, 2""")
def unpack_series(spark, d):
    yearly = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("t"))
    item = F.concat(F.col("y").cast("string"), F.lit(":"), F.col("t").cast("string"))
    packed = yearly.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(item)), "|").alias("packed"))  # an item for each year
    return files.unpack_series(packed, "packed")


@query("name_code_lookup", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS BIGINT) END AS area_code, s_acctbal < 0 AS unknown FROM supplier")
def name_code_lookup(spark, d):
    nations = table(spark, d, "nation").withColumn("n_name", F.translate("n_name", "0123456789", "ABCDEFGHIJ"))
    rows = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("<i>"), F.when(F.col("s_acctbal") < 0, "nowhere").otherwise(F.lower("n_name")), F.lit(" </i>")).alias("printed"))
    areas = nations.select(F.col("n_name").alias("area_name"), F.col("n_nationkey").cast("long").alias("area_code"))
    return files.name_code_lookup(rows, "printed", areas).select("s_suppkey", "area_code", "unknown")


_TOKEN = "CASE WHEN l_linenumber = 7 THEN '…' WHEN l_quantity < 3 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || '1' ELSE replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END"


@query("modal_precision_split", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, replace({_TOKEN}, ',', '.') AS p FROM lineitem),
    n AS (SELECT *, CASE WHEN p <> '…' THEN length(split_part(p, '.', 2)) END AS dec FROM t),
    m AS (SELECT l_returnflag, dec AS modal FROM (SELECT l_returnflag, dec, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, dec) AS r FROM n WHERE dec IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
    SELECT l_orderkey, l_linenumber, CASE WHEN p <> '…' THEN substr(p, 1, length(p) - greatest(dec - modal, 0)) END AS value,
           CASE WHEN p = '…' THEN 'not_published' WHEN dec > modal THEN 'footnote_' || substr(p, length(p) - (dec - modal) + 1) END AS note FROM n JOIN m USING (l_returnflag)""")  # fmt: skip
def modal_precision_split(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.expr(_TOKEN.replace("VARCHAR", "STRING")).alias("token"))
    return files.modal_precision_split(rows, "l_returnflag", "token").select("l_orderkey", "l_linenumber", "value", "note")


@query("verify_manifest", """WITH f AS (SELECT o_custkey % 40 AS k, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) || chr(10)) AS sha, count(*) AS n FROM orders GROUP BY 1),
    m AS (SELECT k, CASE WHEN k % 10 = 3 THEN sha256(sha) ELSE sha END AS listed, CASE WHEN k % 10 = 4 THEN n + 1 ELSE n END AS listed_n FROM f WHERE k % 10 <> 5 UNION ALL SELECT k + 1000, sha, n FROM f WHERE k < 5)
    SELECT 'k=' || CAST(k AS VARCHAR) AS name, CASE WHEN sha IS NULL THEN 'missing' WHEN listed IS NULL THEN 'unlisted' WHEN sha <> listed THEN 'drifted' WHEN n <> listed_n THEN 'rows_differ' ELSE 'ok' END AS status FROM f FULL JOIN m USING (k)""")  # fmt: skip
def verify_manifest(spark, d):
    """Text files of order keys against a manifest with drifted digests, wrong counts, files that are not there and files it does not list."""
    path = files.scratch(spark, "manifest")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k"), "o_orderkey")
    rows.repartition("k").sortWithinPartitions("k", "o_orderkey").select("k", F.col("o_orderkey").cast("string").alias("value")).write.partitionBy("k").text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    counts = spark.read.text(path).groupBy(name.alias("name")).agg(F.count("*").alias("rows"))
    found = files.file_digests(spark, path, "*.txt", parts=2).withColumn("name", F.split_part("name", F.lit("/"), F.lit(1))).join(counts, "name")
    k = F.split_part("name", F.lit("="), F.lit(2)).cast("int")
    planted = found.where(k % 10 != 5).withColumn("sha256", F.when(k % 10 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256"))).withColumn("rows", F.when(k % 10 == 4, F.col("rows") + 1).otherwise(F.col("rows")))
    gone = found.where(k < 5).withColumn("name", F.concat(F.lit("k="), k + 1000))
    return files.verify_manifest(found, planted.unionByName(gone))


@query("write_manifested", "SELECT 'output' AS kind, l_returnflag AS part, count(*) AS rows FROM lineitem GROUP BY 2 UNION ALL SELECT 'input', NULL, count(*) FROM lineitem")
def write_manifested(spark, d):
    made = files.write_manifested(table(spark, d, "lineitem"), files.scratch(spark, "manifested"), by="l_returnflag")
    return made.groupBy("kind", "part").agg(F.sum("rows").alias("rows"))


@query("batch_id", sql("SELECT substr(sha256(string_agg(source_id || '=' || manifest_sha256, ';' ORDER BY source_id)), 1, 20) AS batch_id FROM releases JOIN (SELECT DISTINCT source_id FROM fact) USING (source_id)", "fact"))
def batch_id(spark, d):
    seen = fact(spark, d).select("source_id").distinct()
    return files.batch_id(releases(spark).join(seen, "source_id").select(F.col("source_id").alias("name"), F.col("manifest_sha256").alias("sha256")))


@query("publish_batch", "SELECT count(*) AS rows, count(*) AS read_rows, true AS verified FROM orders")
def publish_batch(spark, d):
    return files.publish_batch(table(spark, d, "orders"), files.scratch(spark, "publish"), "b1")


@query("partitioned_sink", sql("SELECT domain, count(*) AS rows, count(DISTINCT cell_id) AS cells FROM fact GROUP BY 1", "fact"))
def partitioned_sink(spark, d):
    path = files.scratch(spark, "domains")
    files.partitioned_sink(fact(spark, d), "domain", path)
    return spark.read.parquet(path).groupBy("domain").agg(F.count("*").alias("rows"), F.count_distinct("cell_id").alias("cells"))


LAST = len(RELEASES)


def _state(rows, order):
    """What is served after a release."""
    return overwrite_state(rows.where(F.col("arrival_order") <= order)).select("cell_id", "observation_id")


def _versions(spark, d):
    """The state after each release as a partition of one table."""
    path = files.scratch(spark, "versions")
    full_snapshots(fact(spark, d), LAST).select("cell_id", "observation_id", F.col("snapshot_order").cast("long").alias("version")).write.partitionBy("version").parquet(path)
    return path


@query("overwrite_table", sql("SELECT CAST(snapshot_order AS BIGINT) AS release, cell_id, observation_id FROM states", "states"))
def overwrite_table(spark, d):
    """Each release overwrites one table with the state after it; the table as it is found after each."""
    path, seen, rows = files.scratch(spark, "overwritten"), files.scratch(spark, "seen"), files.written(fact(spark, d), "fact")
    for order in range(1, LAST + 1):
        _state(rows, order).write.mode("overwrite").parquet(path)
        spark.read.parquet(path).write.parquet(f"{seen}/release={order}")
    return spark.read.parquet(seen).select(F.col("release").cast("long").alias("release"), "cell_id", "observation_id")


@query("append_table", sql("SELECT cell_id, observation_id FROM fact", "fact"))
def append_table(spark, d):
    path, rows = files.scratch(spark, "append"), fact(spark, d)
    for order in range(1, LAST + 1):
        rows.where(F.col("arrival_order") == order).select("cell_id", "observation_id").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("truncate", sql("SELECT (SELECT count(*) FROM current) AS before, CAST(0 AS BIGINT) AS after FROM fact LIMIT 1", "fact", "current"))
def truncate(spark, d):
    path, rows = files.scratch(spark, "truncated"), _state(fact(spark, d), LAST)
    rows.write.parquet(path)
    before = files.written(spark.read.parquet(path).agg(F.count("*").alias("before")), "before")
    rows.limit(0).write.mode("overwrite").parquet(path)
    return before.crossJoin(spark.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("after")))  # one row each


@query("drop_purge", sql("SELECT CAST(snapshot_order AS BIGINT) AS version, count(*) AS rows, true AS dropped FROM states GROUP BY 1", "states"))
def drop_purge(spark, d):
    """The rows by version of a catalog table before it is dropped, and whether the catalog has lost it."""
    name = f"dropped_{uuid.uuid4().hex}"
    spark.read.parquet(_versions(spark, d)).write.option("path", files.scratch(spark, "dropped")).saveAsTable(name)
    rows = files.written(spark.table(name).groupBy("version").agg(F.count("*").alias("rows")), "rows")
    spark.sql(f"DROP TABLE {name} PURGE")
    left = spark.sql(f"SHOW TABLES LIKE '{name}'").agg((F.count("*") == 0).alias("dropped"))
    return rows.crossJoin(left)  # one row


@query("snapshot_read", sql("SELECT cell_id, observation_id, CAST(snapshot_order AS BIGINT) AS version FROM states", "states"))
def snapshot_read(spark, d):
    """The state as of the date of every release, each read by its date."""
    dates = releases(spark).select("vintage_date", F.col("arrival_order").cast("long").alias("version"))
    found = versions.versions_asof(spark, _versions(spark, d), dates, dates.select(F.col("vintage_date").alias("when")))
    return found.select("cell_id", "observation_id", F.col("version").cast("long").alias("version"))


@query("snapshot_union", sql("SELECT cell_id, observation_id, CAST(snapshot_order AS BIGINT) AS version FROM states", "states"))
def snapshot_union(spark, d):
    """All retained states with their order."""
    return spark.read.parquet(_versions(spark, d)).select("cell_id", "observation_id", F.col("version").cast("long").alias("version"))


@query("expire_versions", sql(f"SELECT cell_id, observation_id, CAST(snapshot_order AS BIGINT) AS version FROM states WHERE snapshot_order > {LAST - 2}", "states"))
def expire_versions(spark, d):
    path = _versions(spark, d)
    versions.expire_versions(spark, path, keep=2)
    return spark.read.parquet(path).select("cell_id", "observation_id", F.col("version").cast("long").alias("version"))


def _bucketed(spark, rows, name):
    return versions.write_bucketed(rows, f"{name}_{uuid.uuid4().hex}", files.scratch(spark, name), 8)


@query("colocated_serving", sql("""SELECT cell_id, arg_max(observation_id, arrival_order) AS observation_id, count(*) AS vintage_count, count(*) FILTER (prev_value <> value) AS value_revision_count,
    CAST(max(CASE WHEN arrival_order = 5 THEN 5 ELSE 4 END) AS BIGINT) AS recomputed_at_arrival FROM hist GROUP BY 1""", "hist"))  # fmt: skip
def colocated_serving(spark, d):
    """Store and serving state bucketed by cell; the last arrival resolves its cells anew and leaves the others."""
    rows = fact(spark, d)
    store = _bucketed(spark, rows, "store")
    before = resolve_cells(rows.where("arrival_order < 5")).withColumn("recomputed_at_arrival", F.lit(4).cast("long"))
    serving = _bucketed(spark, before, "serving")
    after = incremental_serving(serving, store, rows.where("arrival_order = 5"), 5)
    return after.select("cell_id", "observation_id", "vintage_count", "value_revision_count", "recomputed_at_arrival")


@query("reached_rows", sql("SELECT cell_id, observation_id FROM fact WHERE cell_id IN (SELECT cell_id FROM fact WHERE arrival_order = 5 AND geo_code LIKE '1%')", "fact"))
def reached_rows(spark, d):
    """Rows of a stored fact whose cells some rows of the last arrival touch."""
    path = files.scratch(spark, "store")
    fact(spark, d).write.parquet(path)
    store = spark.read.parquet(path)
    return versions.reached_rows(store, store.where("arrival_order = 5 AND geo_code LIKE '1%'")).select("cell_id", "observation_id")


@query("file_inventory", "SELECT 'lineitem' AS name, true AS sized, count(*) AS rows FROM lineitem UNION ALL SELECT 'orders', true, count(*) FROM orders")
def file_inventory(spark, d):
    each = [files.file_inventory(spark, f"{d}/{t}.parquet").agg((F.min("size") > 0).alias("sized"), F.sum("rows").alias("rows")).select(F.lit(t).alias("name"), "sized", "rows") for t in ("lineitem", "orders")]
    return each[0].unionByName(each[1])


@query("orphan_files", """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_size AS BIGINT) * 1024 AS size FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def orphan_files(spark, d):
    listing = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size").cast("long") * 1024).alias("size"), F.col("p_size").alias("modified"))
    referenced = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").cast("string").alias("path"))
    return files.orphan_files(listing.withColumn("modified", -F.col("modified")), referenced, F.lit(-10)).select("path", "size")


# ---------------------------------------------------------------- streaming


def _arrival_folder(spark, d, times=1):
    path = files.scratch(spark, "arrivals")
    rows = fact(spark, d).select("cell_id", "observation_id", "vintage_id", "value", "value_lexeme", "vintage_date", "retrieved_at", "arrival_order")
    for _ in range(times):
        rows.repartition("arrival_order").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("stream_arrivals", sql("""SELECT cell_id, arg_max(observation_id, arrival_order) AS observation_id, arg_max(value_lexeme, arrival_order) AS value_lexeme, count(*) AS vintage_count,
    count(*) FILTER (prev_value <> value) AS value_revision_count FROM hist GROUP BY 1""", "hist"))  # fmt: skip
def stream_arrivals(spark, d):
    """What the log of revisions serves after all releases, of which each arrives twice."""
    log = files.scratch(spark, "revisions")
    arrivals.stream_arrivals(_arrival_folder(spark, d, times=2), log, files.scratch(spark, "progress")).awaitTermination()
    return arrivals.serving(spark.read.parquet(log)).select("cell_id", "observation_id", "value_lexeme", "vintage_count", "value_revision_count")


@query("stream_latest", sql("SELECT cell_id, arg_max(observation_id, arrival_order) AS observation_id, arg_max(value_lexeme, arrival_order) AS value_lexeme FROM fact GROUP BY 1", "fact"))
def stream_latest(spark, d):
    """The running latest, written by an update-mode stream; the last row of each cell in the sink is the answer."""
    sink = files.scratch(spark, "latest")

    def put(batch, batch_id):
        batch.write.parquet(f"{sink}/batch_id={batch_id}", mode="overwrite")

    found = arrivals.stream_latest(_arrival_folder(spark, d))
    found.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", files.scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).groupBy("cell_id").agg(F.max_by(F.struct("observation_id", "value_lexeme"), "batch_id").alias("v")).select("cell_id", "v.*")
