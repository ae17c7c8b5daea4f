"""Scans and sinks: strict CSV, JSON cubes, packed series, manifests and partitioned tables.

Paths go through Spark's readers and writers only, so any store that Spark opens works.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from revisor.functions.identity import decimal_of, geo_level, normalise_name


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; where it is unset, a local one if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join is broadcast.
MOST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a hint to broadcast it if its rows are counted to be few; else as it is."""
    return F.broadcast(df) if df.limit(MOST_ROWS + 1).count() <= MOST_ROWS else df


def scan_strict_csv(spark: SparkSession, path: str, columns: list[str], required: list[str]) -> DataFrame:
    """CSV with a header, all strings; a row with too many or few fields fails, as does a missing column."""
    if missing := set(required) - set(columns):
        raise ValueError(f"required columns missing: {sorted(missing)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Staged strings cast to their types; a value that does not cast is an error (ANSI)."""
    return rows.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


_DIM = "array<struct<val:string,label:string>>"
CUBE = f"struct<vervar:{_DIM},var:{_DIM},turvar:{_DIM},tahun:{_DIM},turtahun:{_DIM},datacontent:map<string,string>,last_update:string>"


def scan_json_cube(rows: DataFrame, payload: str) -> DataFrame:
    """Cells of multi-dimensional payloads (JSON text): areas by categories by periods.

    A cell's number is looked up by its concatenated dimension ids; cells without a
    number are left out.  ``numeric`` says whether the text is a number, ``place`` where
    the cell stands in its payload; ``cube_report`` counts what a caller may not accept.
    """
    p = rows.withColumn("p", F.from_json(payload, CUBE)).select("*", F.col("p.var")[0]["val"].alias("variable"), F.col("p.turtahun")[0]["val"].alias("part"), "p.datacontent", "p.last_update")
    cells = p
    for dimension, name in (("vervar", "area"), ("turvar", "category"), ("tahun", "period")):
        cells = cells.select("*", F.posexplode(f"p.{dimension}").alias(f"{name}_at", name))
    key = F.concat("area.val", "variable", "category.val", "period.val", "part")
    found = cells.withColumn("value_lexeme", F.try_element_at("datacontent", key)).where("value_lexeme is not null")
    return found.select(
        *(F.col(c) for c in rows.columns if c != "payload"),
        F.col("variable").alias("series_key"),
        F.col("area.val").alias("geo_code"),
        F.col("area.label").alias("geo_name"),
        geo_level(F.col("area.val").cast("int")).alias("geo_level"),
        F.col("category.label").alias("category"),
        F.col("period.label").alias("observed_period"),
        "value_lexeme",
        decimal_of(F.col("value_lexeme")).isNotNull().alias("numeric"),
        F.struct("area_at", "category_at", "period_at").alias("place"),
    )


def cube_report(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of ``scan_json_cube`` by payload: all, those skipped for not being numeric, and those whose ids repeat."""
    ids = ["series_key", "geo_code", "category", "observed_period"]
    again = F.count("*").over(Window.partitionBy(*by, *ids)) > 1
    return cells.withColumn("again", again).groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(~F.col("numeric")).alias("skipped"), F.count_if("again").alias("duplicates"))


def scan_json_series(rows: DataFrame, payload: str, category: str, years: DataFrame) -> DataFrame:
    """National yearly values of one category, for the years wanted."""
    cube = scan_json_cube(rows, payload).where((F.col("geo_level") == "national") & (F.col("category") == category) & F.col("numeric"))
    return cube.join(years.select(F.col("year").alias("observed_period")), "observed_period", "left_semi")


def scan_json_restricted(rows: DataFrame, payload: str, wanted: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Cells that another source published: a row for each wanted key, with the first cell of it or none (``missing``).

    The first is the first in ``order`` (columns of ``rows``), then by its place in the payload.
    """
    cells = scan_json_cube(rows, payload).where("numeric")
    first = cells.join(wanted.select(keys), keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct("value_lexeme", "geo_name"), F.struct(*order, "place")).alias("first"))
    return wanted.select(keys).distinct().join(first, keys, "left").select(*keys, "first.*", F.col("first").isNull().alias("missing"))


def unpack_series(rows: DataFrame, packed: str) -> DataFrame:
    """'2018:9.00|2019:9.15' as a row for each year; ``problem`` names what is wrong with it."""
    each = rows.withColumn("item", F.explode(F.split(packed, r"\|"))).withColumn("year", F.split_part("item", F.lit(":"), F.lit(1))).withColumn("value_lexeme", F.split_part("item", F.lit(":"), F.lit(2)))
    keys = [c for c in rows.columns if c != packed]
    again = F.count("*").over(Window.partitionBy(*keys, "year"))
    problem = F.when(decimal_of(F.col("value_lexeme")).isNull(), "not_numeric").when(again > 1, "duplicate_year")
    return each.withColumn("problem", problem).drop("item", packed)


def name_code_lookup(rows: DataFrame, name: str, areas: DataFrame) -> DataFrame:
    """Codes by normalised name; ``unknown`` where no area has the name."""
    codes = areas.select(normalise_name(F.col("area_name")).alias("norm"), "area_code").dropDuplicates(["norm"])
    out = rows.withColumn("norm", normalise_name(F.col(name))).join(small(codes), "norm", "left")
    return out.withColumn("unknown", F.col("area_code").isNull()).drop("norm")


#: What is printed where a value is not (fixed values).
MISSING = ("–", "—", "…", "...", "NA")


def modal_precision_split(tokens: DataFrame, column: str, token: str) -> DataFrame:
    """A printed column's most frequent number of decimals tells values from the note digits glued to them.

    Numbers are printed with a decimal comma and points between thousands.
    """
    point = F.replace(F.replace(F.trim(token), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    mark = F.trim(token).isin(*MISSING) | F.col(token).isNull()
    rows = tokens.withColumn("point", point).withColumn("missing", mark).withColumn("decimals", F.when(~mark, F.length(F.split_part(point, F.lit("."), F.lit(2)))))
    w = Window.partitionBy(column).orderBy(F.col("n").desc(), "decimals")
    modal = rows.where("not missing").groupBy(column, "decimals").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).where("r = 1").select(column, F.col("decimals").alias("modal"))
    out = rows.join(small(written(modal, "modal")), column, "left")  # columns are few, so no task gets all rows of one
    extra = F.greatest(F.col("decimals") - F.col("modal"), F.lit(0))
    value = F.when(F.col("missing"), F.lit(None)).otherwise(F.expr("substring(point, 1, length(point) - greatest(decimals - modal, 0))"))
    note = F.when(F.col("missing"), "not_published").when(extra > 0, F.concat(F.lit("footnote_"), F.expr("substring(point, length(point) - greatest(decimals - modal, 0) + 1)")))
    return out.withColumn("value", value).withColumn("note", note).drop("point", "missing", "decimals", "modal")


def _tail(path: str, parts: int) -> Column:
    """The last parts of a path: tasks give a file the same name in each partition's folder."""
    return F.array_join(F.slice(F.split(F.col(path), "/"), -parts, parts), "/")


def file_digests(spark: SparkSession, folder: str, pattern: str, parts: int = 1) -> DataFrame:
    """name (the last ``parts`` of the path), size, sha256 of the files of a folder.

    A file is read whole, one in a task's memory at a time, and may have 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select(_tail("path", parts).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status: ok, drifted, rows_differ, missing or unlisted; both sides have name, sha256 and rows."""
    m = manifest.select("name", F.col("sha256").alias("listed"), F.col("rows").alias("listed_rows"))
    rows = found.select("name", "sha256", "rows").join(m, "name", "full_outer")
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("listed").isNull(), "unlisted")
        .when(F.col("sha256") != F.col("listed"), "drifted")
        .when(~F.col("rows").eqNullSafe(F.col("listed_rows")), "rows_differ")
        .otherwise("ok")
    )
    return rows.select("name", status.alias("status"))


def write_manifested(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write Parquet and return its manifest: kind, name, part (the value of ``by``), size, sha256, rows.

    Outputs are the files written, inputs those that ``df`` was read from, with their rows.
    """
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    spark, parts = df.sparkSession, 2 if by else 1
    name = _tail("_metadata.file_path", parts)
    part = (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("part")
    rows = spark.read.parquet(path).groupBy(name.alias("name"), part).agg(F.count("*").alias("rows"))
    out = file_digests(spark, path, "*.parquet", parts).join(rows, "name", "left").select(F.lit("output").alias("kind"), "name", "part", "size", "sha256", F.coalesce("rows", F.lit(0)).alias("rows"))
    sources = df.inputFiles()  # a name for each input file
    if not sources:
        return out
    read = spark.read.parquet(*sources).groupBy(name.alias("name"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
    return out.unionByName(read.withColumn("kind", F.lit("input")), allowMissingColumns=True)


def batch_id(manifest: DataFrame) -> DataFrame:
    """One id for a batch from the digests of its inputs, in order of name.  A manifest has a row for each file."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat_ws("=", x["name"], x["sha256"]))
    return manifest.agg(F.substring(F.sha2(F.array_join(parts, ";"), 256), 1, 20).alias("batch_id"))


def publish_batch(df: DataFrame, root: str, batch: str) -> DataFrame:
    """Write under the batch's prefix (an error if it is there) and verify what can be read back: rows and digest."""
    path = f"{root}/batch_id={batch}"
    df.write.mode("errorifexists").parquet(path)
    digest = lambda x: x.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))
    a, b = digest(df), digest(df.sparkSession.read.parquet(path).select(df.columns)).withColumnRenamed("rows", "read_rows").withColumnRenamed("digest", "read_digest")
    return a.crossJoin(b).select("rows", "read_rows", (F.col("digest").eqNullSafe(F.col("read_digest")) & (F.col("rows") == F.col("read_rows"))).alias("verified"))  # one row each


def partitioned_sink(df: DataFrame, by: str, path: str) -> None:
    """A folder for each value of a column of few values; salted, so a frequent value is written by several tasks."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(by, salt).write.partitionBy(by).parquet(path)


def file_inventory(spark: SparkSession, path: str, by: Column | None = None) -> DataFrame:
    """Files of a table: path, size, rows, from the scan's metadata columns."""
    m = F.col("_metadata")
    return spark.read.parquet(path).groupBy(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified")).agg(F.count("*").alias("rows"))


def orphan_files(listing: DataFrame, referenced: DataFrame, before: Column) -> DataFrame:
    """Listed objects that no metadata refers to and that are older than a time; nothing is deleted here."""
    return listing.join(referenced.select("path").distinct(), "path", "left_anti").where(F.col("modified") < before)
