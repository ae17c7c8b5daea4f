"""Versions of a state as partitions of one table, tables bucketed by cell, and scans that a join narrows at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark build a Bloom filter of a join's small side for the scan of the other, whatever the size of either.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}


def write_versions(rows: DataFrame, path: str, by: str = "version") -> None:
    rows.write.partitionBy(by).parquet(path)


def version_asof(spark: SparkSession, path: str, releases: DataFrame, when: Column, by: str = "version") -> DataFrame:
    """The rows of the version that was the last at a date; none before the first.

    ``releases`` has ``by`` and vintage_date.  The version is found by Spark when the
    query runs, and the scan then reads its partition alone.
    """
    last = releases.where(F.col("vintage_date") <= when).agg(F.max(by).alias(by)).where(F.col(by).isNotNull())
    return spark.read.parquet(path).join(F.broadcast(last), by)  # one row


def versions_asof(spark: SparkSession, path: str, releases: DataFrame, dates: DataFrame, by: str = "version") -> DataFrame:
    """The rows of the version that was the last at each date, with the date (``when``); none for a date before the first.

    ``releases`` has ``by`` and vintage_date, ``dates`` when; both have a row for each
    release or date, and only the partitions of the versions found are read.
    """
    last = dates.join(releases, F.col("vintage_date") <= F.col("when")).groupBy("when").agg(F.max(by).alias(by))
    return spark.read.parquet(path).join(F.broadcast(last), by)  # a row for each date


def _folders(spark: SparkSession, path: str, by: str) -> list[tuple[int, object, object]]:
    """(version, folder, its file system), ascending: a row for each version."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{by}=")]
    return sorted(((int(p.getName().partition("=")[2]), p, fs) for p in found), key=lambda x: x[0])


def expire_versions(spark: SparkSession, path: str, keep: int = 1, by: str = "version") -> list[int]:
    """Drop the partitions before the last ``keep`` versions, unread, and return what was dropped."""
    gone = _folders(spark, path, by)[:-keep or None]
    for _, folder, fs in gone:
        fs.delete(folder, True)
    return [version for version, _, _ in gone]


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int, by: str = "cell_id") -> DataFrame:
    """A catalog table whose files are bucketed and sorted by cell: joins and windows over the cell need no exchange of it."""
    rows.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def reached_rows(store: DataFrame, dirty: DataFrame, by: str = "cell_id") -> DataFrame:
    """The store's rows of the dirty cells, which are a part of a table by some condition.

    Spark filters the store's scan by a Bloom filter of the cells, so about as many rows
    as are wanted are shuffled; the semi join takes out those that the filter lets by.
    """
    for key, value in BLOOM.items():
        store.sparkSession.conf.set(key, value)
    return store.join(dirty.select(by), by, "left_semi")
