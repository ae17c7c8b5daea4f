"""Releases as a stream: a cell's vintages are keyed state, and each batch emits the cells it revises.

State lives in the stream's checkpoint, by cell and vintage, so a batch looks up and
writes its own cells alone, however large the store is; what it emits goes to a log of
revisions with a folder for each batch.  The served state is the last revision of each
cell in the log, which may be folded from time to time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisor.operators.model import KNOWLEDGE

#: State store that keeps state on disk and writes a batch's changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What a cell serves.
SERVED = ("observation_id", "value", "value_lexeme", "vintage_count", "value_revision_count")


def _changes(vintages: Column) -> Column:
    """How often the value differs from the one before, in order of knowledge."""
    differs = F.transform(vintages, lambda v, i: F.when(i > 0, ~v["value"].eqNullSafe(F.get(vintages, i - 1)["value"])).otherwise(False))
    return F.size(F.filter(differs, lambda d: d)).cast("long")


def revisions(arrivals: DataFrame) -> DataFrame:
    """Update-mode stream of the cells that a batch adds a vintage to, with what they serve then.

    Two stateful operators: the first knows each (cell, vintage) and lets a row through
    once, so replays emit nothing; the second holds the vintages of each cell.  The order
    is that of knowledge, so a late release changes counts and not what is served.
    """
    once = arrivals.dropDuplicates(["cell_id", "vintage_id"])
    held = once.groupBy("cell_id").agg(F.collect_list(F.struct(*KNOWLEDGE, "observation_id", "value", "value_lexeme")).alias("held"))
    rows = held.withColumn("held", F.array_sort("held")).withColumn("last", F.element_at("held", -1))
    return rows.select("cell_id", "last.observation_id", "last.value", "last.value_lexeme", F.size("held").cast("long").alias("vintage_count"), _changes(F.col("held")).alias("value_revision_count"))


def stream_arrivals(arrivals: DataFrame, log: str, checkpoint: str):
    """Start the query that writes the revisions of each batch to ``log``; a batch that runs again replaces its own folder."""
    for key, value in STATE_STORE.items():
        arrivals.sparkSession.conf.set(key, value)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return revisions(arrivals).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serving(log: DataFrame) -> DataFrame:
    """The served state: of each cell the revision with the most vintages, by one partial aggregate."""
    last = F.max_by(F.struct(*SERVED), "vintage_count")
    return log.groupBy("cell_id").agg(last.alias("v")).select("cell_id", "v.*")


def fold(spark: SparkSession, log: str, to: str) -> DataFrame:
    """A log with the last revision of each cell only, written to ``to``; later batches may be written beside it."""
    serving(spark.read.parquet(log)).write.parquet(f"{to}/batch=-1")
    return spark.read.parquet(to)


def stream_latest(arrivals: DataFrame) -> DataFrame:
    """Running latest vintage of each cell, for an update-mode sink."""
    return arrivals.groupBy("cell_id").agg(F.max_by(F.struct("observation_id", "value", "value_lexeme"), F.struct(*KNOWLEDGE)).alias("v")).select("cell_id", "v.*")
