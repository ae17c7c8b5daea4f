"""Two-pass external shuffle into shards.

Pass one scatters whole records into buckets that fit in memory: the shard by
rendezvous hashing of the id (the highest of one seeded hash for each shard, so
another shard takes rows only into itself), the bucket within the shard by another
seeded hash, of the whole record.  Equal records that would overfill a bucket are
counted, and dealt out again in chunks that are hashed one by one.  A bucket is a
partition of its own, so a task holds one bucket and no more.  Pass two puts each bucket
in a fixed order, shuffles it by Fisher-Yates with a seed of its own, numbers the rows
through the shard, and writes them.  Buckets are independent and seeded, so a task that
runs again gives the same rows.

The number of a shard's buckets follows its bytes; counts of buckets, not rows,
are gathered for the offsets, and they travel to the bucket as one more row of it.

Cases: null text has size 1; rows with a null id go where the hash of nothing sends
them; rows that repeat an id share a shard but not a bucket; the record travels as one struct, so
its column names never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import BATCH_ROWS, small_batches

#: Bytes of text that a bucket should hold.
BUCKET_BYTES = 24 << 20


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text plus one (fixed by the contract)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: decided by the key, the number of shards and the seed."""
    return F.greatest(*(F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)))["s"]


def shuffle_into_shards(rows: DataFrame, id_col: str, text_col: str, shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """record (struct of all columns), shard, slot: the rows of each shard in shuffled order, numbered from 0."""
    size = size_of(F.col(text_col))
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    record = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("record")
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy(shard_of(F.col(id_col), shards, seed).alias("shard")).agg(F.sum(size).alias("bytes")).collect()}
    within = [max(1, -(-sizes.get(s, 0) // bucket_bytes)) for s in range(shards)]  # buckets of each shard: one that a frequent key fills gets more
    first = np.concatenate(([0], np.cumsum(within))).tolist()
    n_buckets, of_shard = first[-1], lambda values, shard: F.get(F.array(*(F.lit(int(v)) for v in values)), shard)

    def dealt(records: DataFrame, salt: Column) -> DataFrame:
        """shard, bucket, id, tie, record for ``records`` (record, and what ``salt`` needs)."""
        key, tie = F.col(f"record.`{id_col}`"), F.xxhash64(*(F.col(f"record.`{c}`") for c in rows.columns))
        placed = records.select("record", shard_of(key, shards, seed).alias("shard"), key.alias("id"), tie.alias("tie"), salt.alias("salt"))
        within_shard = F.pmod(F.xxhash64(F.lit(seed + 1), "tie", "salt"), of_shard(within, F.col("shard")))
        return placed.select("shard", (of_shard(first, F.col("shard")) + within_shard).cast("int").alias("bucket"), "id", "tie", "record")

    often = rows.groupBy(tie.alias("tie")).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > bucket_bytes)
    heavy = [r["tie"] for r in often.select("tie").collect()] if n_buckets > shards else []  # fewer than there are buckets
    scattered = dealt((rows.where(~tie.isin(heavy)) if heavy else rows).select(record), F.lit(0).cast("long"))
    if heavy:
        counted = rows.where(tie.isin(heavy)).select(record, size.alias("size")).groupBy("record", "size").agg(F.count("*").alias("n"))
        chunks = counted.withColumn("each", F.expr(f"greatest(1L, {bucket_bytes // 4}L div size)")).withColumn("chunk", F.explode(F.expr("sequence(0L, (n - 1) div each)")))
        copies = chunks.repartition(n_buckets, "record", "chunk").withColumn("copy", F.explode(F.expr("sequence(1L, least(each, n - chunk * each))")))
        scattered = scattered.unionByName(dealt(copies, F.col("chunk")))
    counts = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    scattered = scattered.drop("shard")
    marks = offsets.select("bucket", F.lit(None).cast(scattered.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast(scattered.schema["record"].dataType).alias("record"), "first_slot")
    both = scattered.withColumn("first_slot", F.lit(None).cast("long")).unionByName(marks)

    def fisher_yates(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        every = pa.Table.from_batches(held)
        mark = every.filter(pc.is_valid(every.column("first_slot")))
        rows = every.filter(pc.is_null(every.column("first_slot")))
        bucket, first_slot = (mark.column(c)[0].as_py() for c in ("bucket", "first_slot"))
        fixed = pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("tie", "ascending")]).to_numpy().copy()
        np.random.default_rng((seed, bucket)).shuffle(fixed)
        records = rows.column("record").combine_chunks()
        for at in range(0, len(fixed), BATCH_ROWS):
            chosen = fixed[at : at + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays(
                [records.take(pa.array(chosen)), pa.array(np.full(len(chosen), bisect.bisect_right(first, bucket) - 1, np.int32)), pa.array(np.arange(at, at + len(chosen)) + first_slot)],
                names=["record", "shard", "slot"],
            )

    schema = f"record {scattered.schema['record'].dataType.simpleString()}, shard int, slot long"
    small_batches(rows.sparkSession)
    return both.repartitionById(n_buckets, F.col("bucket")).mapInArrow(fisher_yates, schema)


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder for each shard; a file holds one bucket of it in the order of its slots."""
    shuffled.write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_shards`` wrote of a table of ``schema``: record, slot, shard."""
    return spark.read.schema(schema).parquet(path)
