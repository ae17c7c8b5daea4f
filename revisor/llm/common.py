"""What several operators share: the shared folder, written tables, row keys, rows by their keys, text blocks, running folds and components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Where tables go when the session names no folder (tests on one machine only).
LOCAL_DIR = "/tmp/checkpoints"
#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows that Spark's Parquet reader decodes at once; their texts lie side by side in one array, which grows by doubling.
READ_ROWS = 512
#: A writer holds a row group in memory until it is full.
ROW_GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one if the master is local, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", f"file://{LOCAL_DIR}")
        found = spark.conf.get("spark.checkpoint.dir")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table of ``written`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Up to so many input files, their numbers are broadcast (some 30 MB).
MOST_FILES = 200_000


def free_name(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as keep it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a unique long of their own, the same each time they are read, and its column's name.

    Rows of Parquet files are named by the number of their file and their place in it, so
    nothing is copied; other rows are numbered and written.
    """
    key, path, place = (free_name(n, docs.columns) for n in ("row_key", "row_file", "row_place"))
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(place))
    except AnalysisException:
        return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key
    files = written(rows.select(path).distinct(), "files")
    few = files.count() <= MOST_FILES
    numbered = files.select(path, F.row_number().over(Window.orderBy(path)).cast("long").alias(key))  # a row for each file
    rows = rows.join(F.broadcast(numbered) if few else numbered, path)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), (F.shiftleft(key, 40) + F.col(place)).alias(key)), key


#: Up to so many words of 64 keys, they are broadcast (some 70 MB).
MOST_WORDS = 1_000_000


def among(rows: DataFrame, key: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """``rows`` whose ``key`` (long, not null) is one of ``ids`` (one column of longs, repeats allowed), or is none of them.

    An id is a bit in a word of 64, so a word holds what is near: keys of ``with_row_key``
    take a word for 64 rows, and the rows themselves, whole texts among them, are not
    shuffled while the words are few.  More words are joined as Spark decides.
    """
    columns, (of,) = [F.col(f"`{c}`") for c in rows.columns], ids.columns
    word, bits = (free_name(n, rows.columns) for n in ("word", "bits"))
    place = lambda c: F.col(c).bitwiseAND(F.lit(63)).cast("int")
    words = ids.groupBy(F.shiftright(of, 6).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(of))).alias(bits))
    words = written(words, "words")
    few = words.count() <= MOST_WORDS
    found = F.call_function("shiftright", F.col(bits), place(key)).bitwiseAND(F.lit(1))
    joined = rows.join(F.broadcast(words) if few else words, F.shiftright(key, 6) == F.col(word), "inner" if inside else "left")
    return joined.where(found == 1 if inside else F.coalesce(found, F.lit(0)) == 0).select(*columns)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value found once for a row, however often and wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, fold) -> Column:
    """The fold of each element of an array with all before it.

    In pieces of the cube root of the size, so the work is about the size to the power
    of 4/3, where a fold for each element would take its square.
    """

    def over(v: Column, width: Column) -> Column:
        part = lambda at, n: F.aggregate(F.slice(v, at, n), zero, fold)
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda c: part(c * width + 1, width))
        before = lambda pieces: F.transform(pieces, lambda _, c: F.aggregate(F.slice(pieces, 1, c), zero, fold))
        return let(whole, lambda w: let(before(w), lambda b: F.transform(v, lambda _, i: let(F.floor(i / width).cast("int"), lambda c: fold(F.get(b, c), part(c * width + 1, i - c * width + 1))))))

    return F.when(F.size(values) > 0, let(values, lambda v: let(F.greatest(F.ceil(F.cbrt(F.size(v))).cast("int"), F.lit(1)), lambda width: over(v, width)))).otherwise(F.slice(F.array(zero), 1, 0))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, and what is decoded at once by rows; texts may be long."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_blocks(raw: bytes, size: int = 1 << 20, overlap: int = 0):
    """Words of a text, split at ASCII white space, in lists of about ``size`` bytes.

    The last ``overlap`` words of a list start the next one, so windows of
    ``overlap + 1`` words are each seen once.  Long texts need little memory.
    """
    if len(raw) <= size:
        yield raw.split()
        return
    at, kept = 0, []
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = kept + raw[at:end].split()
        at = end
        if at >= len(raw) or len(words) > overlap:
            yield words
            kept = words[len(words) - overlap :] if overlap else []
        else:
            kept = words


def hash_sample(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The ``n`` rows with the least hash of a key, of about ``total``.

    A threshold on the hash comes first, so tasks send some 1.5 n rows in all, however
    many tasks there are.
    """
    h = F.xxhash64(key)
    if total > 2 * n:
        rows = rows.where(h < int(-(2**63) + 2**64 * 1.5 * n / total))
    return rows.orderBy(h, key).limit(n)


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges``: a, b (long).  Returns node, component (the smallest node reachable),
    for every node that has an edge.  Every step is a shuffle; the tables of each
    round are written in the shared folder, so a lost executor costs one round, and so
    that a join on them may be split where a node has very many neighbours.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "edges")
        for table in (now, least, large, low):
            drop_written(table)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
