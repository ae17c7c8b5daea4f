"""Digest trees over states: one digest for a state, and where two states differ without reading what is equal.

A leaf is a range of cells by the first digits of their ids, whose rows are digested in
their order; an inner node digests its children (a digit shorter) in theirs, up to the
root.  The number of digits follows from the rows, so that a leaf has about ``LEAF_ROWS``
and never over four times as many, as far as the ids differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisor.functions.identity import SEPARATOR
from revisor.sources.files import written

LEAF_ROWS = 4096
#: Hexadecimal digits of a cell's id, and ranges of cells that one scan filters by.
DIGITS, MOST_RANGES = 20, 200


def depth_of(rows: DataFrame, by: list[str], leaf_rows: int = LEAF_ROWS) -> int:
    """Digits of a leaf's range: the fewest that give the largest state leaves of ``leaf_rows`` on average, and no leaf over four times that."""
    counts = lambda digits: rows.groupBy(*by, F.substring("cell_id", 1, digits).alias("p")).count().agg(F.max("count")).first()[0] or 0
    most, depth = counts(0), 0
    while leaf_rows * 16**depth < most:
        depth += 1
    while depth < DIGITS and depth and counts(depth) > 4 * leaf_rows:
        depth += 1
    return depth


def digest_tree(rows: DataFrame, by: list[str], columns: list[str], depth: int) -> DataFrame:
    """by, level, prefix, state_rows, digest: a row for each node, from the root (level 0) to the leaves (level ``depth``)."""
    row = F.struct("cell_id", F.sha2(F.concat_ws(SEPARATOR, *columns), 256).alias("d"))
    joined = lambda of: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["d"]), ""), 256)
    leaves = rows.groupBy(*by, F.substring("cell_id", 1, depth).alias("prefix")).agg(F.count("*").alias("state_rows"), joined(row).alias("digest"))
    levels = [written(leaves.withColumn("level", F.lit(depth)), "leaves")]
    for level in range(depth - 1, -1, -1):
        child = F.struct("prefix", F.col("digest").alias("d"))
        up = levels[-1].groupBy(*by, F.substring("prefix", 1, level).alias("up")).agg(F.sum("state_rows").alias("state_rows"), joined(child).alias("digest"))  # 16 children
        levels.append(written(up.withColumnRenamed("up", "prefix").withColumn("level", F.lit(level)), "nodes"))
    tree = reduce(DataFrame.unionByName, levels)
    return tree.select(*by, "level", "prefix", "state_rows", "digest")


def state_digest(rows: DataFrame, by: list[str], columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Count and SHA-256 of a state, whatever order and partitions its rows come in: the root of its tree."""
    return digest_tree(rows, by, columns, depth_of(rows, by, leaf_rows)).where("level = 0").select(*by, "state_rows", "digest")


def differing_leaves(one: DataFrame, two: DataFrame, depth: int) -> DataFrame:
    """prefix: the leaves in which two trees of the same depth differ; below nodes that are equal nothing is compared."""
    differing = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select("prefix", F.col("digest").alias(n)) for t, n in ((one, "a"), (two, "b")))
        if differing is not None:
            parents = differing.withColumnRenamed("prefix", "parent")
            a, b = (t.withColumn("parent", F.substring("prefix", 1, level - 1)).join(parents, "parent", "left_semi").drop("parent") for t in (a, b))
        differing = written(a.join(b, "prefix", "full_outer").where("NOT (a <=> b)").select("prefix"), "differing")
        if differing.isEmpty():
            break
    return differing


def store_state(rows: DataFrame, path: str, row_group_bytes: int = 16 << 20) -> None:
    """A state in the order of its cells, so that a range of cells is a few row groups."""
    rows.repartitionByRange("cell_id").sortWithinPartitions("cell_id").write.option("parquet.block.size", row_group_bytes).parquet(path)


def _ranges(prefixes: DataFrame) -> list[str]:
    """At most MOST_RANGES prefixes that hold all of ``prefixes``: shorter ones where there are more."""
    for digits in range(DIGITS, -1, -1):
        short = prefixes.select(F.substring("prefix", 1, digits).alias("p")).distinct()
        found = [r.p for r in short.limit(MOST_RANGES + 1).collect()]
        if len(found) <= MOST_RANGES:
            return sorted(found)
    return [""]


def in_ranges(prefixes: list[str]) -> Column:
    """Ids that begin with one of the prefixes, as comparisons that a scan checks against its row groups."""
    each = [(F.col("cell_id") >= p) & (F.col("cell_id") < p + "g") for p in prefixes]  # "g" follows all hexadecimal digits
    return reduce(lambda a, b: a | b, each, F.lit(False))


def differing_cells(spark: SparkSession, one: str, two: str, prefixes: DataFrame, columns: list[str]) -> DataFrame:
    """cell_id, status (only_one, only_two, changed): read from the differing ranges of two stored states alone."""
    where = in_ranges(_ranges(prefixes))
    a, b = (spark.read.parquet(p).where(where).select("cell_id", F.struct(*columns).alias(n)) for p, n in ((one, "a"), (two, "b")))
    rows = a.join(b, "cell_id", "full_outer").where("NOT (a <=> b)")
    return rows.select("cell_id", F.when(F.col("b").isNull(), "only_one").when(F.col("a").isNull(), "only_two").otherwise("changed").alias("status"))


def compare_states(spark: SparkSession, one: str, two: str, columns: list[str], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The cells in which two stored states differ, from the root of their trees down."""
    a, b = spark.read.parquet(one), spark.read.parquet(two)
    depth = max(depth_of(a, [], leaf_rows), depth_of(b, [], leaf_rows))
    trees = [digest_tree(x, [], ["cell_id", *columns], depth) for x in (a, b)]
    return differing_cells(spark, one, two, differing_leaves(*trees, depth), columns)
