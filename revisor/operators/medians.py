"""Exact medians of groups of any size, without a group's values in one task.

The two middle ranks of each group are looked for in a range of values that narrows:
the values in it are counted in ``BINS`` equal parts (with partial aggregation), and the
part where the rank falls, from its least value to its greatest, is the next range.  As
the ends of a range never share a part, it narrows until it has ``FEW`` rows at most, or
one value; its values are then counted one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revisor.sources.files import written

BINS, FEW = 1024, 10_000


def exact_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the middle value, or the mean of the two in the middle; nulls do not count, and a group without values has no row."""
    values = rows.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    spans = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    open_, done = spans.select(*by, F.posexplode(ranks).alias("which", "rank"), "n", "lo", "hi"), None  # the rank within the range
    open_ = written(open_, "ranges")
    group = [*by, "which"]
    while True:
        narrow = (F.col("n") <= FEW) | (F.col("lo") == F.col("hi"))
        ready = open_.where(narrow)
        done = ready if done is None else done.unionByName(ready)
        wide = open_.where(~narrow)
        if wide.isEmpty():
            break
        inside = values.join(wide.drop("n"), by).where("v BETWEEN lo AND hi")
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        parts = inside.groupBy(*group, "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(*group).orderBy("part")) - F.col("n")  # BINS rows
        found = parts.withColumn("before", before).where("before <= rank AND rank < before + n")
        open_ = written(found.select(*group, (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi"), "ranges")
    done = written(done.drop("n"), "ranges")
    one = done.where("lo = hi").select(*group, F.col("lo").alias("v"))
    counted = values.join(done.where("lo < hi"), by).where("v BETWEEN lo AND hi").groupBy(*group, "rank", "v").count()
    upto = F.sum("count").over(Window.partitionBy(*group).orderBy("v"))  # FEW rows
    some = counted.withColumn("upto", upto).where("upto - count <= rank AND rank < upto").select(*group, "v")
    return one.unionByName(some).groupBy(*by).agg(F.avg("v").alias("median"))
