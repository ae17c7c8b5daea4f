"""Mixing sources to target weights: a min-cost flow from documents' memberships to the sources' quotas.

A document may belong to several sources.  Documents are aggregated by membership
pattern; a pattern offers its words once at cost 0, again at cost 1, and so on up to
``MOST`` times, so repetition costs are convex and words are repeated only where fresh
ones do not meet a quota.  The flow sends the patterns' words to the quotas of their
sources at the least cost.  Patterns that no chain of shared sources connects are
separate problems, each solved in a task of its own.

What a pattern sends to a source is a stretch of its words: its documents in the order
of a seeded hash, again and again.  The ends of stretches are found by counting words
in 4096 ranges of the hash, then in 4096 parts of the range where the end falls, until
that holds few documents; only these are ordered.  The document at an end gives a part of
its words, so a source's words meet its flow exactly.

The same rows give the same mix in any order and partitioning.  Bounds: a row for each
source in one window (targets), ``MOST_ARCS`` pattern-source pairs that are connected
with each other in one task, beyond which an error is raised.

Cases: null text has no words and nothing is taken of it; null is a source of its own;
a document of no source is in no mix and has no row; repeated ids and rows are taken
like others; an empty table gives no rows.  Words of very long texts are counted in the
text as it is.  Further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, written

#: Times that a document may be taken, and weights of the sources in their order.
MOST, WEIGHTS = 3, (5, 2, 1)
SEED = "mix-1"
MOST_ARCS = 1_000_000
#: Hexadecimal digits of a document's key (hash, size, number), those that one count looks at, and documents that are ordered at an end.
KEY_DIGITS, DIGITS, MOST_ORDERED = 64, 3, 100_000
#: Patterns up to which the plan is broadcast (some 20 MB).
MOST_PATTERNS = 100_000
_SPACE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x"), _SPACE, "")).cast("long")


# ------------------------------------------------------------------ targets


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``place`` in code point order, null last, and ``target``.

    Targets share the sum of all sizes by weight, none above ``most`` times its size:
    in the order of size by weight, a source stops at its bound as long as that is
    below its share of what the earlier ones leave.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("place", place).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("decimal(38,0)"))
    bound = (F.col("source_size") * most).cast("decimal(38,0)")
    order = Window.orderBy(F.col("source_size").cast("double") / F.col("weight").cast("double"), "place")
    rows = rows.withColumn("bound", bound).withColumn("before", F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    all_rows = Window.partitionBy()
    rows = rows.withColumn("rest", F.sum(F.col("source_size").cast("decimal(38,0)")).over(all_rows) - F.coalesce("before", F.lit(0)))
    rows = rows.withColumn("others", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    stops = F.col("bound").cast("double") * F.col("others").cast("double") <= F.col("weight").cast("double") * F.col("rest").cast("double")
    rows = rows.withColumn("stops", stops)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("bound"))).over(all_rows), F.lit(0))
    share = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(all_rows)
    target = F.when(F.col("stops"), F.col("bound").cast("double")).otherwise((F.col("weight") * left).cast("double") / share.cast("double"))
    return rows.select("source", "source_size", F.col("place").cast("long").alias("place"), target.alias("target"))


# ------------------------------------------------------------------ the flow


def route(words: list[int], members: list[list[int]], quotas: dict[int, int], most: int = MOST) -> dict[tuple[int, int], int]:
    """Words that each pattern (by index) sends to each of its sources: a flow of the greatest size and of the least cost.

    Shortest paths by cost from the start, then blocking flows along them, until no
    path is left.  Arcs lie in pairs, an arc and its reverse.
    """
    heads: list[int] = []
    room: list[int] = []
    costs: list[int] = []
    n = len(words)
    source_at = {s: 2 + n + k for k, s in enumerate(sorted(quotas))}
    out: list[list[int]] = [[] for _ in range(2 + n + len(quotas))]

    def arc(u: int, v: int, capacity: int, cost: int) -> None:
        for a, b, c, w in ((u, v, capacity, cost), (v, u, 0, -cost)):
            out[a].append(len(heads))
            heads.append(b)
            room.append(c)
            costs.append(w)

    sent = {}
    for k, (w, own) in enumerate(zip(words, members, strict=True)):
        for times in range(most):
            arc(0, 2 + k, w, times)
        for s in own:
            sent[k, s] = len(heads) + 1  # the reverse arc has room for what was sent
            arc(2 + k, source_at[s], w * most, 0)
    for s, quota in quotas.items():
        arc(source_at[s], 1, quota, 0)

    while True:
        far, queue, queued = {0: 0}, deque([0]), {0}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in out[u]:
                v = heads[e]
                if room[e] and (v not in far or far[u] + costs[e] < far[v]):
                    far[v] = far[u] + costs[e]
                    if v not in queued:
                        queued.add(v)
                        queue.append(v)
        if 1 not in far:
            return {pair: room[e] for pair, e in sent.items()}
        while True:  # layers by arcs within the shortest paths, since arcs of no cost may form cycles
            layer, queue = {0: 0}, deque([0])
            while queue:
                u = queue.popleft()
                for e in out[u]:
                    v = heads[e]
                    if room[e] and v not in layer and v in far and far[v] == far[u] + costs[e]:
                        layer[v] = layer[u] + 1
                        queue.append(v)
            if 1 not in layer:
                break
            tried, path = [0] * len(out), []
            u = 0
            while True:
                if u == 1:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    u, path = 0, []
                while tried[u] < len(out[u]):
                    e = out[u][tried[u]]
                    v = heads[e]
                    if room[e] and layer.get(v) == layer[u] + 1 and far[v] == far[u] + costs[e]:
                        break
                    tried[u] += 1
                if tried[u] < len(out[u]):
                    path.append(out[u][tried[u]])
                    u = heads[path[-1]]
                elif path:
                    u = heads[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break


def _solve(most: int):
    def solve(arcs: pd.DataFrame) -> pd.DataFrame:
        if len(arcs) > MOST_ARCS:
            raise ValueError(f"{len(arcs)} pattern-source pairs are connected, more than {MOST_ARCS}")
        arcs = arcs.sort_values(["pattern", "place"])
        groups = [(p, g) for p, g in arcs.groupby("pattern", sort=True)]
        found = route([int(g.words.iloc[0]) for _, g in groups], [g.place.tolist() for _, g in groups], dict(zip(arcs.place.tolist(), arcs.quota.tolist(), strict=True)), most)
        return pd.DataFrame([(groups[k][0], s, w) for (k, s), w in found.items()], columns=["pattern", "place", "flow"])

    return solve


def flows(arcs: DataFrame, most: int = MOST) -> DataFrame:
    """pattern, place (of the source), flow: for arcs (pattern, words, place, quota)."""
    least = arcs.groupBy("pattern").agg(F.min("place").alias("a"))
    links = written(arcs.join(least, "pattern").select("a", F.col("place").alias("b")).where("a <> b").distinct(), "links")
    if links.isEmpty():  # no document belongs to two sources
        named = arcs.withColumn("component", F.col("place"))
    else:
        components = connected_components(links)
        named = arcs.join(components, arcs["place"] == components["node"], "left").withColumn("component", F.coalesce("component", "place"))
    return named.select("component", "pattern", "words", "place", "quota").groupBy("component").applyInPandas(_solve(most), "pattern string, place long, flow long")


# ------------------------------------------------------------------ documents


def before_ends(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """Of each document (id, doc_id, size, pattern, key) and each end (pattern, place, words, at) of its pattern: the words it gives before it.

    An end lies ``at`` words after the start of the pattern's ``words``, which repeat.
    """
    few = ends.limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS
    near = F.broadcast if few else (lambda df: df)
    repeated = (F.floor(F.col("at") / F.col("words")).alias("times"), (F.col("at") % F.col("words")).alias("left"))
    cut, looked, most = ends.where("words > 0").select("pattern", "place", *repeated, F.lit("").alias("prefix")), 0, None
    while looked == 0 or most > MOST_ORDERED and looked < KEY_DIGITS:
        looked += DIGITS
        inside = docs.join(near(cut), "pattern").where(F.col("key").startswith(F.col("prefix")))
        ranges = inside.groupBy("pattern", "place", "times", "left", F.substring("key", 1, looked).alias("digits")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        order = Window.partitionBy("pattern", "place").orderBy("digits")  # 4096 rows
        ranges = ranges.withColumn("before", F.sum("words").over(order) - F.col("words"))
        falls = (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))
        cut = written(ranges.where(falls).select("pattern", "place", "times", (F.col("left") - F.col("before")).alias("left"), F.col("digits").alias("prefix"), "rows"), "cut")
        most = cut.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
        cut = cut.drop("rows")
    rows = docs.join(near(cut), "pattern").withColumn("digits", F.substring("key", 1, looked))
    again = F.col("times") + F.when(F.col("digits") < F.col("prefix"), 1).otherwise(0)
    away = rows.where("digits <> prefix").select("id", "doc_id", "size", "place", (F.col("size") * again).alias("words"))
    before = F.sum("size").over(Window.partitionBy("pattern", "place").orderBy("key")) - F.col("size")
    some = F.least(F.greatest(F.col("left") - before, F.lit(0)), F.col("size"))
    at_end = rows.where("digits = prefix").select("id", "doc_id", "size", "place", (F.col("size") * F.col("times") + some).alias("words"))
    nothing = docs.join(near(ends.where("words = 0").select("pattern", "place")), "pattern").select("id", "doc_id", "size", "place", F.lit(0).cast("long").alias("words"))
    return away.unionByName(at_end).unionByName(nothing)


def mix(docs: DataFrame, doc_id: Column, text: Column, members: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """A row for each document and each source it belongs to: doc_id, size, source, source_size, target, taken.

    ``members`` is the array of a document's sources.  ``taken`` words of the document
    go to the source, repeats counted; over its sources no document gives more than
    ``most`` times its size.
    """
    rows = docs.select(doc_id.alias("doc_id"), words_of(text).alias("size"), F.array_sort(F.array_distinct(members)).alias("members"), F.monotonically_increasing_id().alias("id"))
    hashed = F.md5(F.concat_ws("\x1f", F.lit(seed), F.col("doc_id").cast("string")))
    key = F.concat(hashed, F.lpad(F.hex("size"), 16, "0"), F.lpad(F.hex("id"), 16, "0"))
    rows = written(rows.where(F.size("members") > 0).select("id", "doc_id", "size", "members", F.to_json("members").alias("pattern"), key.alias("key")), "sized")
    patterns = written(rows.groupBy("pattern", "members").agg(F.sum("size").alias("words")), "patterns")
    arcs = patterns.select("pattern", "words", F.explode("members").alias("source"))
    aims = written(targets(arcs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "targets")
    aimed = arcs.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("quota", F.round("target").cast("long"))
    routed = flows(aimed.select("pattern", "words", "place", "quota"), most)
    # A source's stretch ends where the flows of the pattern's sources up to it are used up, and starts where that of the source before it ends.
    order = Window.partitionBy("pattern").orderBy("place")
    until = F.sum("flow").over(order)
    found = routed.select("pattern", "place", (until - F.col("flow")).alias("start"), until.alias("at"))
    ends = written(found.join(patterns.select("pattern", "words"), "pattern"), "ends")
    given = before_ends(rows, ends)
    starts = ends.where("start > 0")
    if not starts.isEmpty():
        earlier = before_ends(rows, starts.withColumn("at", F.col("start"))).select("id", "place", F.col("words").alias("earlier"))
        given = given.join(earlier, ["id", "place"], "left").withColumn("words", F.col("words") - F.coalesce("earlier", F.lit(0)))
    return given.join(aims, "place").select("doc_id", "size", "source", "source_size", "target", F.col("words").alias("taken"))
