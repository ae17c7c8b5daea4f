"""Merkle manifest of a table: a tree of digests for each group of rows, one over the groups, and a proof for each row.

A leaf is a row.  The leaves of a group (for documents: a source) ascend by key; three
consecutive nodes become the digest of their digests, of which the last run may be
shorter, until one is left; the groups' roots are the leaves of one more such tree.

Proofs are octopus multiproofs.  Leaves are numbered through the whole order and cut
into pieces of ``PIECE``, whatever groups they belong to.  A task holds one piece:

1. it derives what its leaves determine, stores those nodes alone whose parents it
   cannot derive (some four a level), and lists the coordinates that its leaves' proofs
   lack, as the minimal union over the piece, in the groups' trees and in the upper one;
2. the stored nodes of pieces meet in aligned blocks, which derive the nodes above;
3. a join fetches each listed coordinate once for a piece, which derives the shared
   interior nodes again and expands the proof of each of its leaves.

No task holds more than a piece, or a block of ``FAN ** BLOCK[0]`` leaves' stored nodes.

Cases: null fields are ``-``; a null key comes first in its group and null groups come
first; rows that repeat a key are ordered by their digests, so equal rows are
interchangeable; a group of one leaf is that leaf; an empty table has no rows and no
root.  Very long texts are hashed whole, one row at a time.  Further columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import tasks, written

#: Nodes in a run.
FAN = 3
#: Leaves whose proofs one task expands at a time: some 10 MB.
PIECE = 4096
#: Levels that the first round of blocks spans, and each round after it.
BLOCK = (13, 9)
#: The tree over the groups.
TOP = -1

_NODES = "piece long, tree long, n long, level int, place long, digest string"
_PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its bytes counted, a colon, and it."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level from left to right, joined."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


# ------------------------------------------------------------------ inside a task


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _run(parent: int, n: int) -> range:
    return range(FAN * parent, min(FAN * parent + FAN, n))


def missing(places: list[int], n: int) -> list[tuple[int, int]]:
    """Level and place of the fewest nodes that, with the leaves at ``places`` of a tree of ``n``, prove them all."""
    need, level, known = [], 0, sorted(set(places))
    while n > 1:
        here, parents = set(known), list(dict.fromkeys(k // FAN for k in known))
        need += [(level, c) for p in parents for c in _run(p, n) if c not in here]
        known, n, level = parents, -(-n // FAN), level + 1
    return need


def derive(levels: dict[int, dict[int, str]], n: int) -> int:
    """Add to the known nodes of a tree of ``n`` leaves all that they determine; returns the level of its root."""
    level = 0
    while n > 1:
        here, above = levels.get(level, {}), levels.setdefault(level + 1, {})
        for p in {k // FAN for k in here}:
            run = _run(p, n)
            if p not in above and all(c in here for c in run):
                above[p] = _h("".join(here[c] for c in run))
        n, level = -(-n // FAN), level + 1
    return level


def _rows(found: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*found, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
_NAMES = ["piece", "tree", "n", "level", "place", "digest"]


def _by_tree(leaves: pa.Table, trees: pa.Table) -> list[tuple[int, int, dict[int, str]]]:
    """(tree, its size, digests by place) of the trees that a piece's leaves belong to."""
    known = sorted(zip(trees["first"].to_pylist(), trees["tree"].to_pylist(), trees["n"].to_pylist(), strict=True))
    firsts, found = [k[0] for k in known], [{} for _ in known]
    for at, digest in zip(leaves["at"].to_pylist(), leaves["digest"].to_pylist(), strict=True):
        i = bisect_right(firsts, at) - 1
        found[i][at - firsts[i]] = digest
    return [(tree, n, own) for (_, tree, n), own in zip(known, found, strict=True)]


def _look(groups: int):
    """Step 1 for a piece: stored nodes have a digest, listed coordinates have none, nodes that no block needs no n."""

    def look(leaves: pa.Table, trees: pa.Table) -> pa.Table:
        piece, out, ranks = trees["piece"][0].as_py(), [], []
        for tree, n, own in _by_tree(leaves, trees):
            ranks.append(tree)
            out += [(piece, tree, n, *c, None) for c in missing(list(own), n)]
            levels = {0: own}
            top = derive(levels, n)
            for k, here in levels.items():
                for p, d in here.items():
                    if k == top or p // FAN not in levels[k + 1]:
                        out.append((piece, tree, n, k, p, d))
                    elif tree == TOP:  # pieces of leaves meet any of the groups
                        out.append((piece, tree, None, k, p, d))
        if ranks[0] != TOP:
            out += [(piece, TOP, groups, *c, None) for c in missing(ranks, groups)]
        return _rows(out, _NAMES, _KINDS)

    return look


def _climb(found: pa.Table) -> pa.Table:
    """Step 2 for a block: the nodes it determines that it was not given."""
    rows = found.select(["tree", "n", "level", "place", "digest"]).to_pylist()
    tree, n, levels, given = rows[0]["tree"], rows[0]["n"], {}, set()
    for r in rows:
        levels.setdefault(r["level"], {})[r["place"]] = r["digest"]
        given.add((r["level"], r["place"]))
    derive(levels, n)
    return _rows([(None, tree, n, k, p, d) for k, here in levels.items() for p, d in here.items() if (k, p) not in given], _NAMES, _KINDS)


def _steps(levels: dict[int, dict[int, str]], n: int, places) -> list[dict[int, tuple[str, str]]]:
    """For each level and each node above ``places``: its siblings to the left and to the right."""
    out, level, known = [], 0, set(places)
    while n > 1:
        here = levels[level]
        out.append({k: ("".join(here[c] for c in _run(k // FAN, n) if c < k), "".join(here[c] for c in _run(k // FAN, n) if c > k)) for k in known})
        known, n, level = {k // FAN for k in known}, -(-n // FAN), level + 1
    return out


def _expand(groups: int):
    """Step 3 for a piece: every leaf with its group's root, the root, and its proof."""

    def expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        told = pc.is_null(fetched["level"])
        nodes: dict[int, dict[int, dict[int, str]]] = {}
        for r in fetched.filter(pc.invert(told)).select(["tree", "level", "place", "digest"]).to_pylist():
            nodes.setdefault(r["tree"], {}).setdefault(r["level"], {})[r["place"]] = r["digest"]
        leaves = leaves.sort_by("at")
        trees, upper = _by_tree(leaves, fetched.filter(told)), nodes.get(TOP, {})
        made = []
        for tree, n, own in trees:
            levels = nodes.get(tree, {})
            levels[0] = levels.get(0, {}) | own
            top = derive(levels, n)
            upper.setdefault(0, {})[tree] = levels[top][0]
            made.append(_steps(levels, n, own))
        root = upper[derive(upper, groups)][0]
        above = _steps(upper, groups, [tree for tree, *_ in trees])
        ids, sizes, subroots, ends, left, right = [], [], [], [0], [], []
        for (tree, n, own), steps in zip(trees, made, strict=True):
            for place in own:  # in the order of the leaves
                for at, levels in ((place, steps), (tree, above)):
                    for here in levels:
                        step = here[at]
                        left.append(step[0])
                        right.append(step[1])
                        at //= FAN
                ends.append(len(left))
            ids += own
            sizes += [n] * len(own)
            subroots += [upper[0][tree]] * len(own)
        proofs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        kept = leaves.drop_columns(["piece", "at"])
        for name, values in (("place", pa.array(ids, pa.int64())), ("leaves", pa.array(sizes, pa.int64())), ("subroot", pa.array(subroots, pa.string())), ("root", pa.array([root] * len(ids), pa.string())), ("proof", proofs)):
            kept = kept.append_column(name, values)
        return kept

    return expand


# ------------------------------------------------------------------ over the table


@dataclass
class Manifest:
    """leaves: the rows and ``at``, their place in the whole order; trees: group, tree (its place among the groups), first, n; nodes: the stored nodes; needs: coordinates by piece."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    needs: DataFrame
    groups: int


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows, written in their order, with ``at``: their place in it from 0.

    A range sort; a row for each partition is summed in one window.  What is equal in
    all of ``order`` is spread by a number of its own, so no partition gets a group whole.
    """
    tie = "at"
    ranked = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks(rows.sparkSession), *order, tie).sortWithinPartitions(*order, tie)
    table = written(ranked.withColumn(tie, F.monotonically_increasing_id()), "ordered")  # the partition's number above 33 bits of the place in it
    part = F.shiftright(tie, 33)
    starts = table.groupBy(part.alias("part")).count()
    starts = starts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))  # a row for each partition
    joined = table.withColumn("part", part).join(F.broadcast(starts), "part")
    return joined.withColumn("at", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "start")


def _pieces(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("piece", F.floor(F.col("at") / PIECE))


def _of_pieces(trees: DataFrame) -> DataFrame:
    """A row for each piece and tree that meet."""
    span = F.sequence(F.floor(F.col("first") / PIECE), F.floor((F.col("first") + F.col("n") - 1) / PIECE))
    return trees.select(F.explode(span).alias("piece"), "tree", "first", "n")


def _grown(leaves: DataFrame, trees: DataFrame, groups: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Stored nodes of all trees, and the needs of their pieces (steps 1 and 2)."""
    mine = _pieces(leaves).select("piece", "at", "digest").groupBy("piece").cogroup(_of_pieces(trees).groupBy("piece"))
    looked = written(mine.applyInArrow(_look(groups), _NODES), "pieces")
    nodes, now, levels = looked.where("digest IS NOT NULL"), looked.where("digest IS NOT NULL AND n IS NOT NULL"), BLOCK[0]
    while True:
        block = F.floor(F.col("place") * F.pow(F.lit(float(FAN)), F.col("level")) / F.lit(float(FAN) ** levels)).cast("long")
        now = written(now.withColumn("piece", block).groupBy("tree", "piece").applyInArrow(_climb, _NODES), "blocks")
        nodes = nodes.unionByName(now)
        if FAN**levels >= most:
            return nodes, looked.where("digest IS NULL")
        now, levels = nodes.where((F.col("level") >= levels) & F.col("n").isNotNull()), levels + BLOCK[1]


def build(rows: DataFrame, group: str, key: str, digest: str) -> Manifest:
    """The trees over ``rows``; further columns of ``rows`` stay with their leaves."""
    rows = rows.withColumnsRenamed({group: "group", key: "key", digest: "digest"})
    leaves = numbered(written(rows, "leaves"), "group", "key", "digest")
    sizes = written(leaves.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n")), "sizes")
    trees = written(numbered(sizes, "group").withColumnRenamed("at", "tree"), "trees")
    groups, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes, needs = _grown(leaves, trees, groups, most)
    roots = written(_roots(nodes.where(F.col("place") == 0)), "roots")
    top = rows.sparkSession.range(1 if groups else 0).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("first"), F.lit(groups).cast("long").alias("n"))
    upper, _ = _grown(roots.select(F.col("tree").alias("at"), "digest"), top, groups, groups)
    return Manifest(leaves, trees, nodes.unionByName(upper), needs, groups)


def _roots(nodes: DataFrame) -> DataFrame:
    """The highest node of each tree."""
    return nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))


def prove(made: Manifest) -> DataFrame:
    """Every leaf (group, key, digest and its further columns) with its place among the group's ``leaves``, subroot, root and proof."""
    told = _of_pieces(made.trees).select("piece", "tree", "first", "n", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"))
    fetched = made.needs.select("piece", "tree", "level", "place").join(made.nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"])
    no = F.lit(None).cast("long")
    fetched = written(fetched.select("piece", "tree", no.alias("first"), no.alias("n"), "level", "place", "digest").unionByName(told), "fetched")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.leaves.schema if f.name != "at")
    return (
        _pieces(made.leaves)
        .groupBy("piece")
        .cogroup(fetched.groupBy("piece"))
        .applyInArrow(_expand(made.groups), f"{kept}, place long, leaves long, subroot string, root string, proof {_PROOF}")
    )
