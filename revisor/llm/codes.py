"""Vector code compression: each part of a vector as an entry of a small codebook.

Components become integers (floor of ``SCALE`` times their value) and vectors are cut
into ``PARTS`` equal parts.  A codebook starts as the parts of the first ``ENTRIES``
vectors; each round assigns every part to its nearest entry and moves the entries to
the floors of their parts' means.

Assignment goes through metric trees.  A task cuts its rows into pieces of ``PIECE``
vectors and builds one tree for each part position by the anchors hierarchy: about as
many anchors as the root of the piece's size each win the points nearest to them, balls
around anchors are merged pairwise to a root (middle out), and those of many points are
split in the same way.  A ball caches the sum and the count of its points.  In a round
the root starts with all entries; a ball drops each entry that another is nearer than
for every point within its radius, and hands the rest down; once one entry is left the
ball is wholly owned and its cached sum and count go to it.  Only leaves that are still
disputed compare their points one by one, in whole numbers, so codes are exact.

The trees are written once in the shared folder and read in each round.  What reaches
the driver in a round is one row for each part, entry and component.

Cases: rows whose vector is null or holds null, NaN or infinity are dropped; null ids
come last among starting vectors, ties are ordered by the vector; fewer vectors than
entries make shorter codebooks; no vectors give no rows; labels may be null.  A vector
whose length is not that of the others, or not a multiple of ``PARTS``, is an error, as
is a value whose squared distances do not fit in 62 bits.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one set of trees (of 64 components; fewer of longer ones, so that it has some 10 MB), and points up to which a ball is a leaf.
PIECE, LEAF = 8192, 128


# ------------------------------------------------------------------ trees


def _away(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - at) ** 2).sum(1))


def _anchors(points: np.ndarray, most: int) -> list[np.ndarray]:
    """The points (by index) that each of at most ``most`` anchors owns.

    An anchor's points are kept farthest first: only those farther from it than half
    its way to a new anchor can change hands, so the others are not looked at.
    """
    far = _away(points, points[0])
    order = np.argsort(-far, kind="stable")
    at, own, dist = [points[0]], [order], [far[order]]
    while len(at) < most:
        i = max(range(len(at)), key=lambda k: dist[k][0])
        if dist[i][0] == 0:
            break
        new, won, won_dist = points[own[i][0]], [], []
        for k, anchor in enumerate(at):
            near = int(np.searchsorted(-dist[k], -np.sqrt(((anchor - new) ** 2).sum()) / 2))
            if not near:
                continue
            d = _away(points[own[k][:near]], new)
            taken = d < dist[k][:near]
            if taken.any():
                won.append(own[k][:near][taken])
                won_dist.append(d[taken])
                stays = np.concatenate([~taken, np.ones(len(own[k]) - near, bool)])
                own[k], dist[k] = own[k][stays], dist[k][stays]
        won, won_dist = np.concatenate(won), np.concatenate(won_dist)
        order = np.argsort(-won_dist, kind="stable")
        at.append(new)
        own.append(won[order])
        dist.append(won_dist[order])
        kept = [k for k in range(len(at)) if len(own[k])]
        at, own, dist = ([x[k] for k in kept] for x in (at, own, dist))
    return own


def _hierarchy(points: np.ndarray, ids: np.ndarray) -> tuple:
    """A node: (left, right, None), or (None, None, ids) where few points, or equal ones, are left."""
    if len(ids) <= LEAF:
        return None, None, ids
    balls = _anchors(points[ids], max(2, int(len(ids) ** 0.5)))
    if len(balls) == 1:
        return None, None, ids
    nodes = [_hierarchy(points, ids[own]) for own in balls]
    size = np.array([len(own) for own in balls], float)
    centre = np.array([points[ids[own]].mean(0) for own in balls])
    radius = np.array([_away(points[ids[own]], c).max() for own, c in zip(balls, centre, strict=True)])
    gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2))
    cost = np.maximum((gap + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(balls) - 1):  # merge the two balls with the smallest ball around them
        a, b = np.unravel_index(cost.argmin(), cost.shape)
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        radius[a], size[a] = cost[a, b], size[a] + size[b]
        nodes[a] = (nodes[a], nodes[b], None)
        size[b] = 0
        gone = size == 0
        cost[a] = np.maximum((np.sqrt(((centre - centre[a]) ** 2).sum(1)) + radius + radius[a]) / 2, np.maximum(radius, radius[a]))
        cost[a, gone] = cost[a, a] = np.inf
        cost[:, a] = cost[a]
        cost[b] = cost[:, b] = np.inf
    return nodes[int(np.flatnonzero(size)[0])]


def build_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of whole-number ``points`` as arrays; node 0 is the root, and a node's points are ``order[start:end]``."""
    floats = points.astype(float)
    order, rows = [], []  # a row: start, end, left, right

    def lay(node: tuple) -> int:
        mine, start = len(rows), sum(map(len, order))
        rows.append(None)
        if node[2] is not None:
            order.append(node[2])
            rows[mine] = (start, start + len(node[2]), -1, -1)
        else:
            left, right = lay(node[0]), lay(node[1])
            rows[mine] = (start, rows[right][1], left, right)
        return mine

    lay(_hierarchy(floats, np.arange(len(points))))
    order, nodes = np.concatenate(order), np.array(rows, np.int32)
    laid, centre, radius, total = points[order], [], [], []
    for start, end, _, _ in nodes:
        total.append(laid[start:end].sum(0))
        centre.append(total[-1] / (end - start))
        radius.append(_away(laid[start:end], centre[-1]).max())
    return {"order": order.astype(np.int32), "points": laid, "nodes": nodes, "centre": np.array(centre), "radius": np.array(radius), "total": np.array(total)}


def owners(tree: dict[str, np.ndarray], book: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points nearest to each entry; ``codes`` gets each point's entry."""
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    nodes, points, order = tree["nodes"], tree["points"], tree["order"]
    gap = np.sqrt(((book[:, None] - book[None]).astype(float) ** 2).sum(2))
    square = ((tree["centre"][:, None] - book[None]) ** 2).sum(2)
    margin = 1e-9 * (1 + book.shape[1] * float(max(abs(book).max(), abs(points).max())) ** 2)  # far beyond what rounding can do
    at, left = np.array([0]), np.ones((1, len(book)), bool)
    while len(at):
        here = np.where(left, square[at], np.inf)
        best = here.argmin(1)
        each = np.arange(len(at))
        # At any point of the ball the best entry's squared distance exceeds another's by at most this.
        excess = here[each, best][:, None] - here + 2 * tree["radius"][at][:, None] * gap[best]
        left &= ~(excess < -margin)
        owned, leaf = left.sum(1) == 1, nodes[at, 2] < 0
        np.add.at(sums, best[owned], tree["total"][at[owned]])
        np.add.at(counts, best[owned], nodes[at[owned], 1] - nodes[at[owned], 0])
        if codes is not None:
            for k in np.flatnonzero(owned):
                codes[order[nodes[at[k], 0] : nodes[at[k], 1]]] = best[k]
        for k in np.flatnonzero(~owned & leaf):
            start, end = nodes[at[k], :2]
            some, own = np.flatnonzero(left[k]), points[start:end]
            found = some[((own[:, None] - book[some][None]) ** 2).sum(2).argmin(1)]
            np.add.at(sums, found, own)
            counts += np.bincount(found, minlength=len(book))
            if codes is not None:
                codes[order[start:end]] = found
        down = ~owned & ~leaf
        at, left = nodes[at[down], 2:].ravel(), np.repeat(left[down], 2, axis=0)
    return sums, counts


# ------------------------------------------------------------------ tasks


def _packed(tree: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tree)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return dict(found)


def _whole(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if not all(n == dims for n in pc.list_value_length(flat).to_pylist()):
        raise ValueError(f"vectors are not all of length {dims}")
    found = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE)
    if len(found) and dims * (2 * abs(found).max()) ** 2 >= 2.0**62:
        raise ValueError("squared distances of these values do not fit in 62 bits")
    return found.astype(np.int64).reshape(-1, dims)


def _plant(dims: int):
    """Trees of the pieces of a task's rows."""
    most = max(2, PIECE * 64 // max(64, dims))

    def piece(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        vectors = _whole(table["embedding"], dims)
        trees = [_packed(build_tree(p)) for p in np.split(vectors, PARTS, axis=1)]
        whole = lambda name: pa.array([table[name].to_pylist()], pa.list_(table.schema.field(name).type))
        return pa.RecordBatch.from_arrays([whole("vec_id"), whole("label"), pa.array([trees], pa.list_(pa.binary()))], ["vec_id", "label", "trees"])

    def plant(batches):
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= most:
                held.append(batch.slice(0, most - n))
                batch, n = batch.slice(most - n), 0
                yield piece(held)
                held = []
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield piece(held)

    return plant


def _each(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def _gather(books: list[np.ndarray]):
    """A task's sums and counts for each part and entry."""

    def gather(batches):
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for row in _each(batches):
            for p, raw in enumerate(row["trees"][0].as_py()):
                s, c = owners(_unpacked(raw), books[p])
                sums[p] += s
                counts[p] += c
        found = [(p, k, int(counts[p][k]), sums[p][k].tolist()) for p in range(len(books)) for k in np.flatnonzero(counts[p])]
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "entry", "n", "total"])

    return gather


def _encode(books: list[np.ndarray]):
    def encode(batches):
        for row in _each(batches):
            ids, labels = row["vec_id"].flatten(), row["label"].flatten()
            codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
            for p, raw in enumerate(row["trees"][0].as_py()):
                tree, mine = _unpacked(raw), np.zeros(len(ids), np.int64)
                owners(tree, books[p], mine)
                codes[:, p] = mine
                error[tree["order"]] += ((tree["points"] - books[p][mine[tree["order"]]]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return encode


# ------------------------------------------------------------------ over the table


def kept(vectors: DataFrame) -> DataFrame:
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull() & sound)


def encode(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """A row for each kept vector (vec_id, label, code, error), and the final codebook of each part."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = kept(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()  # ``entries`` rows
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if not first:
        return spark.createDataFrame([], coded), []
    dims = len(first[0].embedding)
    if not dims or dims % PARTS:
        raise ValueError(f"a vector of {dims} components has no {PARTS} equal parts")
    start = _whole(pa.array([r.embedding for r in first], pa.list_(pa.float64())), dims)
    books = list(np.split(start, PARTS, axis=1))
    trees = written(rows.mapInArrow(_plant(dims), f"vec_id array<{types['vec_id']}>, label array<{types['label']}>, trees array<binary>"), "trees")
    for _ in range(rounds):
        found = trees.mapInArrow(_gather(books), "part int, entry int, n long, total array<long>")
        totals = found.select("part", "entry", "n", F.posexplode("total").alias("place", "total")).groupBy("part", "entry", "place")
        books = [b.copy() for b in books]
        for r in totals.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # entries x dims rows
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return trees.mapInArrow(_encode(books), coded), books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Errors summed over equal labels; a written table, so that Spark joins it by its size and splits a frequent label."""
    coded = written(coded, "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "totals")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
