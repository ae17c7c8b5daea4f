"""SimHash near-duplicates by a segment-popcount embedding.

1. Fingerprint: word 4-shingles, XXH64 with seed 42, a bit set if it is set in over
   half of the hashes (repeats count).
2. Embedding: the 64 bits are 32 segments of two; a segment's count of set bits
   (0 to 2) is kept in unary, so the Manhattan distance of two embeddings is the
   popcount of their XOR.  It never exceeds the Hamming distance.
3. Grid range-join: points are the vectors of counts, cells are one count wide.  Probing
   the neighbour cells within ``MAX_BITS`` of a point in 32 dimensions would take tens of
   thousands of probes, so cells are joined by their faces: the segments form B blocks,
   and of two points within the bound at most ``MAX_BITS`` blocks differ.  A face is the
   counts of B - MAX_BITS blocks; all neighbour cells that differ in the other blocks
   lie on it, and a point is put on its face for each choice of blocks.  So the equi-join
   on faces is the range join over neighbour cells, and it misses none.  B grows with the
   number of fingerprints so that a face holds few unrelated texts; the links found are
   the same for every B.
4. On a face, pairs that pass the Manhattan bound are verified on the fingerprints.
   Only links that connect something new there are kept (a spanning forest), so a group
   of n near copies gives n - 1 links, not n squared.  A face of over ``SPLIT_ROWS``
   fingerprints is dealt out once more, by the bits of each four of eight bytes: two
   fingerprints within the bound agree in four bytes at least, so no link is lost.
5. Components of the links over nodes numbered in the order of their first doc_id, so
   a component's smallest node gives its name, its smallest doc_id.

Cases: null text counts as empty and has fingerprint zero, which links like any
other; fewer than four words make one shingle of them all; null ids take part, but
never name a component unless all its ids are null; repeated rows each get a row.
Very long texts are read in blocks of 1 MB.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, give_back, small_batches, tasks, word_blocks, written

#: Fixed by the contract.
SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Cells of unrelated fingerprints hold about so many at most.
CELL_ROWS = 128
#: From this many rows on, a cell is walked breadth first instead of pair by pair.
WALK_ROWS = 64
#: Faces of more fingerprints are split by a second grid.
SPLIT_ROWS = 20_000

_EVEN = 0x5555555555555555


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    set_bits, total, digest = np.zeros(64, np.int64), 0, partial(xxh64_intdigest, seed=SEED)
    for words in word_blocks(raw.lower(), overlap=width - 1):
        if not words:
            continue
        if len(words) < width:
            if total:
                continue
            texts, n = [b" ".join(words)], 1
        else:
            n = len(words) - width + 1
            texts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        bits = np.unpackbits(np.fromiter(map(digest, texts), np.uint64, n).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
        total += n
    return int(np.packbits(set_bits * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        fps = [fingerprint(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "row", "fp"])
    give_back()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, fp (the fingerprint as a signed long)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), text.alias("raw")).mapInArrow(_fingerprint_batches, "doc_id long, row long, fp long")


def blocks_for(n: int) -> int:
    """The least number of blocks with which a cell of unrelated fingerprints stays small.

    Two independent segments agree on their count with probability 3/8.
    """
    blocks = MAX_BITS + 2
    while n * (3 / 8) ** (32 * (blocks - MAX_BITS) / blocks) > CELL_ROWS and blocks < 12:
        blocks += 1
    return blocks


def cell_masks(blocks: int) -> list[int]:
    """For each choice of blocks - MAX_BITS blocks, the bits of their segments (signed)."""
    parts = []
    for segments in np.array_split(np.arange(32), blocks):
        parts.append(sum(3 << (2 * int(s)) for s in segments))
    masks = [sum(chosen) for chosen in combinations(parts, blocks - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def embedding(fp):
    """Unary counts of the two-bit segments, as a Column over a signed long."""
    next_bit = F.shiftrightunsigned(fp, 1)
    high = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_EVEN))
    low = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_EVEN))
    return F.shiftleft(high, 1).bitwiseOR(low)


def _unary(x: np.ndarray) -> np.ndarray:
    even, one = np.uint64(_EVEN), np.uint64(1)
    return ((x & (x >> one) & even) << one) | ((x | (x >> one)) & even)


def _near(counts, fps, one_counts, one_fp):
    """Manhattan bound first, then the exact distance."""
    passed = np.flatnonzero(np.bitwise_count(counts ^ one_counts) <= MAX_BITS)
    return passed[np.bitwise_count(fps[passed] ^ (one_fp if np.ndim(one_fp) == 0 else one_fp[passed])) <= MAX_BITS]


def _walk(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of one cell, as places: each text is compared with those not reached yet only."""
    found, rest, queue = [], np.arange(len(fps)), []
    counts = _unary(fps)
    while len(rest) > 1 or queue:
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        if not len(rest):
            break
        hit = _near(counts[rest], fps[rest], counts[at], fps[at])
        if len(hit):
            found.append((np.full(len(hit), at), rest[hit]))
            queue.extend(rest[hit])
            left = np.ones(len(rest), bool)
            left[hit] = False
            rest = rest[left]
    return found


def _cell_links(cells: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of whole cells, as places; rows come ordered by cell."""
    found = []
    start = np.flatnonzero(np.concatenate(([True], np.any(cells[1:] != cells[:-1], axis=1))))
    length = np.diff(np.concatenate((start, [len(fps)])))
    for s, n in zip(start[length > WALK_ROWS], length[length > WALK_ROWS], strict=True):
        found += [(s + a, s + b) for a, b in _walk(fps[s : s + n])]
    run = np.repeat(np.arange(len(start)), length)
    few = np.flatnonzero(np.repeat((length > 1) & (length <= WALK_ROWS), length))
    run, fps = run[few], fps[few]
    counts = _unary(fps)
    for d in range(1, WALK_ROWS):  # every pair of a small cell, one distance in the order at a time
        same = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else []
        if not len(same):
            break
        hit = same[_near(counts[same], fps[same], counts[same + d], fps[same + d])]
        if len(hit):
            found.append((few[hit], few[hit + d]))
    return found


def _link_batches(batches):
    """a, b (nodes) of the links; batches: choice, cell, fp, node, whole cells one after another."""
    held: list[np.ndarray] = []  # parts of the cell that may go on, put together once it has ended

    def out(rows):
        found = _cell_links(rows[:, :2], rows[:, 2].view(np.uint64)) if len(rows) > 1 else []
        if found:
            a, b = (rows[np.concatenate(x), 3] for x in zip(*found, strict=True))
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        other = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
        if len(other) or (held and (held[-1][-1, :2] != rows[-1, :2]).any()):  # a cell ends in this batch
            cut = other[-1] + 1 if len(other) else 0
            yield from out(np.concatenate((*held, rows[:cut])))
            held, rows = [], rows[cut:]
        held.append(rows)
    if held:
        yield from out(np.concatenate(held))


def _byte_masks() -> list[int]:
    """For each choice of four of eight bytes, their bits (signed)."""
    masks = [sum(0xFF << (8 * k) for k in chosen) for chosen in combinations(range(8), 8 - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, n: int) -> DataFrame:
    """a, b (nodes): links that connect what is connected, among distinct fingerprints (node, fp)."""
    spark = distinct.sparkSession
    chosen = [F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks(blocks_for(n)))]
    cells = distinct.select("fp", "node", embedding(F.col("fp")).alias("counts")).select("fp", "node", F.explode(F.array(*chosen)).alias("c")).select("c.choice", "c.cell", "fp", "node")
    hot = written(cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS).select("choice", "cell"), "hot")
    if not hot.isEmpty():
        again = [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_byte_masks())]
        dealt = cells.join(hot, ["choice", "cell"], "left_semi").withColumn("s", F.explode(F.array(*again)))
        named = F.xxhash64("cell", "s.bits").alias("cell")  # two parts under one name cost a comparison, no link
        cells = cells.join(hot, ["choice", "cell"], "left_anti").unionByName(dealt.select((-1 - F.col("choice") * len(again) - F.col("s.part")).alias("choice"), named, "fp", "node"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50_000)
    found = written(cells.select("choice", "cell", "fp", "node").repartition(tasks(spark), "choice", "cell").sortWithinPartitions("choice", "cell", "fp").mapInArrow(_link_batches, "a long, b long"), "links")
    small_batches(spark)
    return found


def components(rows: DataFrame) -> DataFrame:
    """fp, component_id, component_row for rows (doc_id, row, fp), written: the doc_id and row that name each fingerprint's component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    order = ("no_id", "doc_id", "row")
    groups = rows.groupBy("fp").agg(first).select("fp", "first.*").repartitionByRange(tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    groups = written(groups.select("fp", F.col("doc_id").alias("component_id"), F.col("row").alias("component_row"), F.monotonically_increasing_id().alias("node")), "groups")
    member = connected_components(links(groups.select("fp", "node"), groups.count()))
    names = groups.select(F.col("node").alias("component"), "component_id", "component_row")
    of = groups.select("fp", "node").join(member, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return written(of.join(names, "component").select("fp", "component_id", "component_row"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, fingerprint (16 hex digits), component_id, named: a row for each row of ``docs``.

    ``row``: the unique long ``row_col``, or one given here; ``named`` holds for the one row that names its component.
    """
    rows = written(fingerprints(docs, id_col, text_col, row_col), "fingerprints")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(components(rows), "fp").select("doc_id", "row", text, "component_id", (F.col("row") == F.col("component_row")).alias("named"))
