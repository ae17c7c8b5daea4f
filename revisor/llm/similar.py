"""Texts alike by word shingles: candidates by MinHash bands, each pair verified on its whole sets.

1. A text's set is the hashes (XXH64, seed 42) of its shingles of ``width`` lower-case
   words; fewer words make one shingle of them all.
2. ``BANDS`` times ``ROWS`` minima of the permuted set; the minima of a band name a cell.
   Two texts of Jaccard s share a cell with probability 1 - (1 - s^ROWS)^BANDS: 0.9999
   at 0.8, more above.
3. In cells of up to ``CELL_ROWS`` texts all pairs are candidates.  In larger cells
   the text of the least id leads and is compared with all; it leaves the cell, and so
   do texts found to be like one of a smaller id.  What is left in large cells goes to
   new ones: the rarest shingles of a text, n - ceil(s n) + 1 of its n at the similarity
   s, counted among these texts.  Two texts of that Jaccard share one, and for the
   shorter it is among its first n - ceil(2 s / (1 + s) n) + 1; there the text is
   ``short`` of the cell.  So nothing is lost, while texts that a common passage brought
   together share none.  In these cells leaders, taken from those that are short of
   them, go on, four times as many each round, until none is left, so a group of n copies
   gives about n candidates and nothing is capped.
4. A byte of each minimum makes a signature.  Candidates whose sizes allow the
   similarity and whose signatures agree in ``NEAR`` or more of the places go on; a pair
   at 0.8 fails that with probability 1e-7.
5. Of each text's candidates the one of the best agreement is verified by exact Jaccard
   on the whole sets; where that fails, the others are.

What is named as ``gone`` is like a text of a smaller id; of what is not gone, no pair
that shares a cell is alike.

Cases: null and empty texts have no shingle and are like nothing; ids must be unique
and not null; very long texts are read in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import among, drop_written, give_back, small_batches, word_blocks, written

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Cells up to this size are compared pair by pair.
CELL_ROWS = 16
#: Share of equal signature bytes from which on a candidate is verified; it stands for a similarity of 0.8.
NEAR = 0.61

_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_NAMES = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text."""
    parts, digest = [], partial(xxh64_intdigest, seed=42)
    for words in word_blocks(raw.lower(), overlap=width - 1):
        if len(words) >= width:
            texts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            parts.append(np.fromiter(map(digest, texts), np.uint64, len(words) - width + 1))
        elif words and not parts:
            parts.append(np.array([digest(b" ".join(words))], np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def sketch_of(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The name of the text's cell in each band, and its signature."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[at : at + 2048, None] ^ _XOR) * _TIMES).min(axis=0))
    names = _NAMES
    for row in least.reshape(BANDS, ROWS).T:
        names = (names ^ row) * _FOLD
        names ^= names >> np.uint64(29)
    return names.view(np.int64), (least * _FOLD >> np.uint64(56)).astype(np.uint8).tobytes()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def _sketch(width: int):
    def sketch(batches):
        for batch in batches:
            ids, sizes, marks, cells = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(raw.as_py(), width)
                if len(found):
                    names, mark = sketch_of(found)
                    ids.append(doc_id)
                    sizes.append(len(found))
                    marks.append(mark)
                    cells.append(names)
            flat = pa.array(np.concatenate(cells) if cells else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists], names=["doc_id", "n", "mark", "cells"])
        give_back()

    return sketch


def _agree(batches):
    """Share of equal signature bytes of each pair."""
    for batch in batches:
        if len(batch):
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("mark_a", "mark_b"))
            share = (one == two).mean(axis=1)
            near = pa.array(share >= NEAR)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"]).filter(near)


def _sets(width: int):
    def sets(batches):
        for batch in batches:
            made = [shingles(raw.as_py(), width).tobytes() for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "set"])
        give_back()

    return sets


def _elements(width: int):
    def elements(batches):
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(raw.as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), doc_id)), pa.array(found)], names=["doc_id", "cell"])
        give_back()

    return elements


def _by_rare_shingles(texts: DataFrame, sketches: DataFrame, ids: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, cell, short: of each text of ``ids`` those of its rarest shingles that a text like it must share, if another text has them."""
    elements = written(among(texts, "doc_id", ids).mapInArrow(_elements(width), "doc_id long, cell long"), "elements")
    frequency = written(elements.groupBy("cell").agg(F.count("*").alias("texts")).where("texts > 1"), "frequency")
    shared = elements.join(frequency, "cell").join(sketches.select("doc_id", "n"), "doc_id")
    text = Window.partitionBy("doc_id")  # a text's own shingles
    alone = F.col("n") - F.count("*").over(text)  # shingles of no other text come first
    place = alone + F.row_number().over(text.orderBy("texts", "cell"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1
    rows = shared.withColumn("place", place).where(F.col("place") <= first(least))
    rows = written(rows.select("doc_id", "cell", (F.col("place") <= first(2 * least / (1 + least))).alias("short")), "cells")
    for table in (elements, frequency):
        drop_written(table)
    return rows


def _alike(least: float):
    def alike(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return alike


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _verified(texts: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard is ``least`` or more, written."""
    sets = written(among(texts, "doc_id", _ends(pairs)).mapInArrow(_sets(width), "doc_id long, set binary"), "sets")
    one, two = (sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    alike = written(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(_alike(least), "a long, b long"), "alike")
    drop_written(sets)
    return alike


def _alike_pairs(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """Of candidates (a, b), pairs that are alike: at least one for each b that has any."""
    own = among(sketches, "doc_id", _ends(pairs))
    one, two = (own.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("mark").alias(f"mark_{x}")) for x in "ab")
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least)
    near = written(pairs.join(one, "a").join(two, "b").where(fits).select("a", "b", "mark_a", "mark_b").mapInArrow(_agree, "a long, b long, share double"), "near")
    best = written(near.groupBy("b").agg(F.max(F.struct("share", (-F.col("a")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("a"), "b"), "best")
    alike = _verified(texts, best, width, least)
    others = written(near.select("a", "b").join(alike.select("b").distinct(), "b", "left_anti").join(best, ["a", "b"], "left_anti"), "others")
    if not others.isEmpty():
        alike = alike.unionByName(_verified(texts, others, width, least))
    for table in (near, best, others):
        drop_written(table)
    return alike


def like_smaller(docs: DataFrame, id_col: str, text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """gone (id), like (a smaller id): verified pairs."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, id_col, text_col)
    sketches = written(texts.mapInArrow(_sketch(width), "doc_id long, n long, mark binary, cells array<long>"), "sketches")
    rows, found, leaders = sketches.select("doc_id", F.explode("cells").alias("cell"), F.lit(True).alias("short")), [], 1
    judged: list[DataFrame] = []
    while True:
        sizes = written(rows.groupBy("cell").agg(F.count("*").alias("size"), F.some("short").alias("open")).where("size > 1 AND open").select("cell", "size"), "sizes")  # written: a join on it may then split a frequent cell
        shared = written(rows.join(sizes, "cell"), "shared")
        few, many = shared.where(F.col("size") <= CELL_ROWS), shared.where(F.col("size") > CELL_ROWS)
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(leaders))
        lead = written(many.where("short").groupBy("cell", salt.alias("salt")).agg(F.min("doc_id").alias("other")).select("cell", "other"), "leaders")
        every = few.join(few.select("cell", F.col("doc_id").alias("other"), F.col("short").alias("other_short")), "cell").where("other < doc_id AND (short OR other_short)")
        pairs = every.select("doc_id", "other").unionByName(many.join(lead, "cell").where("other <> doc_id").select("doc_id", "other"))
        pairs = pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        if judged:  # pairs once judged are not made again
            pairs = pairs.join(reduce(DataFrame.unionByName, judged), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        alike = _alike_pairs(texts, sketches, pairs, width, least)
        found.append(alike)
        judged.append(pairs)
        if lead.isEmpty():
            for table in judged:
                drop_written(table)
            return reduce(DataFrame.unionByName, found).select(F.col("b").alias("gone"), F.col("a").alias("like"))
        left = many.join(lead.withColumnRenamed("other", "doc_id"), ["cell", "doc_id"], "left_anti")
        gone = written(alike.select(F.col("b").alias("doc_id")).distinct(), "gone")
        rest = left.join(gone, "doc_id", "left_anti")
        if len(found) == 1:
            rows = _by_rare_shingles(texts, sketches, rest.select("doc_id"), width, least)
        else:
            rows, leaders = written(rest.select("doc_id", "cell", "short"), "cells"), 4 * leaders
        drop_written(shared)
