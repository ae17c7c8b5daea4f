"""Benchmark decontamination by greedy string tiling.

A document and a test item share a seed where five tokens in a row are equal.  Joined
seeds give an upper bound of what tiles can cover of the item, as each tile is made of
seeds; pairs whose bound is below the threshold are left out, and lose nothing.
Each other pair is tiled: Karp-Rabin hashes of a shrinking window, rolled out of one
pass of prefix sums, find the matches; the longest are marked first, marked tokens are
never used again, and what is left of a match beside them waits for its turn at its new
length.  Of matches of one length the first in the item, then in the document, goes
first.  The share of the item's tokens under tiles decides, wherever the tiles stand in
the document, so reordered passages count in full.

The items are sent to the tasks in blocks of a bounded number of tokens, with one
narrow pass over the documents for each block (one block holds some 40,000 items), so
nothing is shuffled and no task holds more than a block, whatever the sizes.  Tokens are
runs of letters, digits and underscores in lower case.  A document's tokens are held as
numbers of eight bytes, read from the text in parts of 1 MB.

Cases: null text of a document or an item counts as empty; an item without tokens
never matches; an item of fewer than five tokens matches only as a whole; items that
repeat a text each give a row; a null doc_id or item_id is carried as null.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Shortest tile, and the least share of an item under tiles that counts as a leak.
MIN_TILE, MIN_COVERAGE = 5, 0.8
#: Tokens of test items in one broadcast block (about 150 MB with its seeds).
BLOCK_TOKENS = 4_000_000

LEAKS = "doc_id long, item_id long, coverage double, tiles long"

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def tokens(text: str, size: int = 1 << 20):
    """The tokens of a text, read in parts that do not cut one."""
    text, at = text.lower(), 0
    while at < len(text):
        end = at + size
        while end < len(text) and _TOKEN.match(text[end]):
            end += 1
        yield from _TOKEN.findall(text[at:end])
        at = end


class Rolling:
    """Karp-Rabin hashes (modulo 2**64) of every window of some ids, for any width, from one pass of prefix sums."""

    def __init__(self, ids: np.ndarray):
        power, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(ids), b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, _WORD + 1)))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * power[: len(ids)], dtype=np.uint64)))
        self.back = back

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.back[:n] if n > 0 else np.empty(0, np.uint64)


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE, item_hashes: Rolling | None = None, text_hashes: Rolling | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, then by place.

    Both are token ids; id 0 stands for a token that no item has.
    """
    least = min(least, len(item))
    free_item, free_text = np.ones(len(item), bool), text != 0
    hashes = item_hashes or Rolling(item), text_hashes or Rolling(text)
    tiles: list[tuple[int, int, int]] = []
    width = len(item)
    while least and free_item.any():
        waiting = _maximal(item, text, free_item, free_text, width, hashes)
        heapq.heapify(waiting)
        while waiting:
            minus, p, t = heapq.heappop(waiting)
            free = free_item[p : p - minus] & free_text[t : t - minus]
            if free.all():
                free_item[p : p - minus] = False
                free_text[t : t - minus] = False
                tiles.append((p, t, -minus))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= width:
                    heapq.heappush(waiting, (a - b, p + a, t + a))
        if width == least:
            break
        width = max(least, width // 2)
    return tiles


def _maximal(item, text, free_item, free_text, width, hashes) -> list[tuple[int, int, int]]:
    """(minus length, start in item, start in text) of unmarked matches of at least ``width``, as long as they can be."""

    def open_windows(free):
        run = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(run[width:] == run[:-width]) if len(free) >= width else np.empty(0, int)

    here, there = open_windows(free_item), open_windows(free_text)
    if not len(here) or not len(there):
        return []
    wanted = hashes[0].windows(width)[here]
    order = np.argsort(wanted, kind="stable")
    found = hashes[1].windows(width)[there]
    low, high = np.searchsorted(wanted[order], found, "left"), np.searchsorted(wanted[order], found, "right")
    out, covered = [], set()
    for t, a, b in zip(there[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
        for p in here[order[a:b]].tolist():
            if (t - p, p) in covered or (item[p : p + width] != text[t : t + width]).any():
                continue
            length = width
            while p + length < len(item) and t + length < len(text) and free_item[p + length] and free_text[t + length] and item[p + length] == text[t + length]:
                length += 1
            covered.update((t - p, q) for q in range(p, p + length - width + 1))
            out.append((-length, p, t))
    return out


class Items:
    """A block of test items: vocabulary, token ids, and by width of seed the sorted hashes with their items and places."""

    def __init__(self, rows: list[tuple], least: int = MIN_TILE):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        made: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text or "")], np.uint32)
            if len(ids):
                width = min(least, len(ids))
                made.setdefault(width, []).append((Rolling(ids).windows(width), len(self.items)))
                self.items.append((item_id, ids))
        self.seeds = {}
        for width, parts in made.items():
            hashes = np.concatenate([h for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            owner = np.concatenate([np.full(len(h), k, np.int32) for h, k in parts])[order]
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in parts])[order]
            self.seeds[width] = (hashes[order], owner, place)

    def candidates(self, ids: np.ndarray, hashes: Rolling, coverage: float) -> list[int]:
        """Items of which the seeds that ``ids`` has too cover at least ``coverage``."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        out: list[int] = []
        for width, (seeds, owner, place) in self.seeds.items():
            at = np.flatnonzero(unknown[width:] == unknown[:-width]) if len(ids) >= width else np.empty(0, int)
            found = np.unique(hashes.windows(width)[at])
            low, high = np.searchsorted(seeds, found, "left"), np.searchsorted(seeds, found, "right")
            low, n = low[high > low], (high - low)[high > low]
            if not len(low):
                continue
            entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            entry = entry[np.lexsort((place[entry], owner[entry]))]
            own, start = owner[entry], place[entry]
            step = np.full(len(entry), width)
            same = own[1:] == own[:-1]
            step[:-1][same] = np.minimum(width, np.diff(start)[same])
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            covered = np.add.reduceat(step, first)
            out += [k for k, c in zip(own[first].tolist(), covered.tolist(), strict=True) if c / len(self.items[k][1]) >= coverage]
        return sorted(out)

    def matches(self, words, coverage: float):
        """(item_id, share of the item under tiles, number of tiles) of the items that leaked into a text."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32)
        hashes = Rolling(ids)
        for k in self.candidates(ids, hashes, coverage):
            item_id, item = self.items[k]
            tiles = tile(item, ids, self.least, text_hashes=hashes)
            share = sum(t[2] for t in tiles) / len(item)
            if share >= coverage:
                yield item_id, share, len(tiles)


def _blocks(benchmark: DataFrame, least: int) -> list:
    """Broadcast blocks of items; each holds at most BLOCK_TOKENS tokens, or one item.

    Test items are what people wrote to be scored, not a corpus: the driver reads
    them as a stream and keeps one block at a time.
    """
    context, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator():
        n = len(text) // 3 + 1
        if held and size + n > BLOCK_TOKENS:
            out.append(context.broadcast(Items(held, least)))
            held, size = [], 0
        held.append((item_id, text))
        size += n
    return [*out, context.broadcast(Items(held, least))] if held else out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = MIN_COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """doc_id, item_id, coverage, tiles: a row for each test item that leaked into a row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for block in _blocks(benchmark, least):
        found = found.unionByName(rows.mapInArrow(_search(block, coverage), LEAKS))
    return found


def _search(block, coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())])

    def search(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                out += [(doc_id.as_py(), *m) for m in block.value.matches(tokens(text.as_py()), coverage)]
            columns = zip(*out, strict=True) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
        give_back()

    return search
