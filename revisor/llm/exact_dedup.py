"""Exact deduplication on an index of cuckoo filters over bucketed digests.

The index is two tables.  A digest belongs to the bucket its hash names; each bucket
has one cuckoo filter, and one row of content for each live digest.  Insertion and
deletion send a batch to the filters of its buckets alone.  What the filter does not
know is new: it goes into the filter and is appended to the content unseen.  What the
filter may know is looked up in the stored content, which is read for those hits only:
a verified hit is merged into its row, a false one is added like a new digest.  A
filter that overflows is rebuilt at twice the size from the stored keys of its bucket.

Cases: null text counts as empty; null ids sort last among copies and a group of
null ids only has a null keeper; of rows that repeat an id and a text one is kept, the
first of them as they are stored; an empty table gives an empty index.  Other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tasks, written

#: The six characters that do not count when texts are compared (fixed by the contract).
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Live digests that a bucket should hold: about 20 MB in the task that updates its filter.
BUCKET_KEYS = 50_000
#: Batches in which a table enters a new index: filters are sized for the first and overflow later.
BATCHES = 3

FILTERS = "bucket int, filter binary"
_STORED = "keep_id long, keep_chars long, keep_row long, copies long"
CONTENT = f"bucket int, digest string, {_STORED}"


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit tags, four to a slot group, two groups a key."""

    WAYS, KICKS = 4, 200

    def __init__(self, groups: int, tags: array | None = None):
        self.groups = groups
        self.tags = tags if tags is not None else array("H", bytes(2 * self.WAYS * groups))

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        groups = 1
        while groups * cls.WAYS * 0.85 < keys:
            groups *= 2
        return cls(groups)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        tags = array("H")
        tags.frombytes(raw)
        return cls(len(tags) // cls.WAYS, tags)

    def _places(self, digest: str) -> tuple[int, int, int]:
        tag = int(digest[:4], 16) or 1
        first = int(digest[4:20], 16) & (self.groups - 1)
        return tag, first, self._other(first, tag)

    def _other(self, group: int, tag: int) -> int:
        return (group ^ (tag * 0x5BD1E995)) & (self.groups - 1)

    def _slot(self, group: int, tag: int) -> int:
        for i in range(group * self.WAYS, (group + 1) * self.WAYS):
            if self.tags[i] == tag:
                return i
        return -1

    def __contains__(self, digest: str) -> bool:
        tag, one, two = self._places(digest)
        return self._slot(one, tag) >= 0 or self._slot(two, tag) >= 0

    def add(self, digest: str) -> bool:
        """False when no place is found; the filter must then be rebuilt."""
        tag, one, two = self._places(digest)
        for group in (one, two):
            if (i := self._slot(group, 0)) >= 0:
                self.tags[i] = tag
                return True
        group = two
        for kick in range(self.KICKS):
            i = group * self.WAYS + kick % self.WAYS
            tag, self.tags[i] = self.tags[i], tag
            group = self._other(group, tag)
            if (free := self._slot(group, 0)) >= 0:
                self.tags[free] = tag
                return True
        return False

    def remove(self, digest: str) -> None:
        tag, one, two = self._places(digest)
        i = self._slot(one, tag)
        i = i if i >= 0 else self._slot(two, tag)
        if i >= 0:
            self.tags[i] = 0


def _filled(keys, room: int) -> CuckooFilter:
    """A filter that holds the keys, doubled until all find a place."""
    while True:
        made = CuckooFilter.sized(room)
        if all(made.add(k) for k in keys):
            return made
        room *= 2


@dataclass(frozen=True)
class Index:
    """``filters`` has a row for each bucket in use, ``content`` one for each live digest; both are written tables."""

    filters: DataFrame
    content: DataFrame
    buckets: int


def new_index(spark: SparkSession, buckets: int) -> Index:
    return Index(spark.createDataFrame([], FILTERS), spark.createDataFrame([], CONTENT), buckets)


_ASKED = pa.schema([("bucket", pa.int32()), ("filter", pa.binary()), ("digest", pa.string()), ("hit", pa.bool_())])


def _asked(bucket: int, tags: bytes | None, digests: list[str], hits: list[bool]) -> pa.Table:
    """A row for the bucket's filter (null: it overflowed), and one for each digest."""
    n = len(digests)
    columns = [pa.array([bucket] * (n + 1), pa.int32()), pa.array([tags] + [None] * n, pa.binary()), pa.array([None, *digests], pa.string()), pa.array([None, *hits], pa.bool_())]
    return pa.Table.from_arrays(columns, schema=_ASKED)


def _held(filters: pa.Table, room: int) -> CuckooFilter:
    return CuckooFilter.from_bytes(filters.column("filter")[0].as_py()) if len(filters) else CuckooFilter.sized(max(64, room))


def _probe_and_add(key, filters, batch):
    """Asks the filter for every digest of the batch, then adds those it does not know."""
    digests = batch.column("digest").to_pylist()
    index = _held(filters, len(digests))
    hits = [d in index for d in digests]
    new = [d for d, hit in zip(digests, hits, strict=True) if not hit]
    fits = all(index.add(d) for d in new)
    if not fits and not len(filters):  # a new bucket: all its keys are here
        index, fits = _filled(new, 2 * len(new)), True
    return _asked(key[0].as_py(), index.tags.tobytes() if fits else None, digests, hits)


def _probe(key, filters, batch):
    digests = batch.column("digest").to_pylist()
    index = _held(filters, 0)
    return _asked(key[0].as_py(), index.tags.tobytes(), digests, [d in index for d in digests])


def _add(key, filters, batch):
    index = _held(filters, len(batch))
    fits = all(index.add(d) for d in batch.column("digest").to_pylist())
    return _asked(key[0].as_py(), index.tags.tobytes() if fits else None, [], [])


def _remove(key, filters, gone):
    index = _held(filters, 0)
    for digest in gone.column("digest").to_pylist():
        index.remove(digest)
    return _asked(key[0].as_py(), index.tags.tobytes(), [], [])


def _rebuild(key, content):
    keys = content.column("digest").to_pylist()
    made = _filled(keys, 2 * len(keys))
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([made.tags.tobytes()], pa.binary())], names=["bucket", "filter"])


def _sent(index: Index, batch: DataFrame, use) -> DataFrame:
    """bucket, filter, digest, hit: what ``use`` makes of each bucket's filter and its part of the batch, written."""
    keys = batch.select("bucket", "digest")
    return written(index.filters.groupBy("bucket").cogroup(keys.groupBy("bucket")).applyInArrow(use, "bucket int, filter binary, digest string, hit boolean"), "asked")


def _with_rebuilt(filters: DataFrame, content: DataFrame) -> DataFrame:
    """``filters`` with those that are null made anew from the content of their buckets, written."""
    over = filters.where("filter is null").select("bucket")
    if over.isEmpty():
        return filters
    made = content.join(over, "bucket", "left_semi").select("bucket", "digest").groupBy("bucket").applyInArrow(_rebuild, FILTERS)
    return written(filters.where("filter is not null").unionByName(made), "filters")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row (``row_col``, or a number given here), digest (SHA-256 of the text without white space), n_chars (of the whole text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for c in SPACES:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row"),
        F.sha2(bare.cast("binary"), 256).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
    )


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


def batch_of(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each digest of the rows of ``digests``: CONTENT.

    Copies are aggregated before the shuffle, so a text that a third of the corpus
    repeats leaves each task as one row.
    """
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))  # negated: smaller ones are larger
    made = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("copies"))
    return made.select(
        _bucket(buckets), "digest", F.bitwise_not("best.id").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), F.bitwise_not("best.row").alias("keep_row"), "copies"
    )


def _merged(stored: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of the same digests as one row each: the better keeper and both counts."""
    both = stored.unionByName(hits)
    best = F.max(F.struct("keep_chars", F.bitwise_not("keep_id").alias("id"), F.bitwise_not("keep_row").alias("row")))
    made = both.groupBy("bucket", "digest").agg(best.alias("best"), F.sum("copies").alias("copies"))
    return made.select("bucket", "digest", F.bitwise_not("best.id").alias("keep_id"), F.col("best.keep_chars").alias("keep_chars"), F.bitwise_not("best.row").alias("keep_row"), "copies")


def insert(index: Index, rows: DataFrame) -> Index:
    """The index with the rows of ``digests`` in it."""
    batch = written(batch_of(rows, index.buckets), "batch")
    asked = _sent(index, batch, _probe_and_add)
    filters = asked.where("digest is null").select("bucket", "filter")
    hits = asked.where("hit").select("digest")
    if hits.isEmpty():
        content = index.content.unionByName(batch)
    else:
        stored = written(index.content.join(hits, "digest", "left_semi"), "stored")  # the look-ups
        wrong = batch.join(hits, "digest", "left_semi").join(stored, "digest", "left_anti")
        if not wrong.isEmpty():
            added = _sent(Index(filters.where("filter is not null"), index.content, index.buckets), wrong.join(filters.where("filter is null"), "bucket", "left_anti"), _add)
            filters = added.select("bucket", "filter").unionByName(filters.where("filter is null"))
        merged = _merged(stored.select(batch.columns), batch.join(stored, "digest", "left_semi").select(batch.columns))
        kept = index.content.join(stored, "digest", "left_anti").select(batch.columns)
        content = kept.unionByName(merged).unionByName(batch.join(stored, "digest", "left_anti").select(batch.columns))
        content = written(content, "content")
    return Index(_with_rebuilt(filters, content), content, index.buckets)


def delete(index: Index, gone: DataFrame) -> Index:
    """The index without the digests of ``gone``; digests it does not hold change nothing."""
    batch = gone.select("digest").distinct().select(_bucket(index.buckets), "digest")
    hits = _sent(index, batch, _probe).where("hit").select("digest")
    found = written(index.content.join(hits, "digest", "left_semi").select("bucket", "digest"), "found")
    filters = _sent(index, found, _remove).select("bucket", "filter")
    return Index(filters, written(index.content.join(found, "digest", "left_anti").select(index.content.columns), "content"), index.buckets)


def live(index: Index) -> DataFrame:
    return index.content.select("digest", "keep_id", "keep_chars", "keep_row", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256: a row for each row of ``docs``.

    ``row``: the unique long ``row_col``, or one given here; one row of each group is kept.
    Plan: one scan to the written digests, which enter the index in ``BATCHES`` batches by
    a hash of the row, so a digest of an earlier batch is a hit of the filters and is
    looked up in the content; in each, partial aggregation and a shuffle of digests to
    their buckets; at last a join of ids and keepers on the digest, which AQE may split
    where a digest is frequent.  No text is shuffled.
    """
    spark = docs.sparkSession
    rows = written(digests(docs, id_col, text_col, row_col), "digests")
    buckets = max(tasks(spark), -(-rows.count() // BUCKET_KEYS))
    index = new_index(spark, buckets)
    for k in range(BATCHES):
        index = insert(index, rows.where(F.pmod(F.xxhash64("row"), F.lit(BATCHES)) == k))
    return rows.join(live(index), "digest").select(
        "doc_id",
        "row",
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
