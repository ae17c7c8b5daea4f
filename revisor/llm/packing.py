"""Packing token sequences by shortest-pack-first over the length histogram.

1. A document's ids are cut into pieces of ``room`` ids and a rest.
2. The histogram of piece lengths has at most ``room`` rows whatever the corpus, so
   the plan is made on the driver: lengths are placed longest first, each into the
   open packs with the most space left (the shortest packs), and the counts of the
   packing patterns are updated.  Work and memory depend on ``room`` alone.
3. The pieces of a length are ranked, and the rank finds the pattern, the copy of
   the pattern and the offset.  Ranks are taken in salted buckets and shifted by the
   buckets' counts, so a frequent length never meets in one task.

Cases: null text counts as empty; an empty text is its end id alone; a text longer
than ``room`` fills whole sequences and packs its rest; ties and repeated rows are
ranked in any order, but each gets its own place; an empty table gives none.
"""

from __future__ import annotations

import bisect
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, small_batches, tasks, written

#: Fixed by the contract: longest sequence, and the id that ends a document.
ROOM, END_ID = 2048, 1
#: Encoded words of a generation; a Python worker remembers four (some 90 MB).
CACHE_WORDS = 150_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class Recent:
    """Encoded words of two generations: a full young one becomes the old one, and words in use move back."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Make all known words young, and return the others."""
        new = words.difference(self.young)
        if len(self.young) + len(new) > self.size:
            self.old, self.young = self.young, {}
            new = words
        out = []
        for word in new:
            held = self.old.get(word)
            if held is None:
                out.append(word)
            else:
                self.young[word] = held
        return out


def _as_bytes_alphabet() -> dict[int, str]:
    """Code point by byte of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in kept else chr(next(rest)) for b in range(256)}


class WordEncoder:
    """Ids of texts by a byte-level BPE that never joins across white space and ignores case.

    Such a tokenizer's ids are those of the words one after another, so each word is
    encoded once: a word of Latin letters, with or without a sign after it, by its
    lower-case letters straight from the merges, other words by the whole tokenizer.
    Ids are little-endian unsigned 32 bits.  ``specials_as_text`` reads the file's special
    tokens as plain text; else they get their own ids, as by the tokenizer as loaded.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.alphabet = _as_bytes_alphabet()
        self.words, self.letters = Recent(), Recent()

    def _learn(self, words: set[str]) -> None:
        whole, cut, letters = [], [], set()
        for word in self.words.missing(words):
            low, sign = word.lower(), ""
            if not low.isalpha() and word and word[-1] in ".,;:!?":
                low, sign = low[:-1], word[-1]
                letters.add(sign)
            if low.isalpha() and max(low) < "\u0250":
                cut.append((word, low, sign))
                letters.add(low)
            else:
                whole.append(word)
        merges = self.tokenizer.model
        missing = self.letters.missing(letters)
        into = self.letters.young
        for low in missing:
            spelt = low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet)
            into[low] = array("I", [t.id for t in merges.tokenize(spelt)]).tobytes()
        known = self.words.young
        for word, made in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            known[word] = array("I", made.ids).tobytes()
        for word, low, sign in cut:
            known[word] = into[low] + into[sign] if sign else into[low]

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        self._learn(set(words))
        return b"".join(map(self.words.young.__getitem__, words))


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, specials_as_text: bool) -> WordEncoder:
    key = path, specials_as_text
    if key not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def _forget() -> None:
    """Drop the encoders: a worker that has tokenized may place pieces next."""
    _ENCODERS.clear()
    give_back()


def _segments(text: str, size: int = 1 << 20):
    """A long text in parts that end at white space."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in " \t\n":
            end += 1
        yield text[at:end]
        at = end


def encoded(text: str, encoder: WordEncoder) -> bytes:
    return b"".join(map(encoder.encode, _segments(text)))


def tokenized(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", specials_as_text: bool = False) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens: the pieces of each row.

    ``tokenizer``: path of a ``tokenizers`` file, the same on every executor.  It must
    be byte-level BPE with word ends that ignores case and white space, as word_bpe_49k is.
    """
    small_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        encoder = _encoder(tokenizer, specials_as_text)
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                ids, starts, lengths, pieces, totals = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = encoded(text, encoder) + end
                    n = len(raw) // 4
                    for start in range(0, n, room):
                        piece = raw[4 * start : 4 * (start + room)]
                        ids.append(doc_id)
                        starts.append(start)
                        lengths.append(len(piece) // 4)
                        pieces.append(piece)
                        totals.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def plan_packs(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns that place every length of the histogram."""
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by space left
    spaces: list[int] = []  # the keys of groups, ascending

    def put(space: int, count: int, pattern: tuple[int, ...]) -> None:
        if space not in groups:
            bisect.insort(spaces, space)
            groups[space] = []
        groups[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if spaces and spaces[-1] >= length:  # the shortest pack has the most space
                space = spaces[-1]
                count, pattern = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop()
                used = min(count, left)
                if count > used:
                    put(space, count - used, pattern)
                put(space - length, used, (*pattern, length))
            else:
                each = room // length  # so many of this length fit in a new pack
                full, rest = divmod(left, each)
                if full:
                    put(room - each * length, full, (length,) * each)
                if rest:
                    put(room - rest * length, 1, (length,) * rest)
                used = left
            left -= used
    return [x for space in spaces for x in groups[space]]


def _intervals(patterns) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): ranks of a length run through its patterns in order."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, seen.get(length, 0), sequence, offset))
            seen[length] = seen.get(length, 0) + count
            offset += length
        sequence += count
    return out


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with rank: gapless from 0 within a length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    return (
        salted.withColumn("in_salt", F.row_number().over(order) - 1)
        .join(shift, ["length", "salt"])
        .withColumn("rank", F.col("in_salt") + F.col("shift"))
        .drop("salt", "in_salt", "shift")
    )


def packed(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """``pieces`` (doc_id, start, length and what else they carry) with sequence_id and offset.

    ``pieces`` is read three times; give a written table.  The patterns found are
    broadcast: there are at most about two for each length up to ``room``.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, sequence, offset in _intervals(plan_packs(histogram, room)):
        found.setdefault(length, []).append((rank, sequence, offset))
    slots = spark.sparkContext.broadcast({k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in found.items()})
    fields = pieces.columns

    def place(batches):
        _forget()
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for each in np.unique(length):
                own = length == each
                first, sequences, offsets = slots.value[each]
                at = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = sequences[at] + rank[own] - first[at]
                offset[own] = offsets[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in fields] + [pa.array(sequence), pa.array(offset)], names=[*fields, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked(pieces, max(16, tasks(spark))).mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", specials_as_text: bool = False, with_ids: bool = False) -> DataFrame:
    """Pieces with their place and a CRC-32 of their ids, for a record of where each id went.

    ``with_ids`` carries the ids themselves (little-endian unsigned 32 bits), so that a
    sequence is what its pieces hold in the order of their offsets; see ``sequences``.
    """
    pieces = tokenized(docs, tokenizer, room, id_col=id_col, text_col=text_col, specials_as_text=specials_as_text)
    fields = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", *(["ids"] if with_ids else [])]
    return packed(written(pieces.select(*fields), "pieces"), room)


def sequences(pieces: DataFrame, room: int = ROOM, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (binary, ``room`` ids with padding), n_tokens: the sequences of pieces that carry their ids.  A sequence has at most ``room`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    filled = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.expr(f"unhex(repeat('{pad_id.to_bytes(4, 'little').hex()}', cast({room} - n_tokens as int)))")
    made = pieces.groupBy("sequence_id").agg(filled.alias("filled"), F.sum("length").alias("n_tokens"))
    return made.select("sequence_id", F.concat("filled", pad).alias("ids"), "n_tokens")
