"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Kernel: two words are alike where they share subsequences of four letters, each
occurrence weighted by DECAY to the power of its span (up to SPAN letters), so gaps
and inserted letters cost weight but do not hide a match.  Letters are folded
(case, accents, digits used as letters); other characters count for nothing, and
single letters set apart by spaces are read as one word.

Training, on a bounded sample of labelled documents: their sentences are the examples.
All sentences of a clean document are clean; of a toxic document some are toxic, and
which is learnt (a multiple-instance SVM).  A sentence stands as its word of the
highest margin, as one insult among neutral words makes it toxic.  Smoothed log-odds of
four letters in a row pick the first WITNESSES sentences of each toxic document;
landmarks are drawn from their words and from the clean words nearest to them; a linear
SVM (squared hinge, Newton steps) is trained in the Nyström feature space; then each
sentence's word, the toxic sentences and the hardest clean ones are picked anew, for
some rounds.  As the kernel is a sum over subsequences, landmarks and SVM fold into one
table of weights by subsequence, exactly.

FOLDS such SVMs are trained, each in a task of its own and without the documents of one
fold, and their tables are averaged.  A document's score is a logistic curve over its
three highest margins and the number and share of its words over the margin.  The curve
is fitted to margins by the SVM that has not seen the document, both classes weighing
the same: 0.5 is where the evidence is even, whatever the share of toxic rows.

Cases: null and empty texts have no words and get the curve's value for none; without
toxic or without clean labelled rows every score is the share of toxic labels (0
without labels); a document with several labels is toxic if one says so; null labels
are left out; very long texts are read in parts, very long words in windows.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, hash_sample, small_batches, written

#: Kernel: letters of a subsequence (fixed at 4 by the table's index), its longest span, weight per letter of span.
SPAN, DECAY = 7, 0.7
#: Longest word scored as one; longer ones in windows that overlap by half.
WINDOW = 24
#: The fit reads so many labelled rows of each class at most, chosen by a hash of the id.
TOXIC_ROWS, CLEAN_ROWS = 1000, 2500
#: and so many UTF-8 bytes of them, in the order of that hash.
SAMPLE_BYTES = 24 << 20
LANDMARKS, ROUNDS, HARD_SENTENCES = 160, 4, 4000
#: Toxic sentences that a toxic document contributes at most, and the folds of the curve's fit.
WITNESSES, FOLDS = 3, 5
RIDGE = 0.1
#: A share of toxic documents under this many times that of clean ones makes a word no witness.
LEAST_RATIO = 5
#: Documents with a score from here on are predicted toxic (fixed by the contract).
THRESHOLD = 0.7
#: Scored words that a Python worker remembers.
CACHE_WORDS = 200_000

_GAPS = [(a, b, c) for a, b, c in combinations(range(1, SPAN), 3)]
_TABLE = 1 << 20
_APART = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_AROUND = ".,;:!?|\"'()"
_SENTENCE_END = re.compile(r"[.!?]+\s|\n")
#: Digits and signs that stand for letters (fixed values).
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Code by code point, below 0x3000: 1 to 26 the Latin letters, 27 to 31 other letters, 0 nothing."""
    out = np.zeros(0x3000, np.uint8)
    for point in range(0x3000):
        c = chr(point)
        c = _STANDS_FOR.get(c, c)
        base = unicodedata.normalize("NFD", c.lower())[0]
        if "a" <= base <= "z":
            out[point] = ord(base) - 96
        elif base.isalnum():
            out[point] = 27 + point % 5
    return out


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words one after another, and the word each belongs to."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "replace"), np.uint32)
    word = np.cumsum(points == 10)
    codes = np.where(points < 0x3000, _codes()[np.minimum(points, 0x2FFF)], 27 + points % 5).astype(np.int64)
    kept = codes > 0
    return codes[kept], word[kept]


def _subsequences(codes: np.ndarray, word: np.ndarray, gaps=_GAPS):
    """For each pattern of gaps: (table index, word, weight) of the occurrences."""
    for a, b, c in gaps:
        n = len(codes) - c
        if n <= 0:
            continue
        at = np.flatnonzero(word[:n] == word[c:])
        index = (codes[at] << 15) | (codes[at + a] << 10) | (codes[at + b] << 5) | codes[at + c]
        yield index, word[at], DECAY ** (c + 1)


def table_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """Sum over each word's subsequences of weight times table."""
    out = np.zeros(len(words))
    codes, word = _flat(words)
    for index, own, weight in _subsequences(codes, word):
        out += np.bincount(own, table[index] * weight, len(words))
    return out


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def words_of(text: str, size: int = 1 << 20) -> set[str]:
    """Distinct words in lower case; letters set apart by spaces make one word."""
    out: set[str] = set()
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        part = text[at:end].lower()
        out.update(part.split())
        out.update("".join(m.group().split()) for m in _APART.finditer(part))
        at = end
    return out


# ---------------------------------------------------------------- training


class _Sentences:
    """Sampled documents as sentences of word numbers: each word's sentence, each sentence's document."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.word, self.sentence, self.document, self.toxic = (array("i") for _ in range(4))

    def add(self, text: str, toxic: int) -> None:
        for sentence in _SENTENCE_END.split(text):
            found = sorted({p for w in words_of(sentence) for p in windows(w.strip(_AROUND))})
            if found:
                self.word.extend(self.number.setdefault(w, len(self.number)) for w in found)
                self.sentence.extend([len(self.document)] * len(found))
                self.document.append(len(self.toxic))
        self.toxic.append(toxic)

    def arrays(self):
        return list(self.number), *(np.asarray(x) for x in (self.word, self.sentence, self.document, self.toxic))  # not copied


def _in_parts(words: list[str], size: int = 20_000):
    for i in range(0, len(words), size):
        yield i, words[i : i + size]


def _all_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    return np.concatenate([table_scores(part, table) for _, part in _in_parts(words)]) if words else np.zeros(0)


def _evidence(words, n_toxic, n_clean, toxic_docs, clean_docs) -> np.ndarray:
    """Each word's highest smoothed log-odds of four letters in a row, to pick first witnesses."""
    in_a_row = [(1, 2, 3)]
    seen_toxic, seen_clean = np.zeros(_TABLE), np.zeros(_TABLE)
    for i, part in _in_parts(words):
        for index, own, _ in _subsequences(*_flat(part), in_a_row):
            seen_toxic += np.bincount(index, n_toxic[i + own], _TABLE)
            seen_clean += np.bincount(index, n_clean[i + own], _TABLE)
    ratio = clean_docs / toxic_docs
    odds = np.log((seen_toxic * ratio + 3 * ratio) / (seen_clean + 3 * ratio))
    out = np.full(len(words), -10.0)
    for i, part in _in_parts(words):
        for index, own, _ in _subsequences(*_flat(part), in_a_row):
            np.maximum.at(out, i + own, odds[index])
    return out


def _kernel(words: list[str], rows: dict, weights: np.ndarray) -> np.ndarray:
    """Kernel of words with the landmarks; ``weights``: a row for each subsequence of a landmark, a column for each landmark."""
    out = np.zeros((len(words), weights.shape[1]))
    for i, part in _in_parts(words, 300):  # some 40 MB at once
        found = [(rows[index], own, weight) for index, own, weight in _subsequences(*_flat(part))]
        row = np.concatenate([r for r, _, _ in found]) if found else np.zeros(0, np.int64)
        own = np.concatenate([o for _, o, _ in found]) if found else row
        weight = np.concatenate([np.full(len(r), w) for r, _, w in found]) if found else row
        used = row >= 0
        row, own, weight = row[used], own[used], weight[used]
        if len(row):
            order = np.argsort(own, kind="stable")
            row, own, weight = row[order], own[order], weight[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out[i + own[first]] = np.add.reduceat(weights[row] * weight[:, None], first, axis=0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Squared-hinge linear SVM with an unpenalised last column (the bias), by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        own = x if active.all() else x[active]
        part = own * cost[active, None]
        new = np.linalg.solve(part.T @ own + np.diag(penalty), part.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of the columns and an offset, ridged a little, both classes weighing the same."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    cost = np.where(toxic == 1, (toxic == 0).sum() / max(1, toxic.sum()), 1.0)
    theta, penalty = np.zeros(x.shape[1]), np.ones(x.shape[1])
    penalty[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (cost * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (cost * (toxic - p)) - penalty * theta)
        theta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return theta


def summary(margins: np.ndarray) -> tuple[float, ...]:
    """What the curve sees of a document: the margins of its distinct words."""
    n = len(margins)
    top = np.sort(np.partition(margins, n - 3)[n - 3 :] if n > 3 else margins)[::-1]
    top = np.clip(np.concatenate((top, np.full(3 - len(top), -2.0))), -2, 1.5)
    over, far_over = int((margins > 0).sum()), int((margins > 0.5).sum())
    share = lambda k: math.log((k + 0.3) / (n + 30))
    return (*top.tolist(), math.log1p(over), share(over), math.log1p(far_over), share(far_over), math.log1p(n))


def _best(values: np.ndarray, group: np.ndarray, at: np.ndarray, most: int, keep) -> np.ndarray:
    """Of ``at``, by group: the place of the highest value, and of the next ones that ``keep`` (value, highest) says, ``most`` in all."""
    order = at[np.lexsort((values[at], group[at]))]
    if not len(order):
        return order
    last = np.flatnonzero(np.concatenate((np.diff(group[order]) != 0, [True])))
    end = last[np.searchsorted(last, np.arange(len(order)))]
    back = end - np.arange(len(order))
    return order[(back == 0) | ((back < most) & keep(values[order], values[order[end]]))]


class _Landmarks:
    """The Nyström space of some words."""

    def __init__(self, words: list[str]):
        entries = list(_subsequences(*_flat(words)))
        self.rows = np.full(_TABLE, -1)  # where a subsequence of some landmark stands in weights
        self.used = np.unique(np.concatenate([np.empty(0, np.int64), *(e[0] for e in entries)]))
        self.rows[self.used] = np.arange(len(self.used))
        self.weights = np.zeros((len(self.used), len(words)))
        for index, own, weight in entries:
            np.add.at(self.weights, (self.rows[index], own), weight)
        self.weights /= np.maximum(np.linalg.norm(self.weights, axis=0), 1e-12)
        values, vectors = np.linalg.eigh(self.weights.T @ self.weights)
        good = values > 1e-6 * values[-1]
        self.to_space = vectors[:, good] / np.sqrt(values[good])

    def features(self, words: list[str], ones: int = 0) -> np.ndarray:
        """Places in the space, and so many columns of ones after them."""
        size = self.to_space.shape[1]
        out = np.ones((len(words), size + ones))
        for i, part in _in_parts(words, 3000):
            out[i : i + len(part), :size] = _kernel(part, self.rows, self.weights) @ self.to_space
        return out

    def folded(self, w: np.ndarray) -> np.ndarray:
        """Weights by subsequence that give the same products as ``w`` in the space."""
        table = np.zeros(_TABLE)
        table[self.used] = self.weights @ (self.to_space @ w)
        return table


def _distinct(document: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
    """The sorted distinct values of document * n_words + word, with two arrays of their size at once."""
    found = document.astype(np.int64)
    found *= n_words
    found += word
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def fit_margins(words: list[str], word: np.ndarray, sentence: np.ndarray, document: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float, list[str]]:
    """(table, bias, landmarks) of the SVM on the sentences of documents of both classes."""
    pos, neg = int(toxic.sum()), int(len(toxic) - toxic.sum())
    of_word = document[sentence]
    seen = _distinct(of_word, word, len(words))
    seen_toxic = toxic[seen // len(words)] == 1
    n_toxic, n_clean = (np.bincount(seen[k] % len(words), minlength=len(words)).astype(float) for k in (seen_toxic, ~seen_toxic))
    no_witness = n_clean * pos * LEAST_RATIO > n_toxic * neg
    clean_words = np.flatnonzero(n_clean > 0)
    in_toxic, clean = np.flatnonzero(toxic[document] == 1), np.flatnonzero(toxic[document] == 0)
    some = np.random.default_rng(0).permutation(np.flatnonzero(toxic[of_word] == 0))[:HARD_SENTENCES].copy()  # not a view that holds all
    del of_word, seen, seen_toxic

    first = np.flatnonzero(np.concatenate(([True], np.diff(sentence) != 0)))
    length = np.diff(np.concatenate((first, [len(sentence)])))

    def heads(scores):
        """Each sentence's word of the highest score, and that score."""
        head, best = np.empty(len(first), word.dtype), np.empty(len(first))
        for at in range(0, len(first), 10_000):
            part = slice(at, at + 10_000)
            start, own = first[part] - first[at], word[first[at] : first[part][-1] + length[part][-1]]
            values = scores[own]
            best[part] = np.maximum.reduceat(values, start)
            at_best = np.flatnonzero(values == np.repeat(best[part], length[part]))
            head[part] = own[at_best[np.searchsorted(at_best, start)]]
        return head, best

    give_back()
    scores = _evidence(words, n_toxic, n_clean, pos, neg)
    give_back()
    keep = lambda value, top: value >= 0.5 * top
    space, table, bias, marks, hard = None, np.zeros(_TABLE), 0.0, [], np.empty(0, np.int64)
    for _ in range(ROUNDS):
        toxic_head, toxic_score = heads(scores - 1e6 * no_witness)
        head, score = heads(scores)
        chosen = _best(toxic_score, document, in_toxic, WITNESSES, keep)
        witnesses = np.unique(toxic_head[chosen])
        hard = np.union1d(hard, clean[np.argsort(-score[clean], kind="stable")[:HARD_SENTENCES]])
        if space is None:
            near = clean_words[np.argsort(-scores[clean_words], kind="stable")]
            marks = [words[i] for i, _ in Counter(toxic_head[chosen].tolist()).most_common(LANDMARKS * 3 // 4)] + [words[i] for i in near[: LANDMARKS // 4]]
            space = _Landmarks(marks)
        held = np.bincount(np.concatenate((head[hard], word[some])), minlength=len(words))
        held[witnesses] = 0
        against = np.flatnonzero(held)
        x = space.features([words[i] for i in np.concatenate((witnesses, against))], ones=1)
        y = np.concatenate((np.ones(len(witnesses)), -np.ones(len(against))))
        cost = 1000 * np.concatenate((np.full(len(witnesses), 1 / len(witnesses)), held[against] / max(1, held.sum())))
        w = _svm(x, y, cost, RIDGE)
        table, bias = space.folded(w[:-1]), float(w[-1])
        del x, y, cost
        give_back()
        scores = _all_scores(words, table) + bias
        keep = lambda value, top: value > 0
    return table, bias, marks


def fold_of(toxic: np.ndarray) -> np.ndarray:
    """The fold of each document, in turn within its class."""
    out = np.zeros(len(toxic), np.int64)
    for t in (0, 1):
        at = np.flatnonzero(toxic == t)
        out[at] = np.arange(len(at)) % FOLDS
    return out


def fit_fold(bags: _Sentences, fold: int) -> tuple[dict, list[tuple]]:
    """The SVM without the documents of a fold, and (toxic, summary) of those; none if a class is missing."""
    words, word, sentence, document, toxic = bags.arrays()
    inside = fold_of(toxic) != fold
    chosen = inside[document]
    if not toxic[document[chosen]].any() or toxic[document[chosen]].all():
        return {}, []
    kept = chosen[sentence]
    table, bias, marks = fit_margins(words, word[kept], (np.cumsum(chosen, dtype=np.int32) - 1)[sentence[kept]], (np.cumsum(inside, dtype=np.int32) - 1)[document[chosen]], toxic[inside])
    scores = _all_scores(words, table) + bias
    seen = _distinct(document[sentence], word, len(words))
    owner, out = seen // len(words), []
    for d in np.flatnonzero(~inside):
        own = seen[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")] % len(words)
        out.append((int(toxic[d]), summary(scores[own])))
    at = np.flatnonzero(table)
    return {"index": at.tolist(), "weight": table[at].tolist(), "bias": bias, "landmarks": marks}, out


def averaged(models: list[dict], unseen: list[tuple], toxic_total: int, clean_total: int) -> dict:
    """The mean of the folds' SVMs with the curve of what each had not seen."""
    toxic = np.array([t for t, _ in unseen])
    if not models or not toxic.any() or toxic.all():
        share = toxic_total / max(1, toxic_total + clean_total)
        return {"index": [], "weight": [], "bias": 0.0, "curve": [0.0] * 8 + [math.log((share + 1e-9) / (1 - share + 1e-9))], "landmarks": []}
    table = np.zeros(_TABLE)
    for m in models:
        table[np.array(m["index"], np.int64)] += np.array(m["weight"]) / len(models)
    at = np.flatnonzero(table)
    curve = _logistic(np.array([x for _, x in unseen]), toxic)
    return {"index": at.tolist(), "weight": table[at].tolist(), "bias": sum(m["bias"] for m in models) / len(models), "curve": curve.tolist(), "landmarks": sorted({w for m in models for w in m["landmarks"]})}


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from (fixed by the contract)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on at most TOXIC_ROWS and CLEAN_ROWS labelled rows, and SAMPLE_BYTES of text, outside the held-out third."""
    small_batches(docs.sparkSession)
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [hash_sample(known.where(F.col("toxic") == t), "doc_id", n, totals.get(t, 0)) for t, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    ids = chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "chosen_id")  # at most TOXIC_ROWS + CLEAN_ROWS rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id"))
    texts = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # of rows that share an id, one
    in_order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)  # over the sample only
    rows = texts.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(in_order), F.lit(0))).where(F.col("before") + F.octet_length("text") <= SAMPLE_BYTES)
    sample = written(rows.select("doc_id", "text", "toxic"), "sample")

    def train(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table, bags = pa.Table.from_batches(held), _Sentences()
        del held
        fold = table.column("fold")[0].as_py()
        for i in pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]).to_pylist():  # the same model however rows arrive
            bags.add(table.column("text")[i].as_py(), table.column("toxic")[i].as_py())
        del table
        give_back()  # the texts, before the fit takes memory of its own
        model, unseen = fit_fold(bags, fold)
        raw = zlib.compress(json.dumps({"fold": fold, "model": model, "unseen": unseen}).encode())
        del bags
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["made"])

    copies = sample.withColumn("fold", F.explode(F.array(*(F.lit(k) for k in range(FOLDS)))))
    made = [json.loads(zlib.decompress(r["made"])) for r in copies.repartitionById(FOLDS, F.col("fold")).mapInArrow(train, "made binary").collect()]  # FOLDS rows
    made.sort(key=lambda m: m["fold"])
    return averaged([m["model"] for m in made if m["model"]], [u for m in made for u in m["unseen"]], totals.get(1, 0), totals.get(0, 0))


# ---------------------------------------------------------------- scoring


class Scorer:
    def __init__(self, model: dict):
        self.table = np.zeros(_TABLE)
        self.table[np.asarray(model["index"], np.int64)] = model["weight"]
        self.bias, self.curve = model["bias"], np.array(model["curve"])
        self.known: dict[str, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        """The logit of each text's score."""
        bags = [words_of(t) for t in texts]
        new = list({w for bag in bags for w in bag if w not in self.known})
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list({w for bag in bags for w in bag})
        for _, part in _in_parts(new):
            cut = [windows(w) for w in part]
            scores = table_scores([x for c in cut for x in c], self.table) + self.bias
            first = np.concatenate(([0], np.cumsum([len(c) for c in cut])[:-1]))
            self.known.update(zip(part, np.maximum.reduceat(scores, first).tolist(), strict=True))
        get = self.known.__getitem__
        seen = np.array([summary(np.fromiter(map(get, bag), float, len(bag))) for bag in bags]).reshape(len(bags), 8)
        return (seen @ self.curve[:-1] + self.curve[-1]).tolist()


_SCORERS: dict[int, Scorer] = {}


def toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: a narrow pass over whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model | {"index": np.array(model["index"], np.int32), "weight": np.array(model["weight"], float)})  # a worker keeps it: arrays are a tenth of lists
    name = zlib.crc32(json.dumps(model, sort_keys=True).encode())

    def score(batches):
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(sent.value)
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_SCORERS[name].scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "logit"])
        _SCORERS.clear()
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = rows.mapInArrow(score, "doc_id long, logit double").select("doc_id", (1 / (1 + F.exp(-F.col("logit")))).alias("score"))
    return made.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
