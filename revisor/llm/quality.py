"""Quality by hierarchical empirical Bayes: a document's own evidence, its path and its host.

1. Shape features of every whole text, one narrow pass.
2. A logistic classifier on binned features, fitted to a bounded sample of labelled
   rows, gives each document a log-likelihood ratio (evidence without the prior).
3. Grouped aggregation sums the classifier's probabilities by host and by path.  The
   spread between groups, over what chance alone gives, sets how strongly sparse
   groups shrink (method of moments): paths toward their host, hosts toward the
   global share.  A document's own probability is left out of its groups' sums.
4. Posterior: log-odds of the shrunken path share plus the document's ratio.

Groups are partially aggregated before the shuffle, and only one row for each group is
joined back, by a key that AQE may split where a host holds much of the corpus.

Cases: null text counts as empty and has a feature bin of its own; a null host or path
counts as the empty one; without labels of both classes the evidence is nought and all
documents get the global share (one half without labels); repeated labels count by
their mean.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, small_batches, word_blocks, written

#: Labelled rows of each class that the classifier is fitted to at most.
SAMPLE_ROWS = 5_000
#: Documents with a posterior from here on are kept.
KEEP = 0.5

FEATURES = ("capitals", "signs", "bars", "digits", "top_word", "distinct", "word_length", "repeats")
#: Edges of the bins of each feature; a value goes into the bin of the edges it reaches.
EDGES = {
    "capitals": (0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
    "signs": (0.002, 0.01, 0.02, 0.04, 0.08, 0.16),
    "bars": (0.0005, 0.005, 0.02, 0.05, 0.1),
    "digits": (0.002, 0.01, 0.03, 0.1, 0.3),
    "top_word": (0.03, 0.06, 0.1, 0.2, 0.35, 0.6),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 12),
    "repeats": (0.01, 0.03, 0.08, 0.15, 0.3, 0.6),
}
_UPPER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _DIGIT[48:58] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = True


def features(raw: bytes) -> tuple[float, ...]:
    """FEATURES of a UTF-8 text."""
    if not raw.strip():
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, n, chars, again, last = Counter(), 0, 0, 0, None
    for part in word_blocks(raw):
        words.update(part)
        n += len(part)
        chars += sum(map(len, part))
        again += sum(map(bytes.__eq__, part, part[1:])) + (bool(part) and part[0] == last)
        last = part[-1] if part else last
    size = len(raw)
    return (
        counts[_UPPER].sum() / size,
        counts[_SIGN].sum() / size,
        counts[ord("|")] / size,
        counts[_DIGIT].sum() / size,
        words.most_common(1)[0][1] / n if n >= 8 else 0.0,
        len(words) / n if n < 2000 else len(words) / n * math.log2(n) / 11,
        chars / n,
        again / n,
    )


def _feature_batches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), *((f, pa.float64()) for f in FEATURES)])
    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column(3)]
        columns = zip(*rows, strict=True) if rows else [()] * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [pa.array(c, pa.float64()) for c in columns], schema=schema)


def document_features(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, host, path and FEATURES: one pass over whole texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(_feature_batches, "doc_id long, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES))


def _one_hot(x: np.ndarray) -> np.ndarray:
    out = [np.ones((len(x), 1))]
    for k, f in enumerate(FEATURES):
        bins = np.searchsorted(EDGES[f], x[:, k], "right")
        out.append(np.eye(len(EDGES[f]) + 1)[bins])
    return np.concatenate(out, axis=1)


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[float, dict[str, list[float]]]:
    """Global share of good documents, and the log-likelihood ratio of each bin of each feature (with the offset under "")."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("int").alias("good"))
    joined = rows.select("doc_id", *FEATURES).join(known, "doc_id")
    n = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    share = (good + 1) / (good + bad + 2)
    if not good or not bad:
        return share, {}
    sample = []
    for label in (1, 0):
        sample += hash_sample(joined.where(F.col("good") == label), "doc_id", SAMPLE_ROWS, n.get(label, 0)).select(*FEATURES, "good").collect()
    if len({r["good"] for r in sample}) < 2:
        return share, {}
    data = np.array([tuple(r) for r in sample], float)
    x, y = _one_hot(data[:, :-1]), data[:, -1]
    weights = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same: a likelihood ratio
    theta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ theta))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weights * (y - p)) - ridge * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    out, at = {"": [float(theta[0])]}, 1
    for f in FEATURES:
        width = len(EDGES[f]) + 1
        out[f] = theta[at : at + width].tolist()
        at += width
    return share, out


def _evidence(model: dict[str, list[float]]) -> Column:
    total = F.lit(model.get("", [0.0])[0])
    for f in FEATURES:
        if f in model:
            value = F.lit(model[f][0])
            for edge, w in zip(EDGES[f], model[f][1:], strict=True):
                value = F.when(F.col(f) >= edge, F.lit(w)).otherwise(value)
            total = total + value
    return total


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior rows that a group's share weighs against: from the spread of shares around ``mean`` beyond chance."""
    share = F.col("s") / F.col("n")
    chance = mean * (1 - mean) / F.col("n")
    r = groups.where("n > 1").agg(F.sum(F.col("n") * ((share - mean) ** 2 - chance)).alias("between"), F.sum("n").alias("n"), F.avg(mean * (1 - mean)).alias("spread")).first()
    if not r["n"] or r["between"] is None or r["between"] <= 0:
        return 1e4
    return float(min(1e4, max(1.0, r["spread"] * r["n"] / r["between"])))


def posteriors(rows: DataFrame, share: float, model: dict[str, list[float]]) -> DataFrame:
    """doc_id, evidence, host_share, path_share, quality: for rows of ``document_features``."""
    own = written(rows.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), _evidence(model).alias("evidence")), "evidence")
    prob = 1 / (1 + F.exp(-(F.col("evidence") + math.log(share / (1 - share)))))
    own = own.withColumn("p", prob)
    paths = written(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    host_weight = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), F.lit(share))
    host_share = (F.col("host_s") + host_weight * share) / (F.col("host_n") + host_weight)
    both = paths.join(hosts, "host")
    path_weight = _strength(both, host_share)
    joined = own.join(both, ["host", "path"])
    host_left = (F.col("host_s") - F.col("p") + host_weight * share) / (F.col("host_n") - 1 + host_weight)
    path_left = (F.col("s") - F.col("p") + path_weight * F.col("host_share")) / (F.col("n") - 1 + path_weight)
    return (
        joined.withColumn("host_share", host_left)
        .withColumn("path_share", path_left)
        .select("doc_id", "evidence", "host_share", "path_share", (1 / (1 + F.exp(-(_logit(F.col("path_share")) + F.col("evidence"))))).alias("quality"))
    )


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """Posterior quality of every row of ``docs``, and whether it is kept."""
    rows = written(document_features(docs, host, path), "features")
    share, model = fit(rows, labels)
    return posteriors(rows, share, model).withColumn("keep", F.col("quality") >= KEEP)
