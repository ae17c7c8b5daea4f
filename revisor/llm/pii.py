"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  Further
spans are secrets: long tokens of letters and digits on which regex, gazetteer, shape
and context labelers vote.  A caller may pass other gazetteers than the two given here:
beginnings of issued keys, looked up by each of their lengths, and ordinary stems.  Expectation-maximisation over the counts of vote
patterns (243 at most) estimates how reliable each labeler is, without labels; its
posteriors train the final span classifier, naive Bayes over votes and shape.

Patterns are possessive, so no text makes them backtrack for long or fill the stack;
each gives the same matches as the plain form in the contract.  Places of spans and
their overlaps are found by running folds, so the work on a text of n spans grows as
n to the power of 4/3, not as its square.

Cases: null text counts as empty; a document without spans gets an empty list; null
ids and repeated rows are carried as they are; with no candidate anywhere the
classifier is the prior and adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, written

#: Kinds in the order of the contract, and the pattern of each.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*BASE, "secret")
#: Long tokens of letters and digits with at least one digit.
TOKEN = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]{0,64}+[0-9])[A-Za-z0-9_]{12,}+"
#: Gazetteers: prefixes of issued keys, and the stems of ordinary words with digits (fixed values).
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat", "xoxa", "xoxb", "xoxp", "sk_live", "sk_test")
ORDINARY = ("utf", "iso", "mp", "h", "sha", "md", "base", "x", "win", "i", "rfc", "covid", "version", "chapter", "page", "figure", "table", "section")
CUE = r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|credential)s?[\"']?\s{0,3}[=:]\s{0,3}[\"']?$"
LABELERS = ("prefix", "cue", "mixed", "ordinary", "wordlike")
ROUNDS = 25


#: What a span is while it is judged, and what an empty list of them is.
_SPANS = "array<struct<kind:int,start:int,stop:int,hit:string,left:string>>"


def _cut(rows: DataFrame, name: str, may_be: Column, pattern: str) -> DataFrame:
    """Adds the matches of a pattern and the text between them, each found once, where ``may_be`` holds."""
    none = F.array().cast("array<string>")
    text = F.col("text")
    return rows.withColumn(f"{name}_hits", F.when(may_be, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)).withColumn(
        f"{name}_gaps", F.when(F.size(f"{name}_hits") > 0, F.split(text, pattern)).otherwise(none)
    )


def _spans(name: str, kind: int) -> Column:
    """Spans in code points from the columns of ``_cut``: leftmost matches that do not overlap."""
    hits, gaps = F.col(f"{name}_hits"), F.slice(F.col(f"{name}_gaps"), F.lit(1), F.size(f"{name}_hits"))
    lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h))
    stops = running(lengths, F.lit(0), lambda a, n: a + n)
    both = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.substring(g, -24, 24).alias("left")))
    made = F.zip_with(
        both,
        stops,
        lambda p, s: F.struct(F.lit(kind).alias("kind"), (s - F.length(p["hit"])).alias("start"), s.alias("stop"), p["hit"].alias("hit"), p["left"].alias("left")),
    )
    return F.when(F.size(hits) > 0, made).otherwise(F.array().cast(_SPANS))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(hit, r"\."), small)
    digits = _digits(hit)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda s: _holds(kind, s["hit"])


def with_base(rows: DataFrame) -> DataFrame:
    """Adds base: spans of the four kinds, by kind and start."""
    text = F.col("text")
    may_be = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){12}"), "phone": text.contains("+")}
    for kind, pattern in BASE.items():
        rows = _cut(rows, kind, may_be[kind], pattern)
    return rows.withColumn("base", F.concat(*(F.filter(_spans(kind, k), _keeps(kind)) for k, kind in enumerate(BASE))))


@dataclass(frozen=True)
class Gazetteers:
    """Beginnings of keys, and lower-case stems of ordinary words; each is inlined in the plan, so thousands of entries at most."""

    prefixes: tuple[str, ...] = KEY_PREFIXES
    ordinary: tuple[str, ...] = ORDINARY


def _begins_with_one_of(hit: Column, prefixes: tuple[str, ...]) -> Column:
    """Look-up of the hit's beginning in a gazetteer, once for each length of its entries."""
    found = F.lit(False)
    for n in sorted({len(p) for p in prefixes}):
        found = found | F.substring(hit, 1, n).isin(*(p for p in prefixes if len(p) == n))
    return found


def _votes(s: Column, known: Gazetteers) -> dict[str, Column]:
    """Each labeler's vote: 1 for, -1 against, 0 for none."""
    hit = s["hit"]
    share = F.length(_digits(hit)) / F.length(hit)
    distinct = F.size(F.array_distinct(F.split(hit, "")))
    against = lambda c: F.when(c, -1).otherwise(0)
    return {
        "prefix": F.when(_begins_with_one_of(hit, known.prefixes), 1).otherwise(0),
        "cue": F.when(s["left"].rlike(CUE), 1).otherwise(0),
        "mixed": F.when(share.between(0.08, 0.9) & (distinct >= 8) & hit.rlike("[A-Za-z]"), 1).otherwise(-1),
        "ordinary": against(F.regexp_extract(F.lower(hit), "^([a-z]+)_?[0-9]+(?:_?[a-z]+)*$", 1).isin(*known.ordinary) | hit.rlike("^[0-9_]+$")),
        "wordlike": against(hit.rlike("^[A-Za-z]?[a-z]{6,}[0-9]{1,4}$")),
    }


def _features(s: Column) -> dict[str, Column]:
    hit = s["hit"]
    bin4 = lambda c: F.least(F.floor(c * 4), F.lit(3)).cast("int")
    return {
        "size": F.least(F.length(hit), F.lit(40)).cast("int"),
        "digits": bin4(F.length(_digits(hit)) / F.length(hit)),
        "capitals": bin4(F.length(F.regexp_replace(hit, "[^A-Z]", "")) / F.length(hit)),
    }


FEATURES = ("size", "digits", "capitals")


def _apart(spans: Column, base: Column) -> Column:
    """The spans, in order and apart from each other, that overlap none of ``base``.

    Both in one order: a span comes after every base span that starts before its end, and
    overlaps one of those if the furthest end so far is past its start.
    """
    none = F.lit(None).cast("struct<kind:int,start:int,stop:int,hit:string,left:string>")
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("rank"), b["stop"].alias("reach"), none.alias("s")))
    of_span = F.transform(spans, lambda s: F.struct(s["stop"].alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("reach"), s.alias("s")))
    reached = lambda e: running(F.transform(e, lambda x: x["reach"]), F.lit(0), lambda a, b: F.greatest(a, b))
    judged = let(F.array_sort(F.concat(of_base, of_span)), lambda e: F.zip_with(e, reached(e), lambda x, r: F.when((x["rank"] == 0) & (r <= x["s"]["start"]), x["s"])))
    return F.when(F.size(spans) == 0, spans).when(F.size(base) == 0, spans).otherwise(F.filter(judged, lambda s: s.isNotNull()))


def with_candidates(rows: DataFrame, known: Gazetteers = Gazetteers()) -> DataFrame:
    """Adds maybe: candidate secrets outside the base spans, with votes and features."""
    rows = _cut(rows, "token", F.col("text").rlike("[0-9]"), TOKEN)
    apart = _apart(_spans("token", len(BASE)), F.col("base"))
    judged = F.transform("apart", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), *(v.cast("int").alias(k) for k, v in (_votes(s, known) | _features(s)).items())))
    return rows.withColumn("apart", apart).withColumn("maybe", judged)


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict], dict[tuple[int, ...], float]]:
    """EM for two latent classes: prior, each labeler's vote probabilities by class, posterior by vote pattern.

    ``counts`` has a row for each vote pattern, 3 ** len(LABELERS) at most.
    """
    post = {v: min(0.95, max(0.05, 0.5 + 0.3 * sum(v))) for v in counts}
    total = sum(counts.values())
    prior, tables = 0.5, [{(v, y): 1 / 3 for v in (-1, 0, 1) for y in (0, 1)} for _ in LABELERS]
    for _ in range(rounds if total else 0):
        yes = sum(n * post[v] for v, n in counts.items())
        prior = (yes + 1) / (total + 2)
        for k, table in enumerate(tables):
            for y, size in ((1, yes), (0, total - yes)):
                for vote in (-1, 0, 1):
                    seen = sum(n * (post[v] if y else 1 - post[v]) for v, n in counts.items() if v[k] == vote)
                    table[vote, y] = (seen + 0.5) / (size + 1.5)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[x, 1] / t[x, 0]) for t, x in zip(tables, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, tables, post


def _lookup(pairs: dict[int, float], key: Column) -> Column:
    found = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(found, key), F.lit(0.0))


def train(spans: DataFrame) -> tuple[float, dict[str, dict[int, float]]]:
    """Final classifier: prior log-odds, and log-odds by value of each vote and feature.

    ``spans``: a row for each candidate.  Only counts by votes, and by votes and one
    feature's value, come to the driver; both have a fixed bound.
    """
    votes = [F.col(k) for k in LABELERS]
    counts = {tuple(r[k] for k in LABELERS): r["n"] for r in spans.groupBy(*votes).agg(F.count("*").alias("n")).collect()}
    prior, tables, post = estimate(counts)
    model = {k: {v: math.log(t[v, 1] / t[v, 0]) for v in (-1, 0, 1)} for k, t in zip(LABELERS, tables, strict=True)}
    for feature in FEATURES:
        seen: dict[int, list[float]] = {}
        for r in spans.groupBy(*votes, feature).agg(F.count("*").alias("n")).collect():
            p, both = post[tuple(r[k] for k in LABELERS)], seen.setdefault(r[feature], [0.5, 0.5])
            both[1] += r["n"] * p
            both[0] += r["n"] * (1 - p)
        yes, no = (sum(b[y] for b in seen.values()) for y in (1, 0))
        model[feature] = {v: math.log(b[1] / yes) - math.log(b[0] / no) for v, b in seen.items()}
    return math.log(prior / (1 - prior)) if counts else -30.0, model


def _chosen(prior: float, model: dict[str, dict[int, float]]):
    def classify(s: Column) -> Column:
        odds = F.lit(prior)
        for name, pairs in model.items():
            if pairs:
                odds = odds + _lookup(pairs, s[name])
        return odds > 0

    return classify


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Gazetteers = Gazetteers()) -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, stop); a row for each row of ``docs``.

    One pass over the texts into a written table of spans; everything after reads that.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    rows = written(with_candidates(with_base(texts), known).select("doc_id", plain.alias("base"), "maybe"), "spans")
    prior, model = train(rows.select(F.explode("maybe").alias("s")).select("s.*"))
    added = F.transform(F.filter("maybe", _chosen(prior, model)), lambda s: F.struct(F.lit(len(BASE)).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select("doc_id", "base", added.alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
