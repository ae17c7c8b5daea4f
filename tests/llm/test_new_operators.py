"""Merkle proofs, mixes and vector codes against plain versions, with nulls, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from revisor.llm import codes, merkle, mixing


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ Merkle


def _plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def _plain_siblings(levels, place):
    out = []
    for nodes in levels[:-1]:
        run = place // 3 * 3
        out += [nodes[k] for k in range(run, min(run + 3, len(nodes))) if k != place]
        place //= 3
    return out


def _plain_proofs(rows):
    """(group, key, digest) with subroot, root and the proof's siblings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    trees = {g: list(own) for g, own in itertools.groupby(rows, key=lambda r: r[0])}
    levels = {g: _plain_tree([r[2] for r in own]) for g, own in trees.items()}
    top = _plain_tree([levels[g][-1][0] for g in trees])
    found = []
    for k, (g, own) in enumerate(trees.items()):
        for place, r in enumerate(own):
            found.append((*r, levels[g][-1][0], top[-1][0], "".join(_plain_siblings(levels[g], place) + _plain_siblings(top, k))))
    return sorted(found, key=str)


@pytest.mark.parametrize("piece, block", [(4, (2, 1)), (7, (1, 1)), (4096, (13, 9))])
def test_proofs(spark, monkeypatch, piece, block):
    monkeypatch.setattr(merkle, "PIECE", piece)
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b", "b", "b", "b", "é", "c", None]), rng.randint(0, 40), _h(str(k))) for k in range(200)]
    rows += [("one", 1, _h("x")), ("b", None, _h("y")), ("b", 7, _h("z")), ("b", 7, _h("z")), (None, None, _h("y"))]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string")
    got = merkle.prove(merkle.build(df, "source", "doc_id", "leaf"))
    found = got.select("group", "key", "digest", "subroot", "root", merkle.siblings(F.col("proof")), merkle.fold(F.col("digest"), F.col("proof")).alias("folded"))
    found = [tuple(r) for r in found.collect()]
    assert all(r[4] == r[6] for r in found)
    assert sorted((r[:6] for r in found), key=str) == _plain_proofs(rows)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PIECE", 5)
    monkeypatch.setattr(merkle, "BLOCK", (2, 2))
    rows = [(f"g{k % 61:02d}", k, _h(str(k))) for k in range(150)]
    got = merkle.prove(merkle.build(spark.createDataFrame(rows, "g string, k long, d string"), "g", "k", "d"))
    assert sorted((tuple(r) for r in got.select("group", "key", "digest", "subroot", "root", merkle.siblings(F.col("proof"))).collect()), key=str) == _plain_proofs(rows)


def test_small_manifests(spark):
    empty = spark.createDataFrame([], "g string, k long, d string")
    assert merkle.prove(merkle.build(empty, "g", "k", "d")).count() == 0
    lone = merkle.prove(merkle.build(spark.createDataFrame([("a", 1, _h("a"))], "g string, k long, d string"), "g", "k", "d")).first()
    assert (lone.subroot, lone.root, lone.proof) == (_h("a"), _h("a"), [])


def test_altered_leaf_does_not_fold_to_root(spark):
    rows = [("a", k, _h(str(k))) for k in range(10)]
    got = merkle.prove(merkle.build(spark.createDataFrame(rows, "g string, k long, d string"), "g", "k", "d"))
    assert got.where(merkle.fold(F.sha2("digest", 256), F.col("proof")) == F.col("root")).count() == 0


def test_missing_is_minimal():
    """Without any one listed node some proof cannot be derived; with all of them every one can."""
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 28, 100):
        levels = _plain_tree([_h(str(k)) for k in range(n)])
        places = sorted(rng.sample(range(n), min(n, 7)))
        need = merkle.missing(places, n)
        for left_out in [None, *need]:
            known = {0: {p: levels[0][p] for p in places}}
            for level, place in need:
                if (level, place) != left_out:
                    known.setdefault(level, {})[place] = levels[level][place]
            top = merkle.derive(known, n)
            assert (known.get(top, {}).get(0) == levels[-1][0]) == (left_out is None)


def test_leaf_fields(spark):
    row = spark.createDataFrame([(12, None, "", "é")], "a long, b string, c string, d string").select(merkle.leaf(*map(F.col, "abcd")).alias("x")).first()
    assert row.x == _h("2:12-0:2:é")


# ------------------------------------------------------------------ mixing


def _plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest, share = total - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in order if s not in stopped)
        target = {s: most * sizes[s] if s in stopped else weight[s] * rest / share for s in order}
        over = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def _mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>, size long, place int, `key` string")
    return mixing.mix(df, F.col("doc_id"), F.col("text"), F.col("members"))


def _rows(rng, n, members):
    return [(k, " ".join(["w"] * rng.randint(0, 60)), members(k), 1, 2, "x") for k in range(n)]


def test_mix_of_separate_sources(spark):
    rng = random.Random(2)
    rows = _rows(rng, 300, lambda k: [rng.choice(["a", "b", "b", "b", "c", "d", "tiny" if k == 5 else "a", None])])
    rows += [(5, None, ["a"], 1, 2, "x"), (None, "x y z", ["b"], 1, 2, "x"), (7, "p q", ["c"], 1, 2, "x"), (7, "p q", ["c"], 1, 2, "x"), (8, " ", ["empty-of-words"], 1, 2, "x"), (9, "", ["none"], 1, 2, "x"), (10, "of no source", [], 1, 2, "x")]
    got = _mixed(spark, rows).collect()
    want = _plain_targets({s: sum(len(r[1].split(" ")) if r[1] else 0 for r in rows if s in r[2]) for s in {m for r in rows for m in r[2]}})
    assert len(got) == len(rows) - 1
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())
    again = _mixed(spark, rows[::-1])
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def test_mix_of_overlapping_sources(spark):
    """Quotas that the words of overlaps can meet are met, and no document gives more than three times its words."""
    rng = random.Random(4)
    rows = _rows(rng, 200, lambda k: rng.choice([["a"], ["b"], ["a", "b"], ["b", "c"], ["c"], ["d"], ["a", "a"]]))
    got = _mixed(spark, rows).collect()
    taken, given = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        given[r.doc_id] = given.get(r.doc_id, 0) + r.taken
        assert r.taken >= 0
    size = {r[0]: len(r[1].split()) for r in rows}
    assert all(given[k] <= 3 * size[k] for k in size)
    aims = {r.source: r.target for r in got}
    capacity = {s: 3 * sum(size[r[0]] for r in rows if s in r[2]) for s in aims}
    assert sum(taken.values()) <= 3 * sum(size.values())
    assert all(taken[s] <= round(aims[s]) <= capacity[s] for s in aims)
    assert sum(taken.values()) == _best_flow(rows, size, aims)[0]


def _best_flow(rows, size, aims, most=3):
    """Greatest flow and its least cost, by single augmenting paths."""
    patterns = {}
    for r in rows:
        key = tuple(sorted(set(r[2])))
        patterns[key] = patterns.get(key, 0) + size[r[0]]
    arcs = []
    for p, w in patterns.items():
        arcs += [["s", p, w, c] for c in range(most)] + [[p, ("q", s), most * w, 0] for s in p]
    arcs += [[("q", s), "t", round(a), 0] for s, a in aims.items()]
    residual = [a for u, v, w, c in arcs for a in ([u, v, w, c], [v, u, 0, -c])]
    flow = cost = 0
    while True:
        far, via = {"s": 0}, {}
        for _ in range(len(residual)):
            moved = False
            for i, (u, v, w, c) in enumerate(residual):
                if w and u in far and far[u] + c < far.get(v, 10**9):
                    far[v], via[v], moved = far[u] + c, i, True
            if not moved:
                break
        if "t" not in far:
            return flow, cost
        path, v = [], "t"
        while v != "s":
            path.append(via[v])
            v = residual[via[v]][0]
        least = min(residual[i][2] for i in path)
        for i in path:
            residual[i][2] -= least
            residual[i ^ 1][2] += least
        flow, cost = flow + least, cost + least * far["t"]


def test_route_is_of_least_cost():
    rng = random.Random(9)
    for _ in range(40):
        n, m = rng.randint(1, 6), rng.randint(1, 5)
        members = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(n)]
        words, quotas = [rng.randint(0, 30) for _ in range(n)], {s: rng.randint(0, 60) for s in range(m)}
        quotas = {s: q for s, q in quotas.items() if any(s in own for own in members)}
        found = mixing.route(words, members, quotas)
        out = [sum(w for (k, _), w in found.items() if k == i) for i in range(n)]
        into = {s: sum(w for (_, t), w in found.items() if t == s) for s in quotas}
        assert all(o <= 3 * w for o, w in zip(out, words, strict=True)) and all(into[s] <= q for s, q in quotas.items())
        cost = sum(max(0, o - w) + max(0, o - 2 * w) for o, w in zip(out, words, strict=True))
        rows = [(i, None, own) for i, own in enumerate(members)]
        by_pattern = {}
        for i, own in enumerate(members):
            by_pattern.setdefault(tuple(own), []).append(i)
        if all(len(v) == 1 for v in by_pattern.values()):
            assert (sum(out), cost) == _best_flow(rows, dict(enumerate(words)), quotas)


def test_ends_in_crowded_ranges(spark, monkeypatch):
    """Many rows of one id, so that an end falls among equal documents and counts go on into their numbers."""
    monkeypatch.setattr(mixing, "MOST_ORDERED", 3)
    rows = [(1, "a b c", ["s" if k % 2 else "t"], 1, 2, "x") for k in range(100)]
    got = _mixed(spark, rows).collect()
    assert len(got) == 100
    for source, weight in (("s", 5), ("t", 2)):
        own = [r.taken for r in got if r.source == source]
        assert sum(own) == round(300 * weight / 7) and max(own) - min(own) <= 3


def test_empty_mix(spark):
    assert _mixed(spark, []).count() == 0
    assert [r.taken for r in _mixed(spark, [(1, None, ["a"], 1, 2, "x"), (2, " \n", [None], 1, 2, "x")]).collect()] == [0, 0]


def test_words(spark):
    texts = ["a  b\tc\n", "", None, "\x0b\x0c", "a b c", "x" * 100_000 + " y"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words_of(F.col("t"))).collect()] == [3, 0, 0, 0, 1, 2]


# ------------------------------------------------------------------ vector codes


def _plain_codes(rows, entries=16, rounds=6):
    kept = [(i, label, np.floor(np.array(v, float) * 4096).astype(int)) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    parts = [np.array([np.split(v, 8)[p] for _, _, v in kept]) for p in range(8)]
    books = [p[:entries].copy() for p in parts]
    near = lambda: [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(parts, books, strict=True)]
    for _ in range(rounds):
        for p, d in enumerate(near()):
            mine = d.argmin(1)
            for k in range(len(books[p])):
                if (mine == k).any():
                    books[p][k] = [int(s) // int((mine == k).sum()) for s in parts[p][mine == k].sum(0)]
    last = near()
    errors = sum(d.min(1) for d in last)
    code = ["".join(f"{d[k].argmin():02x}" for d in last) for k in range(len(kept))]
    total = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + int(e)
    digest = _h(",".join(str(x) for b in books for row in b for x in row))
    return sorted(((i, c, int(e), total[label], digest) for (i, label, _), c, e in zip(kept, code, errors, strict=True)), key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, b"t") for i, label, v in rows], "vec_id long, label int, embedding array<float>, code string, error int, trees binary")


def _coded(spark, rows):
    coded, books = codes.encode(_vectors(spark, rows))
    return [(*tuple(r), codes.books_sha256(books)) for r in codes.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()]


@pytest.mark.parametrize("piece, leaf", [(8192, 128), (50, 4), (300, 20)])
def test_codes(spark, monkeypatch, piece, leaf):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 16))
    rows = [(k, int(rng.integers(4)) if k % 5 else None, (centres[k % 9] + rng.normal(scale=0.1 + k % 3, size=16)).astype(np.float32).tolist()) for k in range(400)]
    rows += [(1000 + k, 1, rows[3][2]) for k in range(300)]  # a frequent vector
    rows += [(2000, 1, None), (2001, 1, [None] * 16), (2002, 1, [float("nan")] * 16), (2003, 1, [float("inf")] + [0.0] * 15), (None, 2, rows[4][2]), (5, 2, rows[5][2]), (5, 2, rows[5][2])]
    rows += [(3000 + k, 0, [float(x) for x in np.round(rng.normal(size=16))]) for k in range(200)]  # many ties
    monkeypatch.setattr(codes, "PIECE", piece)
    monkeypatch.setattr(codes, "LEAF", leaf)
    assert sorted(_coded(spark, rows), key=str) == _plain_codes(rows)


def test_few_vectors(spark):
    assert _coded(spark, []) == []
    assert _coded(spark, [(1, None, None)]) == []
    rows = [(k, None, [float(k)] * 8) for k in range(3)]
    assert sorted(_coded(spark, rows), key=str) == _plain_codes(rows)


def test_vectors_of_other_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="length 8"):
        _coded(spark, [(1, 1, [0.0] * 8), (2, 1, [0.0] * 16)])
    with pytest.raises(ValueError, match="equal parts"):
        _coded(spark, [(1, 1, [0.0] * 9)])


def test_owners_equal_brute_force_and_skip_points(monkeypatch):
    """Sums, counts and codes are those of all distances; balls far from disputes are owned without a look at their points."""
    monkeypatch.setattr(codes, "LEAF", 8)
    rng = np.random.default_rng(0)
    centres = rng.integers(-40_000, 40_000, (12, 4))
    points = (centres[rng.integers(0, 12, 3000)] + rng.integers(-300, 300, (3000, 4))).astype(np.int64)
    tree, book = codes.build_tree(points), centres[:5].astype(np.int64)
    mine = np.zeros(3000, np.int64)
    sums, counts = codes.owners(tree, book, mine)
    want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (mine == want).all() and (counts == np.bincount(want, minlength=5)).all()
    assert all((sums[k] == points[want == k].sum(0)).all() for k in range(5))
    shuffled = tree | {"points": np.zeros_like(tree["points"])}  # owned balls do not read their points
    blind = codes.owners(shuffled, book)[1]
    assert blind.sum() == 3000 and abs(blind - counts).sum() < 600


def test_trees_hold_every_point_once(monkeypatch):
    monkeypatch.setattr(codes, "LEAF", 3)
    rng = np.random.default_rng(2)
    for points in (rng.integers(-9, 9, (500, 2)), np.zeros((40, 3), int), np.arange(7)[:, None]):
        tree = codes.build_tree(points.astype(np.int64))
        assert sorted(tree["order"].tolist()) == list(range(len(points)))
        for (start, end, _, _), centre, radius, total in zip(tree["nodes"], tree["centre"], tree["radius"], tree["total"], strict=True):
            own = points[tree["order"][start:end]]
            assert (own.sum(0) == total).all() and (np.sqrt(((own - centre) ** 2).sum(1)) <= radius + 1e-9).all()


# ------------------------------------------------------------------ gazetteers


def test_other_gazetteers_change_votes_and_not_base_spans(spark):
    from revisor.llm import pii

    rows = [(1, "mail a@b.org then ZQKEY_12ab34cd56 and flapdoodle2024xx"), (2, "nothing"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def votes(known):
        found = pii.with_candidates(pii.with_base(texts), known).where("doc_id = 1").first()
        return [(m.prefix, m.ordinary) for m in found.maybe], [(s.start, s.stop) for s in found.base]

    given, more = votes(pii.Gazetteers()), votes(pii.Gazetteers(prefixes=(*pii.KEY_PREFIXES, "ZQKEY_", "ZQ"), ordinary=(*pii.ORDINARY, "flapdoodle")))
    assert given == ([(0, 0), (0, 0)], [(5, 12)]) and more == ([(1, 0), (0, -1)], [(5, 12)])
    base = lambda known: [tuple(r) for r in pii.find(docs, known=known).select("doc_id", pii.as_text(F.col("base"))).collect()]
    assert sorted(base(pii.Gazetteers())) == sorted(base(pii.Gazetteers(prefixes=("ZQ",), ordinary=())))
