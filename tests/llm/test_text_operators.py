"""Corpus operators against brute force, on fixtures with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from revisor.llm import chat, decontaminate, exact_dedup, packing, pii, quality, sharding, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, digest string, fp long, shard int, `rank` int"


def _docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s0", "d", 1, 2, 3) for i, t in rows], DOCS)


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, _words(rng, rng.choice([1, 3, 4, 5, 40, 400]))) for i in range(60)]
    base = _words(rng, 300).split()
    for k in range(12):  # near copies: one word changed
        words = list(base)
        words[k * 20] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, rows[5][1]), (204, rows[5][1].upper()), (205, rows[5][1] + "  \n"), (206, rows[5][1]), (206, rows[5][1]), (None, rows[7][1]), (207, _words(rng, 30_000)), (208, "x" * 300_000)]
    return rows


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup(spark, corpus):
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((i, len(t or "")))
    want = []
    for digest, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        kept = rows.index(keep)  # of rows that are the same in id and length, one
        want += [(i, keep[0], len(rows), k == kept, digest) for k, (i, _) in enumerate(rows)]
    got = [tuple(r) for r in exact_dedup.exact_dedup(_docs(spark, corpus)).drop("row").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(_docs(spark, [])).count() == 0


def test_index_inserts_and_deletes(spark):
    rows = exact_dedup.digests(_docs(spark, [(i, f"text {i % 50}") for i in range(200)])).cache()
    index = exact_dedup.insert(exact_dedup.new_index(spark, 3), rows)
    assert {tuple(r) for r in exact_dedup.live(index).select("copies").collect()} == {(4,)}
    twice = exact_dedup.insert(index, rows.where("doc_id >= 50"))
    assert exact_dedup.live(twice).count() == 50 and {r.copies for r in exact_dedup.live(twice).collect()} == {7}
    assert {r.keep_id for r in exact_dedup.live(twice).collect()} == set(range(50))
    gone = rows.where("doc_id < 10")
    less = exact_dedup.delete(index, gone)
    assert exact_dedup.live(less).count() == 40
    assert exact_dedup.live(exact_dedup.delete(less, gone)).count() == 40
    again = exact_dedup.insert(less, gone)
    assert exact_dedup.live(again).count() == 50
    assert exact_dedup.live(exact_dedup.delete(again, rows)).count() == 0


def test_only_hits_of_the_filter_are_looked_up(spark, monkeypatch):
    looked_up = []
    written = exact_dedup.written

    def watched(df, name="table"):
        out = written(df, name)
        if name == "stored":
            looked_up.append(out.count())
        return out

    monkeypatch.setattr(exact_dedup, "written", watched)
    texts = lambda a, b: exact_dedup.digests(_docs(spark, [(i, f"text {i}") for i in range(a, b)])).cache()
    index = exact_dedup.insert(exact_dedup.new_index(spark, 2), texts(0, 3000))
    assert looked_up == []  # an empty index is never read
    grown = exact_dedup.insert(index, texts(3000, 9000))  # filters overflow and are rebuilt
    assert sum(looked_up) <= 10  # none of these is stored; a few tags are alike
    assert exact_dedup.live(grown).count() == 9000
    looked_up.clear()
    same = exact_dedup.insert(grown, texts(0, 100))
    assert sum(looked_up) == 100 and exact_dedup.live(same).count() == 9000
    filters = {r.bucket: exact_dedup.CuckooFilter.from_bytes(bytes(r["filter"])) for r in grown.filters.collect()}
    assert all(r.digest in filters[r.bucket] for r in grown.content.select("bucket", "digest").collect())
    assert exact_dedup.live(exact_dedup.delete(same, texts(50, 8950))).count() == 100


def test_false_hits_are_added_and_deleted_apart(spark, monkeypatch):
    """A filter that says yes to everything: all is decided by the content."""
    monkeypatch.setattr(exact_dedup.CuckooFilter, "__contains__", lambda *_: True)
    rows = exact_dedup.digests(_docs(spark, [(i, f"text {i % 20}") for i in range(40)])).cache()
    index = exact_dedup.insert(exact_dedup.new_index(spark, 2), rows)
    assert sorted(r.copies for r in exact_dedup.live(index).collect()) == [2] * 20
    assert exact_dedup.live(exact_dedup.delete(index, rows.where("doc_id < 5"))).count() == 15


def test_deduplication_goes_through_the_filters(spark, monkeypatch):
    """Copies of an earlier batch are hits that the content decides; filters overflow on the way; a filter that lies changes the look-ups, not the rows."""
    written, made = exact_dedup.written, {}

    def watched(df, name="table"):
        out = written(df, name)
        made.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(exact_dedup, "written", watched)
    docs = _docs(spark, [(i, f"text {i % 2000}") for i in range(3000)])
    rows = sorted(map(str, exact_dedup.exact_dedup(docs).drop("row").collect()))
    hits = [t.where("hit").count() for t in made["asked"] if t.columns == ["bucket", "filter", "digest", "hit"]]
    stored = [t.count() for t in made["stored"]]
    assert hits[0] == 0 and sum(hits) >= sum(stored) > 500  # what was looked up are the hits, not the whole index
    assert sum(t.where("digest is null and filter is null").count() for t in made["asked"]) > 0 and made["filters"]  # overflow, and filters made anew
    made.clear()

    honest = exact_dedup._probe_and_add

    def liar(key, filters, batch):
        answer = honest(key, filters, batch)
        hit = pa.array([None if h is None else h or (len(filters) > 0 and d < "4") for h, d in zip(answer.column("hit").to_pylist(), answer.column("digest").to_pylist(), strict=True)], pa.bool_())
        return answer.set_column(3, "hit", hit)

    monkeypatch.setattr(exact_dedup, "_probe_and_add", liar)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).drop("row").collect())) == rows
    assert sum(t.where("hit").count() for t in made["asked"] if "hit" in t.columns) > sum(hits)


def test_cuckoo_filter_grows_from_its_keys():
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)]
    small = exact_dedup.CuckooFilter.sized(64)
    assert not all(small.add(k) for k in keys)  # overflows
    grown = exact_dedup._filled(keys, 64)
    assert all(k in grown for k in keys)
    assert exact_dedup.CuckooFilter.from_bytes(grown.tags.tobytes()).tags == grown.tags
    grown.remove(keys[0])
    assert sum(k in grown for k in keys[1:]) == len(keys) - 1
    other = sum(hashlib.sha256(f"x{i}".encode()).hexdigest() in grown for i in range(5000))
    assert other < 25


# ---------------------------------------------------------------- simhash


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _plain_components(rows):
    ids = list(range(len(rows)))
    root = list(ids)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in ids:
        for b in ids[:a]:
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k in ids:
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return [least.get(find(k)) for k in ids]


def test_near_duplicates(spark, corpus):
    rows = [(i, _plain_fingerprint(t)) for i, t in corpus]
    want = sorted(str((i, f"{fp:016x}", c)) for (i, fp), c in zip(rows, _plain_components(rows), strict=True))
    got = sorted(str(tuple(r)) for r in simhash.near_duplicates(_docs(spark, corpus)).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want
    named = simhash.near_duplicates(_docs(spark, corpus)).groupBy("component_id").agg(F.sum(F.col("named").cast("int")).alias("n")).collect()
    assert all(r.n == 1 for r in named)
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


@pytest.mark.parametrize(("blocks", "split"), [(6, 20_000), (7, 100), (8, 20_000), (6, 10), (12, 20_000)])
def test_all_links_of_dense_and_sparse_fingerprints(spark, blocks, split, monkeypatch):
    """Chains, a dense group beyond the size of a walked cell, and unrelated ones; the same for any number of blocks and split cells."""
    rng = random.Random(blocks)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(500)}
    chain = rng.getrandbits(64)
    for k in range(15):
        chain ^= sum(1 << b for b in range(4 * k, 4 * k + 4))
        fps.add(chain)
    rows = list(enumerate(fps))
    monkeypatch.setattr(simhash, "blocks_for", lambda n: blocks)
    monkeypatch.setattr(simhash, "SPLIT_ROWS", split)
    df = spark.createDataFrame([(i, i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows], "doc_id long, row long, fp long")
    got = dict(df.join(simhash.components(df), "fp").select("doc_id", "component_id").collect())
    assert [got[i] for i, _ in rows] == _plain_components(rows)


def test_long_texts_are_read_in_blocks(monkeypatch):
    text = _words(random.Random(1), 3000)
    whole = simhash.fingerprint(text.encode())
    from revisor.llm import common

    monkeypatch.setattr(common.word_blocks, "__defaults__", (50, 0))
    assert simhash.fingerprint(text.encode()) == whole == _plain_fingerprint(text)


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    rng = random.Random(9)
    items = [_words(rng, 30) for _ in range(8)]
    cut = items[1].split()
    reordered = " ".join([*cut[15:], "between", *cut[:15]])
    partial = " ".join(items[2].split()[:15])
    changed = items[3].split()
    changed[12] = "other"
    rows = [(1, "before " + items[0] + " after"), (2, reordered), (3, partial), (4, " ".join(changed)), (5, None), (6, ""), (7, _words(rng, 5000) + " " + items[4].upper()), (8, items[5]), (8, items[5]), (None, items[6]), (9, _words(rng, 20_000))]
    benchmark = spark.createDataFrame([*enumerate(items), (20, None), (21, ""), (22, "one two"), (23, items[5])], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.leaks(_docs(spark, rows), benchmark).collect())
    assert got == [(-1, 6), (1, 0), (2, 1), (4, 3), (7, 4), (8, 5), (8, 5), (8, 23), (8, 23)]
    assert decontaminate.leaks(_docs(spark, []), benchmark).count() == 0
    assert decontaminate.leaks(_docs(spark, rows), benchmark.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [_words(rng, 20) for _ in range(10)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = _docs(spark, [(i, t + " end") for i, t in enumerate(items)])
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 60)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()) == [(i, i) for i in range(10)]


def _plain_tiling(item, text, least):
    """Textbook greedy string tiling, cubic."""
    a, b, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best, found = least, []
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and a[p + n] and b[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, t, n)]
                elif n == best:
                    found.append((p, t, n))
        marked = False
        for p, t, n in found:
            if all(a[p : p + n]) and all(b[t : t + n]):
                a[p : p + n], b[t : t + n] = [False] * n, [False] * n
                tiles.append((p, t, n))
                marked = True
        if not marked:
            return tiles


def test_tiles_are_those_of_the_textbook():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 25))]
        text = [rng.randint(1, 5) for _ in range(rng.randint(0, 40))]
        got = decontaminate.tile(np.array(item, np.uint32), np.array(text, np.uint32), 3)
        assert got == _plain_tiling(item, text, min(3, len(item)))


def test_rolling_hashes_tell_windows_apart():
    rng = random.Random(2)
    ids = np.array([rng.randint(0, 3) for _ in range(400)], np.uint32)
    hashes = decontaminate.Rolling(ids)
    for width in (1, 2, 5, 40, 400, 401):
        found = hashes.windows(width).tolist()
        windows = [tuple(ids[i : i + width]) for i in range(max(0, len(ids) - width + 1))]
        assert len(found) == len(windows) and len(set(zip(found, windows, strict=True))) == len(set(found)) == len(set(windows))


def test_the_bound_loses_no_leak():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    block = decontaminate.Items(list(enumerate(texts)), 3)
    for _ in range(40):
        words = [rng.choice("abcde") for _ in range(rng.randint(0, 60))]
        ids = np.fromiter((block.vocabulary.get(w, 0) for w in words), np.uint32)
        want = []
        for k, item in block.items:
            tiles = _plain_tiling(item.tolist(), [int(i) or -1 for i in ids], min(3, len(item)))
            if sum(t[2] for t in tiles) / len(item) >= 0.8:
                want.append((k, len(tiles)))
        assert [(k, n) for k, _, n in block.matches(words, 0.8)] == want


def test_tokens_of_long_texts_are_not_cut():
    text = "ab, cd_1\u00e9 x-y " * 50
    assert list(decontaminate.tokens(text, 7)) == re.findall(r"\w+", text)


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("specials_as_text", [False, True])
def test_packing(spark, corpus, tokenizer, specials_as_text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    if specials_as_text:
        plain.encode_special_tokens = True
    rows = [(i, t) for i, t in corpus if i is not None and i != 206] + [(300, "Tab\tand\nline <|endoftext|> é Σ"), (301, "a\x1cb c")]
    packed = packing.pack(_docs(spark, rows), tokenizer, specials_as_text=specials_as_text, with_ids=True)
    got = packed.toPandas()
    whole = {r.sequence_id: (np.frombuffer(r.ids, "<u4"), r.n_tokens) for r in packing.sequences(packed).collect()}
    assert all(len(ids) == 2048 and not ids[n:].any() for ids, n in whole.values())
    for p in got.itertuples():
        assert whole[p.sequence_id][0][p.offset : p.offset + p.length].astype("<u4").tobytes() == p.ids
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("start")
        assert own["length"].sum() == len(ids) == own.doc_tokens.iloc[0]
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s["length"]).tolist()[:-1]] and s["length"].sum() <= 2048
    assert packing.pack(_docs(spark, []), tokenizer).count() == 0


def test_queries_encode_like_the_tokenizer_as_loaded(spark, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from revisor.llm import queries

    plain = Tokenizer.from_file(tokenizer)
    docs = _docs(spark, list(enumerate(["end of it <|endoftext|> next", "a<|endoftext|>.B", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|other|>", None])))
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    want = {}
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for rows in (queries.op6_packing(spark, ""), corpus_pipeline.packed(spark, docs, "")):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows.collect()} == want


def test_plan_places_every_length():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 500) for n in rng.sample(range(1, 2049), 300)} | {1: 100_000}
    patterns = packing.plan_packs(histogram)
    placed = collections.Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] += count
    assert dict(placed) == histogram
    used, total = sum(n * c for n, c in histogram.items()), 2048 * sum(c for c, _ in patterns)
    assert used / total > 0.97


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["grumblefink", "zorkwad", "snivelpot"]
    rows, labels = [], []
    for i in range(900):
        words = _words(rng, 40).split()
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(0, None), (3, 0)]
    gold = spark.createDataFrame(labels, "doc_id long, toxic int")
    odd = [(2000, None), (2001, ""), (2002, "x" * 100_000), (2003, "a b grum-ble-fink"), (2004, "you z.o.r.k.w.a.d now"), (2005, "you z o r k w a d now"), (2006, "such a snivelxpot"), (None, "text")]
    docs = _docs(spark, rows + odd)
    model = toxicity.fit(docs, gold)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = {r.doc_id for r in docs.where(toxicity.held_out()).select("doc_id").collect()}
    assert held >= {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = [i for i, t in labels if i in held and t is not None and got[i].predicted != t]
    assert len(wrong) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].predicted for i in (2000, 2001, 2002)] == [0, 0, 0]
    assert [got[i].predicted for i in (2003, 2004, 2005)] == [1, 1, 1]
    assert got[2006].score > got[2001].score
    assert toxicity.toxicity(_docs(spark, []), model).count() == 0


def test_toxicity_without_both_classes(spark):
    docs = _docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()} == {0}


def test_kernel_is_the_sum_over_subsequences():
    def subsequences(word):
        out = collections.Counter()
        for a in range(len(word)):
            for b in range(a + 1, len(word)):
                for c in range(b + 1, len(word)):
                    for d in range(c + 1, min(len(word), a + toxicity.SPAN)):
                        out[word[a] + word[b] + word[c] + word[d]] += toxicity.DECAY ** (d - a + 1)
        return out

    words = ["gapped", "grapped", "abcdabcd", "zz"]
    rows, weights = np.full(toxicity._TABLE, -1), []
    entries = list(toxicity._subsequences(*toxicity._flat(words)))
    used = np.unique(np.concatenate([e[0] for e in entries]))
    rows[used] = np.arange(len(used))
    weights = np.zeros((len(used), len(words)))
    for index, own, w in entries:
        np.add.at(weights, (rows[index], own), w)
    kernel = toxicity._kernel(words, rows, weights)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            a, b = subsequences(x), subsequences(y)
            assert kernel[i, j] == pytest.approx(sum(v * b[k] for k, v in a.items()))


def test_folded_table_gives_the_margins_of_the_nystrom_space():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 12))) for _ in range(60)]
    space = toxicity._Landmarks(words[:20])
    w = np.random.default_rng(5).normal(size=space.to_space.shape[1])
    dense = np.zeros((len(words), toxicity._TABLE))
    for index, own, weight in toxicity._subsequences(*toxicity._flat(words)):
        np.add.at(dense, (own, index), weight)
    marks = dense[:20] / np.maximum(np.linalg.norm(dense[:20], axis=1, keepdims=True), 1e-12)
    kernel, own = dense @ marks.T, marks @ marks.T
    found = space.features(words)  # the space is known but for a rotation: its products are what counts
    assert np.allclose(found @ found.T, kernel @ np.linalg.pinv(own, rcond=1e-6, hermitian=True) @ kernel.T, atol=1e-6)
    assert np.allclose(space.features(words) @ w, toxicity.table_scores(words, space.folded(w)), atol=1e-6)


def test_a_toxic_documents_other_sentences_are_not_held_against_their_words():
    rng = random.Random(12)
    bags = toxicity._Sentences()
    for i in range(120):
        sentences = [_words(rng, 8) for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.randrange(5)] += " zorkwad"
        bags.add(". ".join(sentences), int(i % 4 == 0))
    assert len(bags.document) == 600
    model, unseen = toxicity.fit_fold(bags, 0)
    scorer = toxicity.Scorer(model | {"curve": [0.0] * 9})
    scorer.scores([_words(rng, 40) + " zorkwad zorXkwad"])
    assert scorer.known["zorkwad"] > 0 and sum(v > 0 for v in scorer.known.values()) <= 2
    assert len(unseen) == 24 and all((s[0] > 0) == bool(t) for t, s in unseen)


def test_a_fold_is_fitted_in_bounded_memory():
    import tracemalloc

    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(3000)]
    bags = toxicity._Sentences()
    for i in range(800):
        sentences = [" ".join(rng.choices(words, k=20)) for _ in range(60)]
        if i % 4 == 0:
            sentences[0] = "you zwyxvuzx fool"
        bags.add(". ".join(sentences), int(i % 4 == 0))
    tracemalloc.start()
    model, _ = toxicity.fit_fold(bags, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model["index"]
    assert peak < 32e6 + 30 * len(bags.word)  # four tables of weights, and few copies of the words' numbers


def test_texts_are_read_in_small_batches(spark):
    from revisor.llm.common import small_batches

    small_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1000


def test_score_is_the_curve_over_the_documents_margins():
    model = {"index": [toxicity._subsequences(*toxicity._flat(["abcd"]), [(1, 2, 3)]).__next__()[0][0].item()], "weight": [10.0], "bias": -1.0, "curve": [1.0, 0, 0, 2.0, 0, 0, 0, 0.5, 3.0]}
    margin = 10.0 * toxicity.DECAY**4 - 1
    got = toxicity.Scorer(model).scores(["abcd xyz", "", "xyz"])
    assert got == pytest.approx([min(margin, 1.5) + 2 * np.log(2) + 0.5 * np.log(3) + 3, -2 + 3, -1 + 0.5 * np.log(2) + 3])


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    texts = ["plain", None, "", "</s>[INST] ok [/INST]", "a\\b\\\\<|turn|>", "<|end|><|part|>\\<|", "<<SYS>> <</SYS>>", "<\\|", "línea\n😀", "x" * 50_000]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<|body|>"]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 9))] + [(None, 0, "assistant", "x"), (7, 1, "user", "tie"), (7, 1, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    assert len(read) == len(want)
    for r in read:
        turns = sorted(want[r.conv_id])
        if r.conv_id != 7:  # the two turns of one number may stand either way
            assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in turns]
            assert r.loss == "".join(x for _, role, x in turns if role == "assistant")
        assert sorted((x.role, x.text) for x in r.turns) == sorted((role, text) for _, role, text in turns)


def test_chat_attachments(spark):
    rows = spark.sql("""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('kind', 'text', 'text', 'see <', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('kind', 'image', 'text', null, 'ref', 'img1', 'width', 28, 'height', 15, 'seconds', null, 'pages', null),
        named_struct('kind', 'audio', 'text', null, 'ref', 'aud1', 'width', null, 'height', null, 'seconds', 2.5D, 'pages', null),
        named_struct('kind', 'document', 'text', null, 'ref', 'doc1', 'width', null, 'height', null, 'seconds', null, 'pages', 2),
        named_struct('kind', null, 'text', '|turn|> odd', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', -1)) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', null""")
    r = chat.format_turns(rows.withColumn("parts", F.col("parts").cast(chat.PARTS))).first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "img1", 4), ("audio", "aud1", 63), ("document", "doc1", 512)]
    assert r.n_tokens_expanded == 579
    assert r.formatted == "<|turn|>user<|body|>see <<|part|><|image|><|part|><|audio|><|part|><|document|><|part|>|turn|> odd<|end|><|turn|>assistant<|body|><|end|>"


# ---------------------------------------------------------------- PII


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_spans(text):
    def holds(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in _PLAIN.items() for m in re.finditer(p, text) if holds(k, m.group()))


def test_base_spans(spark):
    rng = random.Random(11)
    bits = ["a@b.c", "a.b+c@d-e.f.g", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "000255.0.0.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "é😀", "12", "-", ".", " ", "_", "@b.co", "5555555555554444", "0", "+"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ".", "x"]) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    texts += ["1" * 20_000, "a." * 20_000, "+" + "1 " * 9_000, "", "1.1." * 9_000]
    rows = [*enumerate(texts), (1000, None), (None, "a@b.c")]
    got = {r.doc_id: r.base for r in pii.find(_docs(spark, rows)).select("doc_id", pii.as_text(F.col("base")).alias("base")).collect()}
    assert [got[i] for i in range(len(texts))] == [_plain_spans(t) for t in texts]
    assert got[1000] == "" and got[None] == "email:0:5"
    assert pii.find(_docs(spark, [])).count() == 0


def test_secrets_are_added(spark):
    rng = random.Random(12)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(16)) for _ in range(40)] + ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(40)]
    rows = [(i, f"{_words(rng, 5)} {'password=' if i >= 40 else 'key '}{k} {_words(rng, 5)}") for i, k in enumerate(keys)]
    rows += [(100 + i, f"{_words(rng, 5)} washington{i} version_12_beta {_words(rng, 5)} user@mail{i}.example.com") for i in range(60)]
    got = {r.doc_id: r for r in pii.find(_docs(spark, rows)).collect()}
    text = dict(rows)
    assert sum(any(text[i][s.start : s.stop] == k for s in got[i].added) for i, k in enumerate(keys)) >= 76
    assert not any(got[100 + i].added for i in range(60))


# ---------------------------------------------------------------- sharding


def test_sharding(spark, corpus):
    df = _docs(spark, corpus)
    rows = sharding.shuffle_into_shards(df, "doc_id", "text", shards=4, bucket_bytes=20_000).cache()
    got = rows.select("record.*", F.col("shard").alias("s"), "slot", sharding.shard_of(F.col("record.doc_id"), 5, 7).alias("grown")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(corpus)
    for s in range(4):
        own = sorted(r.slot for r in got if r.s == s)
        assert own == list(range(len(own)))
    assert all(r.grown in (r.s, 4) for r in got) and any(r.grown == 4 for r in got)
    again = sharding.shuffle_into_shards(df.repartition(7), "doc_id", "text", shards=4, bucket_bytes=20_000)
    assert {tuple(r) for r in again.select("record.doc_id", "shard", "slot").collect()} == {tuple(r) for r in rows.select("record.doc_id", "shard", "slot").collect()}
    assert sharding.shuffle_into_shards(_docs(spark, []), "doc_id", "text").count() == 0


def test_buckets_stay_small_whatever_the_keys(spark):
    """A null id, a repeated id and a repeated record hold a third of the rows each; a task of many holds few of them."""
    rows = [(None, "t" * 99, str(i)) for i in range(400)] + [(7, "t" * 99, str(i)) for i in range(400)] + [(8, "t" * 99, "same")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, record string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        cut = sharding.shuffle_into_shards(df, "doc_id", "text", shards=2, bucket_bytes=4_000)
        got = cut.select("record.*", "shard", "slot", F.spark_partition_id().alias("task")).collect()
        again = sharding.shuffle_into_shards(df.repartition(7), "doc_id", "text", shards=2, bucket_bytes=4_000).select("record.*", "shard", "slot").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(collections.Counter(r.task for r in got).values()) < 150  # some 40 rows fill a bucket, which is a task of its own
    assert collections.Counter(tuple(r)[:3] for r in got) == collections.Counter(rows)
    assert {tuple(r)[:5] for r in got} == {tuple(r) for r in again}
    assert len({(r.doc_id, r.shard) for r in got}) == 3
    for s in {r.shard for r in got}:
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_shards_are_written(spark, corpus, tmp_path):
    df = _docs(spark, corpus)
    shuffled = sharding.shuffle_into_shards(df, "doc_id", "text", shards=3, bucket_bytes=20_000)
    sharding.write_shards(shuffled, f"file://{tmp_path}/s")
    back = sharding.read_shards(spark, f"file://{tmp_path}/s", shuffled.schema)
    plain = lambda d: collections.Counter(str(tuple(r)) for r in d.select("record", "shard", "slot").collect())
    assert plain(back) == plain(shuffled) and back.count() == len(corpus)
    for f in {r.f for r in back.select(F.input_file_name().alias("f")).distinct().collect()}:  # a file is a bucket, in the order of its slots
        slots = [r.slot for r in spark.read.parquet(f).select("slot").collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_order_within_a_shard_is_shuffled(spark):
    rows = sharding.shuffle_into_shards(_docs(spark, [(i, "t") for i in range(2000)]), "doc_id", "text", shards=2)
    order = [r.doc_id for r in rows.where("shard = 0").orderBy("slot").select("record.doc_id").collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1


# ---------------------------------------------------------------- WARC


def test_warc(spark):
    rng = random.Random(13)
    long_html, short = "<p>" + "é" * 100, "<p>s"
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}?q=1#f", rng.choice([long_html, short, None, f"<p>{i}" * 60])) for i in range(300)]
    rows += [(900, None, long_html), (901, "", long_html), (902, "http://h1.example.com/p/1", long_html), (902, "http://h1.example.com/p/1", long_html), (None, "http://[bad", long_html), (903, "http://x.com/\n\t", "<p>" * 30_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    payload = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        if i is not None and len(payload(h)) >= 100:
            first[payload(h)] = min(first.get(payload(h), i), i)
    want = []
    for i, _, h in rows:
        p = payload(h)
        refers = first[p] if p in first and first[p] != i else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if refers is not None else "response", refers))
    got = [tuple(r) for r in warc.archive_and_read(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archives_say_what_other_readers_need(spark, tmp_path):
    import gzip
    import pathlib

    same = "<p>" * 50
    pages = spark.createDataFrame([(1, "http://a.org/1", same), (2, "http://b.org/2", same), (2, "http://b.org/2", same), (3, "http://c.org/\u00e9", "<p>")], "page_id long, url string, html string")
    warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w").count()
    heads = []
    for f in pathlib.Path(tmp_path, "w").glob("*.warc.gz"):
        records = [r for r in gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\n") if r]
        found = [dict(line.split(": ", 1) for line in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")) for r in records]
        assert found[0]["WARC-Type"] == "warcinfo" and found[0]["WARC-Filename"] == f.name
        for r, head in zip(records, found, strict=True):
            assert len(r.partition(b"\r\n\r\n")[2]) == int(head["Content-Length"]) + 4
        heads += found
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads)
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and all(h["WARC-Refers-To-Target-URI"] == "http://a.org/1" and h["WARC-Refers-To-Date"] and "identical-payload-digest" in h["WARC-Profile"] for h in revisits)


def test_lookup_reads_only_what_is_asked(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a{i % 3}.org/{i}", f"<p>{i}") for i in range(100)], "page_id long, url string, html string")
    archives, index = f"file://{tmp_path}/w", f"file://{tmp_path}/i"
    directory = warc.write_index(warc.write_archives(warc.with_revisits(pages), archives), index, block_lines=7)
    assert directory.count() >= 100 // 7
    keys = spark.createDataFrame([(warc.url_key("http://a1.org/31"),), (warc.url_key("http://a1.org/31"),), ("nowhere",), ("zzz",)], "key string")
    got = warc.look_up(keys, directory, index, archives).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(31, b"<p>31")]
    assert warc.url_key("https://www.Example.com:8080/a?b=c#d") == "com,example:8080)/a?b=c"


# ---------------------------------------------------------------- quality


def test_quality(spark):
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        words = _words(rng, 60).split()
        text = " ".join(words) if good else " | ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good)))
    gold = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, None)], "doc_id long, quality int")
    docs = _docs(spark, [*rows, (900, None), (901, ""), (None, "text")])
    got = {r.doc_id: r for r in quality.quality(docs, gold, F.col("source"), F.lit(None).cast("string")).collect()}
    wrong = [i for i, g in labels if got[i].keep != bool(g)]
    assert len(wrong) <= 6 and len(got) == 603
    assert quality.quality(_docs(spark, []), gold, F.col("source"), F.col("lang")).count() == 0
    assert {r.keep for r in quality.quality(docs, gold.limit(0), F.col("source"), F.col("lang")).collect()} == {True}


def test_sparse_groups_shrink_to_their_parents(spark):
    """A host of good documents lifts its sparse path; a single document is judged by its own evidence and its parents."""
    rows = [(i, "good" if i < 400 else "bad", "p", 0.0) for i in range(800)] + [(900, "good", "new", 0.0), (901, "none", "new", 0.0)]
    evidence = {"good": 3.0, "bad": -3.0, "none": 0.0}
    frame = spark.createDataFrame([(i, h, p, *([0.0] * 8)) for i, h, p, _ in rows], "doc_id long, host string, path string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    frame = frame.withColumn("capitals", F.when(F.col("host") == "bad", 1.0).otherwise(0.0))
    model = {"": [evidence["good"]], "capitals": [0.0, 0, 0, 0, 0, 0, evidence["bad"] - evidence["good"]]}
    got = {r.doc_id: r for r in quality.posteriors(frame, 0.5, model).collect()}
    assert got[900].host_share > 0.8 and got[900].path_share > 0.7 > got[901].path_share
    assert got[0].quality > 0.95 and got[500].quality < 0.05


def test_posteriors_are_those_worked_out_by_hand(spark):
    """Every sum, shrinkage and share again, in plain Python."""
    import math

    rng = random.Random(31)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "b", "c", None, f"h{i}"])
        rows.append((i, host, rng.choice(["p", "q", None]), *(rng.choice([0.0, 0.02, 0.2, 1.0]) for _ in quality.FEATURES)))
    schema = "doc_id long, host string, path string, " + ", ".join(f"{f} double" for f in quality.FEATURES)
    model = {"": [0.3]} | {f: [rng.uniform(-1, 1) for _ in range(len(quality.EDGES[f]) + 1)] for f in quality.FEATURES}
    share = 0.6
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    curve = lambda x: 1 / (1 + math.exp(-x))
    own = {}
    for i, host, path, *x in rows:
        evidence = model[""][0] + sum(model[f][sum(v >= e for e in quality.EDGES[f])] for f, v in zip(quality.FEATURES, x, strict=True))
        own[i] = (host or "", path or "", evidence, curve(evidence + logit(share)))
    groups, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, _, prob in own.values():
        groups[h, p].append(prob)
        hosts[h].append(prob)

    def strength(parts):  # (probabilities, mean they are drawn to)
        many = [(v, m) for v, m in parts if len(v) > 1]
        between = sum(len(v) * ((sum(v) / len(v) - m) ** 2 - m * (1 - m) / len(v)) for v, m in many)
        if not many or between <= 0:
            return 1e4
        return min(1e4, max(1.0, sum(m * (1 - m) for _, m in many) / len(many) * sum(len(v) for v, _ in many) / between))

    host_weight = strength([(v, share) for v in hosts.values()])
    host_share = {h: (sum(v) + host_weight * share) / (len(v) + host_weight) for h, v in hosts.items()}
    path_weight = strength([(v, host_share[h]) for (h, _), v in groups.items()])
    got = {r.doc_id: r for r in quality.posteriors(spark.createDataFrame(rows, schema), share, model).collect()}
    for i, (h, p, evidence, prob) in own.items():
        host_left = (sum(hosts[h]) - prob + host_weight * share) / (len(hosts[h]) - 1 + host_weight)
        path_left = (sum(groups[h, p]) - prob + path_weight * host_left) / (len(groups[h, p]) - 1 + path_weight)
        assert (got[i].evidence, got[i].host_share, got[i].path_share, got[i].quality) == pytest.approx((evidence, host_left, path_left, curve(logit(path_left) + evidence)), abs=1e-9)


def test_few_remembered_words_give_the_same_ids(tokenizer):
    rng = random.Random(15)
    texts = [_words(rng, 80) + " Étude, naïve. x2 don't" for _ in range(30)]
    small, large = packing.WordEncoder(tokenizer), packing.WordEncoder(tokenizer)
    small.words, small.letters = packing.Recent(40), packing.Recent(40)
    for text in texts:
        ids = np.frombuffer(small.encode(text), "<u4").tolist()
        assert ids == np.frombuffer(large.encode(text), "<u4").tolist()
        assert ids == large.tokenizer.encode(text, add_special_tokens=False).ids


def test_hash_sample_is_the_least_hashes(spark):
    from revisor.llm.common import hash_sample

    rows = spark.range(10_000).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in hash_sample(rows, "doc_id", 100, 10_000).collect()}
    assert got == {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(100).collect()}
