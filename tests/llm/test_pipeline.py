"""The corpus pipeline on the small tables: each stage against a plain version."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        from revisor.llm.common import written

        out.append((name, written(stage(spark, out[-1][1], DIR), name)))
    return out


def test_stages_only_remove_rows(steps):
    for (_, before), (name, after) in zip(steps, steps[1:-1], strict=False):
        assert after.columns == before.columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name


def _bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_stage(steps):
    by = dict(steps)
    before, after = by["toxicity"].collect(), by["exact_dedup"].collect()
    assert sorted(map(_bare, {r.text for r in after})) == sorted({_bare(r.text) for r in before})
    assert len({_bare(r.text) for r in after}) == len(after)


def test_benchmark_stage(spark, steps):
    by = dict(steps)
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    plain = lambda r: " ".join(re.findall(r"\w+", (r.text or "").lower()))
    leaked = {r.doc_id for r in by["simhash"].collect() if any(f" {i} " in f" {plain(r)} " for i in items)}
    gone = {r.doc_id for r in by["simhash"].collect()} - {r.doc_id for r in by["decontamination"].collect()}
    assert leaked and leaked == gone


def test_near_stage(steps):
    from revisor.llm.simhash import fingerprint

    by = dict(steps)
    fps = [fingerprint((r.text or "").encode()) for r in by["simhash"].collect()]
    assert not any((a ^ b).bit_count() <= 4 for i, a in enumerate(fps) for b in fps[:i])


def test_packed_stage(steps):
    by = dict(steps)
    assert {r.doc_id for r in by["packing"].select("doc_id").collect()} == {r.doc_id for r in by["decontamination"].select("doc_id").collect()}


def test_run_is_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, DIR).count() == steps[-1][1].count()


def _filler(rng, n=60):
    return " ".join("".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_rows_without_an_id_and_rows_that_share_one(spark):
    """Null, shared and repeated ids: each row is judged by itself."""
    import random

    rng = random.Random(21)
    schema = "doc_id long, text string, row_key string"
    clean = [_filler(rng) for _ in range(6)]
    near = clean[5].upper()  # not an exact copy, but of the same fingerprint
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").orderBy("item_id").first().text
    kept = lambda stage, rows: sorted(map(str, map(tuple, stage(spark, spark.createDataFrame([(i, t, "k") for i, t in rows], schema), DIR).select("doc_id", "text").collect())))
    want = lambda *rows: sorted(map(str, rows))
    exact = [(None, clean[0]), (None, clean[0]), (1, clean[1]), (1, clean[1]), (2, clean[2]), (3, clean[2]), (3, clean[3]), (None, clean[2])]
    assert kept(corpus_pipeline.distinct_texts, exact) == want((None, clean[0]), (1, clean[1]), (2, clean[2]), (3, clean[3]))
    assert kept(corpus_pipeline.one_of_near_copies, [(None, near), (7, clean[5]), (7, clean[4]), (8, clean[3]), (8, clean[3])]) == want((7, clean[5]), (7, clean[4]), (8, clean[3]))
    leaked = f"{clean[0]} {item} {clean[1]}"
    assert kept(corpus_pipeline.without_benchmark, [(None, leaked), (None, clean[2]), (4, leaked), (4, clean[3])]) == want((None, clean[2]), (4, clean[3]))


def test_toxic_rows_without_an_id_go(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "toxicity", lambda docs, model, id_col="doc_id": docs.select(F.col(id_col).alias("doc_id"), F.col("text").startswith("bad").cast("int").alias("predicted")))
    docs = spark.createDataFrame([(None, "bad a"), (None, "b"), (1, "bad c"), (1, "d")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.not_toxic(spark, docs, DIR).collect()) == ["b", "d"]


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(sets):
    """Index pairs a < b with a Jaccard similarity of 0.8 or more."""
    return {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if x & y and len(x & y) / len(x | y) >= 0.8}


def test_no_two_texts_stay_that_are_alike(spark):
    """Two to six changed words in 120 leave most pairs outside four bits of SimHash; a crowd of copies fills large cells."""
    import random

    rng = random.Random(22)
    rows = []
    for _ in range(40):
        words = _filler(rng, 120).split()
        rows.append(" ".join(words))
        for k in rng.sample(range(120), rng.randint(2, 6)):
            words[k] = "changed"
        rows.append(" ".join(words))
    crowd = _filler(rng, 120).split()
    for k in range(60):
        rows.append(" ".join([*crowd[:k], "other", *crowd[k + 1 :], f"end{k}"]))
    rows += ["one two", "ONE  two", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = [_shingles(t) for t in rows]
    left = [r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, DIR).collect()]
    assert len(_alike(sets)) > 60 and not _alike([sets[i] for i in sorted(left)])
    fps = [corpus_pipeline.simhash.fingerprint((t or "").encode()) for t in rows]
    linked = _alike(sets) | {(a, b) for b in range(len(rows)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 4}
    assert all(any(x == i for _, x in linked) for i in set(range(len(rows))) - set(left))
    found = {tuple(r) for r in corpus_pipeline.similar.like_smaller(docs.where("doc_id < 80"), "doc_id").select("like", "gone").collect()}
    assert found == _alike(sets[:80])


def test_no_two_texts_of_the_near_stage_are_alike(steps):
    assert not _alike([_shingles(r.text) for r in dict(steps)["simhash"].collect()])


def test_empty_tables_and_null_texts(spark):
    schema = "doc_id long, text string, row_key string, `_row_key` int"
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, DIR)
        assert got.count() == 0 and (name == "packing" or got.columns == empty.columns)
    rows = spark.createDataFrame([(1, None, "a", 1), (2, None, "a", 1), (None, "", "b", 2), (3, "x", None, None)], schema)
    assert sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.distinct_texts(spark, rows, DIR).collect()) == [(1, ""), (3, "x")]
    assert corpus_pipeline.without_benchmark(spark, rows, DIR).count() == 4
    assert sorted(r.length for r in corpus_pipeline.packed(spark, rows, DIR).collect()) == [1, 1, 1, 2]


def test_boilerplate_does_not_make_all_pairs(spark, monkeypatch):
    """Texts that share a long passage and are not alike, with groups of near copies among them: none is lost, and far fewer pairs than all are judged."""
    import random

    from revisor.llm import similar

    rng = random.Random(31)
    passage = [f"p{k}" for k in range(150)]
    texts = [" ".join(passage + [f"w{rng.random()}" for _ in range(50)]) for _ in range(260)]
    for k in range(8):  # eight groups of near copies
        base = (passage + [f"g{k}x{j}" for j in range(60)]) if k % 2 else [f"h{k}x{j}" for j in range(200)]
        texts += [" ".join([*base, f"end{n}"]) for n in range(25)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[at]) for i, at in enumerate(order)], "doc_id long, text string")
    written, judged = similar.written, []

    def watched(df, name="table"):
        out = written(df, name)
        if name == "pairs":
            judged.append(out.count())
        return out

    monkeypatch.setattr(similar, "written", watched)
    found = {(r.like, r.gone) for r in similar.like_smaller(docs, "doc_id").collect()}
    sets = [set(zip(*(texts[at].split()[k:] for k in range(5)), strict=False)) for at in order]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    gone = {b for _, b in found}
    assert found <= alike and gone == {b for _, b in alike}
    assert sum(judged) < 0.25 * len(texts) * (len(texts) - 1) / 2


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_rows_by_their_keys(spark, monkeypatch, most):
    """Repeated, negative and very large ids, columns named like the words: the same rows broadcast or shuffled."""
    from revisor.llm import common

    monkeypatch.setattr(common, "MOST_WORDS", most)
    keys = [*range(200), -1, -64, -65, 2**40, 2**40 + 63, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(k, f"t{k}", "w", k) for k in keys], "row_key long, `a.text` string, word string, _bits long")
    ids = [3, 3, 63, 64, 127, 128, 199, -1, -65, 2**40 + 63, 2**63 - 1, -(2**63), 7_000]
    some, none = spark.createDataFrame([(i,) for i in ids], "row long"), spark.createDataFrame([], "row long")
    of = lambda df: sorted(r.row_key for r in df.collect())
    for found in (ids, []):
        table = some if found else none
        assert of(common.among(rows, "row_key", table)) == sorted(set(keys) & set(found))
        assert of(common.among(rows, "row_key", table, inside=False)) == sorted(set(keys) - set(found))
    assert common.among(rows, "row_key", some).columns == rows.columns


def _exchanges(df):
    return re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString())


def test_stages_remove_rows_without_a_shuffle_of_texts(spark, monkeypatch):
    """However many bytes of ids Spark would broadcast of itself: no stage deals its rows out, so bytes shuffled follow the input."""
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "toxicity", lambda docs, model, id_col="doc_id": docs.selectExpr(f"{id_col} AS doc_id", "1 AS predicted"))
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {name: _exchanges(stage(spark, docs, small)) for name, stage in corpus_pipeline.STAGES[:-1]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans == dict.fromkeys(plans, [])


def test_encoders_are_dropped_before_pieces_are_placed():
    import public_tokenizers

    from revisor.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.encoded("one two", packing._encoder(path, False))
    packing._forget()
    assert not packing._ENCODERS
    assert packing.encoded("one two", packing._encoder(path, False)) == ids
