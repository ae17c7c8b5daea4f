"""The queries over their whole small tables: against their SQL, or against plain versions of all their columns."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_text_operators import _plain_components, _plain_fingerprint, _plain_spans, _plain_tiling
from tests.test_oracle import TABLES, _rows

queries = pytest.importorskip("revisor.llm.queries")

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, found = queries.queries()[name](spark, DIR), con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, found.fetchall())


def test_op2(spark, docs):
    items = [(r.item_id, re.findall(r"\w+", (r.text or "").lower())) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = []
    for i, text in docs:
        words = re.findall(r"\w+", text.lower())
        at = {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
        for item_id, item in items:
            seeds = [" ".join(item[k : k + 5]) for k in range(len(item) - 4)]
            if any(s in at for s in seeds):  # without a shared seed no tile
                tiles = _plain_tiling(item, words, 5)
                share = sum(t[2] for t in tiles) / len(item)
                if share >= 0.8:
                    want.append((i, item_id, share, len(tiles)))
    got = [tuple(r) for r in queries.op2_decontamination(spark, DIR).select("doc_id", "item_id", "coverage", "tiles").collect()]
    assert want and sorted(got) == sorted(want)


def test_op3(spark, docs):
    rows = [(i, _plain_fingerprint(t)) for i, t in docs]
    want = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, _plain_components(rows), strict=True))
    assert sorted(tuple(r) for r in queries.op3_simhash(spark, DIR).select("doc_id", "fingerprint", "component_id").collect()) == want


def test_op4(spark, docs):
    got = {r.doc_id: r for r in queries.op4_pii(spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        base = _plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        listed = base.split(",") if base else []
        for kind in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{kind}"] == sum(s.startswith(f"{kind}:") for s in listed)
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if not s.startswith("secret:")] == listed
        for s in spans[len(listed) :]:
            _, a, b = s.split(":")
            assert re.fullmatch(r"[A-Za-z0-9_]{12,}", text[int(a) : int(b)])


def test_op5(spark, docs):
    got = queries.op5_sharding(spark, DIR).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries._tokenizer())
    got = queries.op6_packing(spark, DIR).toPandas()
    for i, text in docs:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own["length"]).tolist()[:-1]] and own["length"].sum() == len(ids)
        assert set(own.doc_tokens) == {len(ids)}
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s["length"]).tolist()[:-1]] and s["length"].sum() <= 2048
    assert got["length"].sum() / (2048 * got.sequence_id.nunique()) > 0.95


def test_op8(spark, docs):
    got = queries.op8_quality(spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    assert all(0 <= r.quality <= 1 and r.keep == (r.quality >= 0.5) for r in got)


def test_op10(spark, docs):
    got = queries.op10_toxicity(spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
