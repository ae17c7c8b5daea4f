"""Queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("row")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, toxicity

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    marks = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{marks}'), (-1L, 1L, 'assistant', '{marks}') AS t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.format_turns(rows.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = made.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.concat("base", "added")).alias("spans"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding
    from .common import new_path

    docs = _table(spark, sf_dir, "documents")
    shuffled, path = sharding.shuffle_into_shards(docs, "doc_id", "text", shards=16), new_path(spark, "shards")
    sharding.write_shards(shuffled, path)
    text, key = F.col("record.text"), F.col("record.doc_id")
    return sharding.read_shards(spark, path, shuffled.schema).select(
        key.alias("doc_id"),
        sharding.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(key, 17, 7).alias("grown_shard"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    docs = _table(spark, sf_dir, "documents")
    return quality(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    at = lambda text: merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = _table(spark, sf_dir, "documents").select(
        "source",
        "doc_id",
        at(F.col("text")).alias("leaf"),
        F.when(tampered & F.contains("text", F.lit("\n")), at(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"),
    )
    proofs = merkle.prove(merkle.build(rows, "source", "doc_id", "leaf"))
    folded = merkle.fold(F.coalesce("tampered", "digest"), F.col("proof"))
    named = proofs.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = _table(spark, sf_dir, "documents")
    return mix(docs, F.col("doc_id"), F.col("text"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import codes

    coded, books = codes.encode(_table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def queries() -> dict:
    found = (op1_chat, op2_decontamination, op3_simhash, op4_pii, op5_sharding, op6_packing, op7_warc, op8_quality, op9_exact_dedup, op10_toxicity, op11_merkle, op12_mixing, op13_codes)
    return {f.__name__: f for f in found}


#: Deletes what the comparison of texts ignores.
_BARE = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

_ESCAPED = "replace(coalesce({}, ''), '\\', '\\\\')"
for _c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


#: CRC-32 of an id's digits, byte by byte and bit by bit.
_BITS = "list_reduce(list_prepend(xor(r, b), [0::UBIGINT FOR i IN range(8)]), lambda v, i: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))"
_BYTES = "[CAST(ascii(c) AS UBIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {_BYTES}), lambda r, b: {_BITS}), 4294967295::UBIGINT)"


def _merkle_sql() -> str:
    """Levels by recursion, siblings by windows over runs of three, proofs as lists that are folded."""
    leaf = lambda text: "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    level = "sha256(string_agg(h, '' ORDER BY place))"
    beside = "coalesce(string_agg(h, '') OVER (PARTITION BY {0}level, place // 3 ORDER BY place ROWS BETWEEN {1}), '')"
    before, after = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
    return f"""
        WITH RECURSIVE l AS (
            SELECT doc_id, source, leaf, tampered, row_number() OVER () AS id,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
            FROM (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN crc32_of % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered
                  FROM (SELECT *, {_CRC32} AS crc32_of FROM documents))),
        up AS (SELECT source, 0 AS level, place, n, leaf AS h FROM l
               UNION ALL SELECT source, level + 1, place // 3, (any_value(n) + 2) // 3, {level} FROM up WHERE n > 1 GROUP BY source, level, place // 3),
        subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
        top AS (SELECT 0 AS level, place, n, h FROM subroots
                UNION ALL SELECT level + 1, place // 3, (any_value(n) + 2) // 3, {level} FROM top WHERE n > 1 GROUP BY level, place // 3),
        steps AS (SELECT source, level, place, {beside.format("source, ", before)} AS lo, {beside.format("source, ", after)} AS hi FROM up WHERE n > 1),
        top_steps AS (SELECT level, place, {beside.format("", before)} AS lo, {beside.format("", after)} AS hi FROM top WHERE n > 1),
        paths AS (SELECT id, 0 AS part, s.level, lo, hi FROM l JOIN steps s ON l.source IS NOT DISTINCT FROM s.source AND s.place = l.place // CAST(pow(3, s.level) AS BIGINT)
                  UNION ALL SELECT id, 1, s.level, lo, hi FROM l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN top_steps s ON s.place = r.place // CAST(pow(3, s.level) AS BIGINT)),
        proofs AS (SELECT l.id, list({{'lo': lo, 'hi': hi}} ORDER BY part, level) FILTER (lo IS NOT NULL) AS proof FROM l LEFT JOIN paths ON l.id = paths.id GROUP BY 1),
        found AS (SELECT doc_id, leaf, r.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string([s.lo || s.hi FOR s IN proof], ''), '')) AS proof_sha256,
                         list_reduce(list_prepend({{'lo': coalesce(tampered, leaf), 'hi': ''}}, coalesce(proof, [])), lambda a, s: {{'lo': sha256(s.lo || a.lo || s.hi), 'hi': ''}}).lo AS folded_root
                  FROM l JOIN proofs USING (id) JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source)
        SELECT *, folded_root = root AS verified FROM found"""


#: A mix where every document has one source: targets by a running rest, extra words by a running sum over the seeded order.
_MIX_SQL = """
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(concat_ws(chr(31), 'mix-1', CAST(doc_id AS VARCHAR))) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 3 * source_size AS bound FROM s),
    r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, place)),
    c AS (SELECT *, bound::DOUBLE * others::DOUBLE <= weight::DOUBLE * rest::DOUBLE AS stops FROM r),
    t AS (SELECT source, source_size, CASE WHEN stops THEN bound::DOUBLE ELSE (weight * (sum(source_size) OVER () - coalesce(sum(bound) FILTER (stops) OVER (), 0)))::DOUBLE / (sum(weight) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM c),
    o AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE size * (quota // source_size) + least(greatest(quota % source_size - before, 0), size) END AS taken FROM o"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A round is two tables: each part's nearest entry, and the entries' new components."""
    square = "list_sum([(p.c[i] - b.c[i]) * (p.c[i] - b.c[i]) FOR i IN range(1, len(p.c) + 1)])"
    near = lambda book: f"SELECT p.rid, p.part, p.c, min({{'d': {square}, 'entry': b.entry}}) AS m FROM p JOIN {book} b USING (part) GROUP BY ALL"
    steps = [f"""
        kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, [CAST(floor({scale} * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
                              FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS c FROM kept, range({parts}) t(part)),
        b0 AS MATERIALIZED (SELECT part, rid AS entry, c FROM p WHERE rid < {entries})"""]
    for r in range(rounds):
        steps.append(f"""
        a{r} AS MATERIALIZED ({near(f"b{r}")}),
        s{r} AS (SELECT part, m.entry AS entry, i, CAST(sum(c[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(v)) FROM kept) // {parts} + 1) t(i) GROUP BY ALL),
        f{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY ALL),
        b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(f.c, b.c) AS c FROM b{r} b LEFT JOIN f{r} f USING (part, entry))""")
    last = f"""
        z AS (SELECT rid, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM ({near(f"b{rounds}")}) GROUP BY rid),
        book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS digest FROM b{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM kept JOIN z USING (rid), book"""
    return "WITH " + ",".join(steps) + "," + last


def oracle_sql() -> dict[str, str]:
    return {
        "op11_merkle": _merkle_sql(),
        "op12_mixing": _MIX_SQL,
        "op13_codes": _codes_sql(),
        "op1_chat": f"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(23 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
            FROM c GROUP BY conv_id""",
        "op7_warc": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
                 f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first_id THEN first_id END AS refers_to
            FROM f""",
        "op9_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({_BARE}) AS text_sha256, length(coalesce(text, '')) AS n FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   doc_id = first_value(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    }
