"""WARC archives with a two-level capture index.

Write: each task writes its records, one gzip member each, into archives in the
shared folder and returns where each record lies.  Index: captures are sorted by
reversed-host URL key over range partitions; each partition's lines go into
compressed blocks of an index file, and the directory keeps one row for each block.
Look-up: keys find their index files in the files' bounds (one row for each file, of
which there are as many as partitions), then their blocks by binary search in the
file's directory, then their lines in the block, and the records are read by range.

Archives are written through pyarrow's file systems, so the folder may be a local
path or any store that those open.  Files have new names on each attempt; the index
names only those of the attempts that counted.

Cases: null html is an empty payload; a null url has the key "-"; pages with the same
url, and repeated rows, are captures of their own; among equal payloads a repeated
smallest page_id is a response each time; a null page_id revisits if another row of
its payload has an id, else it is a response; an empty table writes nothing.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, tasks, written

#: Payloads from this size on are stored once (fixed by the contract).
REVISIT_BYTES = 100
#: Capture lines in a compressed block of the index.
BLOCK_LINES = 500
#: Bytes of an archive, after which a task starts another.
ARCHIVE_BYTES = 256 << 20
#: The date of all records: the tables have none.
DATE = "2024-01-01T00:00:00Z"

CAPTURES = "key string, page_id long, archive string, position long, size long"
DIRECTORY = "file string, first_key string, last_key string, position long, size long, lines long"
RECORDS = "key string, page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def url_key(url: str | None) -> str:
    """Host reversed by label, then port, path and query: captures of a host stand together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    labels = host.removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _uri(url: str | None) -> str:
    return (url or "").encode("unicode_escape").decode()


def info_bytes(name: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    block = b"software: revisor\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, refers_url=None) -> bytes:
    """One WARC/1.1 record; a revisit holds headers only, and names what it repeats by URI and date, as its profile asks."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {_uri(refers_url)}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> tuple:
    """(page_id, record_type, refers_to, payload or None, payload_bytes, payload_digest); digests of payloads that are there are taken anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    page_id = int(named["X-Page-ID"]) if named["X-Page-ID"] else None
    if named["WARC-Type"] == "revisit":
        return page_id, "revisit", int(named["X-Refers-To-Page-ID"]), None, int(named["X-Payload-Length"]), named["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = block.partition(b"\r\n\r\n")[2]
    return page_id, "response", None, payload, len(payload), hashlib.sha256(payload).hexdigest()


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("position", pa.int64()), ("size", pa.int64())])
_DIRECTORY = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("lines", pa.int64())])
_RECORDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to, refers_url: what each record will say.

    First ids are pre-aggregated by digest; the join on the digest may be split by
    AQE where one payload is frequent.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest")
    first = first.agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first.page_id", "first.url").toDF("digest", "first_id", "first_url")
    again = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``with_revisits`` and return their captures, as a written table."""
    small_batches(rows.sparkSession)

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, payload, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = gzip.compress(info_bytes(name), 1, mtime=0)
                    out.write(info)
                    at = len(info)
                member = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to, refers_url), 1, mtime=0)
                out.write(member)
                found.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            yield _columns(found, _CAPTURES)
        if out is not None:
            out.close()

    _make(folder)
    return written(rows.mapInArrow(write, CAPTURES), "captures")


def _make(folder: str) -> None:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures into compressed blocks and return the sparse directory, as a written table."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        held: list[tuple] = []
        name, out, at = f"{uuid.uuid4().hex}.cdx.gz", None, 0

        def block(lines):
            nonlocal out, at
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            text = "\n".join("\t".join((x[0].encode("unicode_escape").decode(), "" if x[1] is None else str(x[1]), x[2], str(x[3]), str(x[4]))) for x in lines)
            raw = gzip.compress(text.encode(), 6, mtime=0)
            out.write(raw)
            row = (name, lines[0][0], lines[-1][0], at, len(raw), len(lines))
            at += len(raw)
            return row

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ready = []
            while len(held) >= block_lines:
                ready.append(block(held[:block_lines]))
                held = held[block_lines:]
            yield _columns(ready, _DIRECTORY)
        if held:
            yield _columns([block(held)], _DIRECTORY)
        if out is not None:
            out.close()

    _make(folder)
    ordered = captures.repartitionByRange(tasks(captures.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.mapInArrow(write, DIRECTORY), "directory")


def _block_lines(store, root: str, file: str, position: int, size: int) -> list[list[str]]:
    with store.open_input_file(f"{root}/{file}") as f:
        raw = f.read_at(size, position)
    out = [line.split("\t") for line in gzip.decompress(raw).decode().split("\n")]
    for line in out:
        line[0] = line[0].encode().decode("unicode_escape")
    return out


def look_up(keys: DataFrame, directory: DataFrame, index_folder: str, archive_folder: str) -> DataFrame:
    """Records of the captures of ``keys`` (column key), found through both levels of the index."""
    spark = keys.sparkSession
    small_batches(spark)
    files = directory.groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("low", "high")
    bounds = spark.sparkContext.broadcast([tuple(r) for r in files.collect()])  # a row for each index file: as many as partitions

    def choose_files(batches):
        rows = bounds.value
        low, high = [r[1] for r in rows], [r[2] for r in rows]
        for batch in batches:
            out = [(k, rows[i][0]) for k in batch.column(0).to_pylist() for i in range(bisect.bisect_left(high, k), bisect.bisect_right(low, k))]
            yield _columns(out, pa.schema([("key", pa.string()), ("file", pa.string())]))

    wanted = keys.select("key").distinct().mapInArrow(choose_files, "key string, file string")
    block_schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.string()))])

    def choose_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = sorted(zip(*(right.column(c).to_pylist() for c in ("first_key", "last_key", "file", "position", "size")), strict=True))
        first, last = [b[0] for b in blocks], [b[1] for b in blocks]
        found: dict[int, list[str]] = {}
        for key in left.column("key").to_pylist():
            for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                found.setdefault(i, []).append(key)
        return pa.Table.from_batches([_columns([(*blocks[i][2:], sorted(k)) for i, k in sorted(found.items())], block_schema)])

    blocks = wanted.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(choose_blocks, "file string, position long, size long, keys array<string>")

    def read(batches):
        store, index_root = fs.FileSystem.from_uri(index_folder)
        _, archive_root = fs.FileSystem.from_uri(archive_folder)
        for batch in batches:
            for file, position, size, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = _block_lines(store, index_root, file, position, size)
                names = [line[0] for line in lines]
                hits = [line for k in asked for line in lines[bisect.bisect_left(names, k) : bisect.bisect_right(names, k)]]
                hits.sort(key=lambda line: (line[2], int(line[3])))
                opened, archive = "", None
                for at in range(0, len(hits), 100):
                    out = []
                    for key, _, name, start, length in hits[at : at + 100]:
                        if name != opened:
                            if archive is not None:
                                archive.close()
                            opened, archive = name, store.open_input_file(f"{archive_root}/{name}")
                        out.append((key, *parsed_record(gzip.decompress(archive.read_at(int(length), int(start))))))
                    yield _columns(out, _RECORDS)
                if archive is not None:
                    archive.close()

    return blocks.repartition(4 * tasks(spark)).mapInArrow(read, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, index them, and read every page back through the index."""
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    captures = write_archives(with_revisits(pages), archives)
    directory = write_index(captures, index)
    return look_up(captures.select("key"), directory, index, archives)
