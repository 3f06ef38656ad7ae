"""Web archives: WARC files with one compressed member a record, and a two-level capture index over them.

Writing: a page's payload is its html in UTF-8. Of records with equal payloads of ``least`` bytes or more, that with the smallest page_id is
the response and others are revisits, which carry its headers and digest but no payload. Tasks write archives of bounded size.

Index: keys are URLs with the host reversed, so that a site's pages lie together. Entries are range-partitioned and sorted; each
partition becomes one index file of compressed blocks and, at its end, a sparse directory of the blocks' first keys. The table of index
files has the first key of each. A lookup binary-searches that table, then a directory, then one block, and range-reads the record.

Many keys at once (``locate``) are resolved the same way: each key is searched in the table of index files, which has a row a file and so
is bounded by the number of partitions; keys are dealt out by file, sorted, and searched in its directory and blocks, each read once. A key
that a third of all pages have lies in many files, and no task gets more than a file's part of it. Entries found are dealt out by archive
and sorted by offset, and neighbours are fetched in one range read. Reading all records back resolves every page's key.

Files go through ``pyarrow.fs``, so that the folder can be local, shared or in an object store. Each task attempt writes files of its
own name and their entries are kept in a written table: attempts that are lost or repeated leave files that nothing refers to.

Which records are revisits is decided by digest: digests of more than one in ``HOT`` pages are broadcast, others meet by a shuffle, in which
pages below ``least`` bytes and those of hot digests are spread.

Defined results: null html is an empty payload; rows that repeat the smallest page_id of a payload are all responses; a null page_id is never
the smallest unless all are null; a page without a URL has the key "-"; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, bounded_batches, columns, fresh_dir, written

LEAST_BYTES = 100
ARCHIVE_BYTES, BLOCK_ENTRIES, READ_BYTES = 64 << 20, 1000, 4 << 20
_GZIP = 31
ENTRY = "key string, page_id long, archive string, offset long, length long, kind string"


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query; the fragment and the scheme are dropped."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url, safe="/:?&=%+,;@~*'()!$")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest, safe="/:?&=%+,;@~*'()!$#[]")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One compressed record; first: the response's page_id for a revisit, else None."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = quote(url, safe="/:?&=%+,;@~*'()!$#[]") if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's headers, the HTTP headers and the payload of a compressed record."""
    data = zlib.decompress(member, _GZIP)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode().split("\r\n")[1:])
    own = fields(head)
    http, _, payload = rest[: int(own["Content-Length"])].partition(b"\r\n\r\n")
    return own, fields(http), payload


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _attempt() -> str:
    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, first (the response's page_id, null for a response)."""
    rows = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= least
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts, "responses")
    hot = F.col("n") * HOT > (firsts.agg(F.sum("n")).first()[0] or 0)
    often = F.broadcast(firsts.where(hot).select("digest", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url"))  # meets nothing
    marked = rows.join(often, "digest", "left").withColumn("meets", F.when(large & F.col("hot").isNull(), F.col("digest")).otherwise(alone))
    both = marked.join(firsts.where(~hot).select(F.col("digest").alias("meets"), "first"), "meets", "left")
    first = F.when(large, F.coalesce("hot_first", "first"))
    return both.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(first), first).alias("first"))


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages; the table of entries, not sorted."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _fs(folder)
        out, size, n, name = None, 0, 0, ""
        for batch in batches:
            rows = []
            for page, url, html, digest, first in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                member = record(page, url, html.encode(), digest, first, date)
                if out is None or size + len(member) > archive_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(path, recursive=True)
                    name, size, n = f"{_attempt()}-{n:04d}.warc.gz", 0, n + 1
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                rows.append((url_key(url), page, name, size, len(member), "response" if first is None else "revisit"))
                size += len(member)
            got = pd.DataFrame(rows, columns=["key", "page_id", "archive", "offset", "length", "kind"])
            yield got.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    # The generator's last close must come before the table is committed, which it does: a task ends after its iterator.
    return written(decided(columns(pages, page_id=id_col, url=url_col, html=html_col), least).mapInPandas(run, ENTRY), "entries")


def build_index(entries: DataFrame, folder: str, *, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Writes the index files; the table of them: first (key), file, entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _fs(folder)
        out, name, at, lines, blocks = None, f"{_attempt()}.cdx", 0, [], []

        def flush() -> None:
            nonlocal at
            block = zlib.compress("\n".join(x for _, x in lines).encode())
            out.write(block)
            blocks.append((lines[0][0], at, len(block), len(lines)))
            at += len(block)
            lines.clear()

        for batch in batches:
            if out is None and len(batch):
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            for key, page, archive, offset, length, kind in batch.itertuples(index=False):
                lines.append((key, f"{key} {json.dumps([None if pd.isna(page) else int(page), archive, offset, length, kind])}"))
                if len(lines) == block_entries:
                    flush()
        if out is not None:
            if lines:
                flush()
            directory = zlib.compress(json.dumps(blocks).encode())
            out.write(directory + len(directory).to_bytes(8, "little"))
            out.close()
            yield pd.DataFrame([(blocks[0][0], name, sum(b[3] for b in blocks))], columns=["first", "file", "entries"])

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    return written(ordered.mapInPandas(run, "first string, file string, entries long"), "index")


def _directory(f) -> list[tuple[str, int, int, int]]:
    size = f.size()
    f.seek(size - 8)
    n = int.from_bytes(f.read(8), "little")
    f.seek(size - 8 - n)
    return [tuple(x) for x in json.loads(zlib.decompress(f.read(n)))]


def _block(f, at: int, n: int) -> tuple[list[str], list[str]]:
    """Keys of a block, and what follows them."""
    f.seek(at)
    lines = [line.split(" ", 1) for line in zlib.decompress(f.read(n)).decode().split("\n")]
    return [x[0] for x in lines], [x[1] for x in lines]


def _may_hold(firsts: list[str], key: str) -> range:
    """Places of the sorted ranges, told by their first keys, that may hold a key."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


class IndexFile:
    """One open index file: its directory, and the block read last."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.blocks = _directory(self.file)
        self.firsts = [b[0] for b in self.blocks]
        self.at, self.held, self.reads = -1, ([], []), 0

    def entries(self, key: str) -> Iterator[list]:
        """[page_id, archive, offset, length, kind] of each entry of the key: a binary search in the directory, then in the block."""
        for k in _may_hold(self.firsts, key):
            if k != self.at:
                _, at, n, _ = self.blocks[k]
                self.at, self.held, self.reads = k, _block(self.file, at, n), self.reads + 1
            keys, rest = self.held
            for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                yield json.loads(rest[i])


def lookup(index: DataFrame, index_folder: str, archive_folder: str, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """All records of a URL: binary searches, then one range read a record. The table of index files has a row a file."""
    key, found = url_key(url), []
    files = sorted((r["first"], r["file"]) for r in index.where(F.col("first") <= key).select("first", "file").collect())
    store, path = _fs(index_folder)
    archives, archive_path = _fs(archive_folder)
    for k in _may_hold([x[0] for x in files], key):
        for _, archive, offset, length, _ in IndexFile(store, f"{path}/{files[k][1]}").entries(key):
            with archives.open_input_file(f"{archive_path}/{archive}") as a:
                a.seek(offset)
                found.append(parsed(a.read(length)))
    return found


def keys(pages: DataFrame, *, url_col: str = "url") -> DataFrame:
    """key of every page's URL, each once."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return pd.Series([url_key(u) for u in urls], dtype=object)

    return columns(pages, url=url_col).select(run("url").alias("key")).distinct()


def locate(wanted: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """All entries of the keys in wanted (key, each once)."""
    spark = wanted.sparkSession
    files = sorted((r["first"], r["file"]) for r in index.select("first", "file").collect())  # a row a partition of the index
    shared = spark.sparkContext.broadcast(([x[0] for x in files], [x[1] for x in files]))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, names = shared.value
        for batch in batches:
            yield pd.DataFrame([(names[k], key) for key in batch["key"] for k in _may_hold(firsts, key)], columns=["file", "key"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _fs(folder)
        name, held, rows = None, None, []

        def out() -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=["key", "page_id", "archive", "offset", "length", "kind"]).astype({"page_id": "Int64"})
            rows.clear()
            return got

        for batch in batches:
            for file, key in zip(batch["file"], batch["key"], strict=True):
                if file != name:
                    name, held = file, IndexFile(store, f"{path}/{file}")
                for entry in held.entries(key):
                    rows.append((key, *entry))
                    if len(rows) == 10_000:
                        yield out()
        if rows:
            yield out()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_file = wanted.mapInPandas(dealt, "file string, key string").repartition(parts, "file").sortWithinPartitions("file", "key")
    return by_file.mapInPandas(search, ENTRY)


def read_index(index: DataFrame, folder: str) -> DataFrame:
    """All entries, decoded from the blocks of all index files in parallel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _fs(folder)
        for batch in batches:
            for name in batch["file"]:
                with store.open_input_file(f"{path}/{name}") as f:
                    for _, at, n, _ in _directory(f):
                        rows = [(key, *json.loads(x)) for key, x in zip(*_block(f, at, n), strict=True)]
                        yield pd.DataFrame(rows, columns=["key", "page_id", "archive", "offset", "length", "kind"]).astype({"page_id": "Int64"})

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("file").repartition(parts, "file").mapInPandas(run, ENTRY)


def fetch(entries: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for a revisit) of each entry."""
    spark = entries.sparkSession
    bounded_batches(spark)

    def portions(batch: pd.DataFrame) -> Iterator[list[tuple[str, int, int]]]:
        part: list[tuple[str, int, int]] = []
        for archive, offset, length in zip(batch["archive"], batch["offset"], batch["length"], strict=True):
            if part and (part[-1][0] != archive or part[-1][1] + part[-1][2] != offset or offset + length - part[0][1] > READ_BYTES):
                yield part
                part = []
            part.append((archive, int(offset), int(length)))
        if part:
            yield part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _fs(folder)
        for batch in batches:
            rows = []
            for part in portions(batch):
                with store.open_input_file(f"{path}/{part[0][0]}") as f:
                    f.seek(part[0][1])
                    data = f.read(part[-1][1] + part[-1][2] - part[0][1])
                for _, offset, length in part:
                    own, http, payload = parsed(data[offset - part[0][1] : offset - part[0][1] + length])
                    digest = own["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind, size = own["WARC-Type"], int(http["Content-Length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{part[0][0]} at {offset}: the payload is not what was written")
                    page, first = own["X-Page-ID"], own.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, size, digest, kind, int(first) if first else None, *([payload if kind == "response" else None] if with_payload else [])))
            out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    more = ", payload binary" if with_payload else ""
    return ordered.mapInPandas(run, f"page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long{more}")


def digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The query's rows: writes archives and index, and reads every record back through the index."""
    folder = fresh_dir(spark, "warc")
    entries = write_archives(pages, f"{folder}/archives")
    index = build_index(entries, f"{folder}/index")
    return fetch(locate(keys(pages), index, f"{folder}/index"), f"{folder}/archives")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
