"""A deterministic, sharded WARC writer, and a reader of what it wrote.

Records are range-sorted by page, files roll by compressed size, every header and digest is made
anew, and files are written under temporary names that a manifest, written last into the same folder, commits. Every record is a gzip
member of its own. A payload that was written before is a revisit of the record with the smallest
page id.

Edge cases: a null payload is empty, and empty payloads count as equal; a null url gets an ``urn:page:``
target; null page ids come first and are all after any numbered page as a payload's first; of
rows that repeat a page id and payload, one is the response. An empty table gives no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, commit, open_fs, parts, range_bounds, range_shards, save, scratch

#: Compressed bytes a file holds before the next begins.
ROLL = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha1}')}>"


def record(page, url: str | None, payload: bytes, sha1: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One record: WARC header, HTTP header and, unless it is a revisit, the payload."""
    target = f"urn:page:{page}" if url is None else "".join(c if c.isprintable() else "".join(f"%{x:02X}" for x in c.encode()) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, sha1)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(sha1))}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"] if revisit else []),
        f"X-Page: {'' if page is None else page}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzipped(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(f, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an open file, one after the other."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or f.read(size)
        if not data:
            if out:
                raise OSError("the file ends within a record")
            return
        out.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(out)
            data, z, out = z.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, its length and block digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(fields["Content-Length"])
    block = rest[:n]
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n" or f"sha1:{b32(hashlib.sha1(block).digest())}" != fields["WARC-Block-Digest"]:
        raise ValueError("damaged record")
    return fields, block


def write(df: DataFrame, root: str, ident: str = "page_id", url: str = "url", payload: str = "html", roll: int = ROLL, level: int = 6) -> DataFrame:
    """Write the archives and their manifest below ``root``; the manifest has file, records, bytes, crc32."""
    base = df.select(F.col(ident).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    base = base.withColumn("sha1", F.sha1(F.col("body").cast("binary"))).withColumn("tie", F.xxhash64("sha1"))
    slim = save(base.select("page", "sha1", "tie", (F.octet_length("body") + 400).cast("long").alias("size")), "digests")
    first = slim.groupBy("sha1").agg(F.min("page").alias("ref"))
    # who refers to whom travels in rows of its own, so that the payloads are dealt out once only
    refs = slim.select("page", "sha1", "tie").distinct().join(first, "sha1").select("page", "sha1", "tie", F.lit(0).alias("kind"), "ref", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("body"))
    rows = base.select("page", "sha1", "tie", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ref"), "url", "body").unionByName(refs)
    rows = range_shards(rows, "page", "tie", range_bounds(slim, "page", "tie", "size")).sortWithinPartitions("_at", "tie", "page", "sha1", "kind", "url")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: Rolling | None = None
        said: list[tuple] = []
        ref = told = None
        n = crc = 0

        def close() -> None:
            nonlocal n, crc
            size = files.size
            said.append((files.close(), n, size, crc))
            n = crc = 0

        for b in batches:
            for shard, page, sha1, kind, r, link, body in zip(*(b.column(c) for c in ("shard", "page", "sha1", "kind", "ref", "url", "body")), strict=True):
                shard, page, sha1 = shard.as_py(), page.as_py(), sha1.as_py()
                if files is None or files.part != shard:
                    if files is not None and files.out is not None:
                        close()
                    files = Rolling(root, shard, ".warc.gz")
                if not kind.as_py():
                    ref, told = r.as_py(), False
                    continue
                revisit = told or ref != page
                told = True
                data = gzipped(record(page, link.as_py(), body.as_buffer().to_pybytes(), sha1, ref, revisit), level)
                if files.out is None:
                    files.start()
                files.write(data)
                crc, n = zlib.crc32(data, crc), n + 1
                if files.size >= roll:
                    close()
        if files is not None and files.out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in said], pa.string())} | {c: pa.array([x[k] for x in said], pa.int64()) for k, c in ((1, "records"), (2, "bytes"), (3, "crc32"))})

    return commit(save(rows.mapInArrow(pack, "file string, records long, bytes long, crc32 long"), "warc-manifest"), root)


def read(manifest: DataFrame, root: str) -> DataFrame:
    """Per record, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target, file."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "target": pa.string(), "file": pa.string()}
        for b in batches:
            for name, n in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in members(f):
                        h, block = parse(raw)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if h["WARC-Type"] == "response" and (len(body) != size or f"sha1:{b32(hashlib.sha1(body).digest())}" != h["WARC-Payload-Digest"]):
                            raise ValueError("payload and digest differ")
                        ref = h.get("X-Refers-To-Page")
                        rows.append((int(h["X-Page"]) if h["X-Page"] else None, size, h["WARC-Payload-Digest"][5:], h["WARC-Type"], int(ref) if ref else None, h["WARC-Target-URI"], name))
                if len(rows) != n:
                    raise OSError(f"{name} has {len(rows)} records, the manifest {n}")
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})

    n = max(1, min(4 * parts(manifest.sparkSession), manifest.count()))
    return manifest.select("file", "records").repartition(n).mapInArrow(unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, file string")


def query(spark, sf_dir: str) -> DataFrame:
    root = scratch(spark, "warc")
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root), root).drop("target", "file")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: DuckDB has no base 32: each group of ten hex digits of the digest is eight letters.
SQL = f"""
WITH s AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY d) AS f FROM s)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('{_B32}',
    1 + ((('0x' || substr(d, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM m"""
