"""WARC archives with a two-level capture index.

Pages become gzip members of WARC files, one record a member. The capture index is sorted by the reversed-host form of
the URL ("http://www.example.com/a" -> "com,example,www)/a") and the page id; its lines lie in compressed blocks, and a
sparse directory keeps the first key of each block. A look-up bisects the list of parts, then the part's directory,
reads and inflates one block, bisects its lines, and reads just the record's byte range.

Pages are dealt by ranges of the index key, so each task writes one archive and its stretch of the index in key order;
a host with a third of the rows spreads over many ranges, because the whole URL and the id belong to the key.

Defined cases: a null html is an empty payload; a null url has the empty key; rows that repeat a (page_id, html) pair
are each "response" when their id is the largest with that payload; a null page_id is smaller than any id, and where
all ids of a payload are null its rows are all responses. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import shared

CRLF = b"\r\n"
#: Index lines in a compressed block.
BLOCK_LINES = 256
#: An archive file is closed once it has this many bytes.
ROLL_BYTES = 1 << 30
#: The table of repeated payloads is broadcast up to this many rows (about 60 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000

PARTS = "part string, first_key binary, first_id long, first_null boolean, records long, archive_bytes long"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url) -> F.Column:
    """The reversed-host key of a URL column; the empty string for null."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(rest == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path))


def _order(key: bytes, page_id: int | None) -> tuple:
    return key, page_id is not None, page_id or 0


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record. A revisit has no payload, but names the length and digest of what it stands for."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of an uncompressed record."""
    head, _, rest = data.partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    return fields, http, payload


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _writer(root: str, date: str, block_lines: int, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes this task's archives, index blocks and directory under names of its own; a lost attempt's files are never named."""
        fs, top = _opened(root)
        part, archive, serial, at, total, records = uuid.uuid4().hex, None, -1, 0, 0, 0
        index = None
        lines: list[bytes] = []
        directory: list[tuple] = []
        first = block_first = None

        def close_block() -> None:
            nonlocal lines, block_first
            data = zlib.compress(b"\n".join(lines), 6)
            directory.append((*block_first, index.tell(), len(data)))
            index.write(data)
            lines, block_first = [], None

        for page_id, url, key, html, sha1, keeper in shared.rows_of(batches):
            if index is None:
                fs.create_dir(top, recursive=True)
                index = fs.open_output_stream(f"{top}/{part}.idx", compression=None)
            if archive is None or at >= roll_bytes:
                if archive is not None:
                    archive.close()
                serial, at = serial + 1, 0
                archive = fs.open_output_stream(f"{top}/{part}-{serial}.warc.gz", compression=None)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            member = gzip.compress(_record(page_id, url, html.encode(), digest, None if keeper is None or keeper == page_id else keeper, date), 4, mtime=0)
            archive.write(member)
            name = key.encode()
            block_first = block_first or (base64.b64encode(name).decode(), page_id)
            first = first or (name, page_id)
            lines.append(json.dumps([base64.b64encode(name).decode(), page_id, serial, at, len(member)]).encode())
            at, total, records = at + len(member), total + len(member), records + 1
            if len(lines) >= block_lines:
                close_block()
        if index is None:
            return
        if lines:
            close_block()
        index.close()
        archive.close()
        with fs.open_output_stream(f"{top}/{part}.dir", compression=None) as out:
            out.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({"part": [part], "first_key": [first[0]], "first_id": pa.array([first[1]], pa.int64()), "first_null": [first[1] is None], "records": [records], "archive_bytes": [total]})

    return write


def write_archive(pages: DataFrame, root: str, *, min_payload: int = 0, date: str = "1970-01-01T00:00:00Z", block_lines: int = BLOCK_LINES, roll_bytes: int = ROLL_BYTES) -> str:
    """Write a record per row of ``pages`` (page_id, url, html) below ``root``; returns the manifest's path.

    Of rows with equal payloads of ``min_payload`` bytes or more, that with the largest page_id becomes the response
    and the others revisit it. The manifest has a line per part, so it grows with tasks, not with pages.
    """
    spark = pages.sparkSession
    shared.prepare(spark)
    rows = pages.select("page_id", "url", surt(F.col("url")).alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    same = (
        rows.where(F.octet_length("html") >= min_payload).select("page_id", digest.alias("sha1"))
        .groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("sha1", "keeper")
    )
    same = shared.materialize(same, "payloads")
    same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
    dealt = (
        rows.withColumn("sha1", digest).join(same, "sha1", "left")
        .select("page_id", "url", "key", "html", "sha1", "keeper")
        .repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    )
    parts = dealt.mapInArrow(_writer(root, date, block_lines, roll_bytes), PARTS).collect()
    ordered = sorted(parts, key=lambda p: (bytes(p.first_key), not p.first_null, p.first_id or 0))
    fs, top = _opened(root)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/manifest.json", compression=None) as out:
        out.write(json.dumps([[base64.b64encode(bytes(p.first_key)).decode(), p.first_id, p.part, p.records] for p in ordered]).encode())
    return f"{root}/manifest.json"


class CaptureIndex:
    """Look-ups in the archives below ``root``. Keeps one directory, one block and one archive open at a time."""

    def __init__(self, root: str):
        self.fs, self.top = _opened(root)
        with self.fs.open_input_file(f"{self.top}/manifest.json") as f:
            self.parts = json.loads(f.read())
        self.firsts = [_order(base64.b64decode(k), i) for k, i, *_ in self.parts]
        self.part = self.block_at = self.archive_at = None
        self.blocks_read = 0

    def _directory(self, part: str) -> None:
        if self.part != part:
            with self.fs.open_input_file(f"{self.top}/{part}.dir") as f:
                self.directory = json.loads(f.read())
            self.block_firsts = [_order(base64.b64decode(k), i) for k, i, *_ in self.directory]
            self.index = self.fs.open_input_file(f"{self.top}/{part}.idx")
            self.part, self.block_at = part, None

    def _block(self, part: str, n: int) -> list[tuple]:
        self._directory(part)
        if self.block_at != n:
            _, _, offset, length = self.directory[n]
            lines = [json.loads(x) for x in zlib.decompress(self.index.read_at(length, offset)).split(b"\n")]
            self.block = [(_order(base64.b64decode(k), i), serial, at, size) for k, i, serial, at, size in lines]
            self.block_keys = [x[0] for x in self.block]
            self.block_at = n
            self.blocks_read += 1
        return self.block

    def captures(self, key: bytes, page_id: int | None) -> Iterator[bytes]:
        """The records filed under a key and id, in index order."""
        want = _order(key, page_id)
        p = max(0, bisect.bisect_right(self.firsts, want) - 1)
        if not self.parts:
            return
        part = self.parts[p][2]
        self._directory(part)
        n = max(0, bisect.bisect_left(self.block_firsts, want) - 1)  # equal lines may begin in the block before
        while n < len(self.directory) and self.block_firsts[n] <= want:
            block = self._block(part, n)
            lo, hi = bisect.bisect_left(self.block_keys, want), bisect.bisect_right(self.block_keys, want)
            for _, serial, at, size in block[lo:hi]:
                if self.archive_at != (part, serial):
                    self.archive, self.archive_at = self.fs.open_input_file(f"{self.top}/{part}-{serial}.warc.gz"), (part, serial)
                yield gzip.decompress(self.archive.read_at(size, at))
            n += 1


def _id(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


def _finder(root: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        out, index, last, captures = shared.Emitter(names), None, None, iter(())
        for key, page_id in shared.rows_of(batches):
            index = index or CaptureIndex(root)
            if last != (key, page_id):
                last, captures = (key, page_id), index.captures(key.encode(), page_id)
            fields, http, payload = parse_record(next(captures))  # the n-th equal query takes the n-th equal record
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of page {page_id} doesn't have its digest")
            length = int(http.rpartition(b"Content-Length: ")[2])
            if out.add((_id(fields["WARC-Record-ID"]), length, digest, kind, _id(fields.get("WARC-Refers-To")))):
                yield out.flush()
        yield out.flush()

    return find


def read_archive(queries: DataFrame, root: str) -> DataFrame:
    """Find the record of each row of ``queries`` (page_id, url) through the index. Sorted queries read each block once."""
    wanted = queries.select(surt(F.col("url")).alias("key"), "page_id").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return wanted.mapInArrow(_finder(root), FOUND)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = shared.table(spark, sf_dir, "pages")
    root = shared.new_folder(spark, "warc")
    write_archive(pages, root, min_payload=0)
    return read_archive(pages, root)


QUERIES = {"op1_warc_index": op1_warc_index}

ORACLE_SQL = {
    "op1_warc_index": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, '')) AS n FROM pages
), k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(p.hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN p.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM p JOIN k ON p.html = k.html
"""
}
