"""WARC archives with a two-level capture index.

Records are dealt to ranges of their reversed-host url key and sorted, so each task writes
one archive whose records are in key order, and one index file beside it: blocks of
compressed index lines (key, page, place in the archive), and after them a sparse directory
with the first entry of every block.  The manifest, one row per archive, is the table
Spark commits; files of a task attempt that did not commit are not in it.

A lookup sorts its queries the same way.  Each task finds the archive of a query by binary
search in the manifest, the block by binary search in the archive's directory, the lines in
the block, and then reads just the bytes of the record.  As queries come in key order, a
directory, a block and an open archive serve many of them.

Files are written and read through the file system that the folder's address names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, scratch_dir, small, written

# Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
# Index lines in a block.
BLOCK_LINES = 128
_NO_PAGE = -(2**63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = (
    "first_key string, first_page long, last_key string, last_page long, archive string, "
    "index string, directory long, records long"
)


def url_key(url: Column) -> Column:
    """Host with its labels reversed, then what follows it: pages of a domain sort together."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(url)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    after = F.regexp_extract(rest, r"^[^/?#]*([\s\S]*)", 1)
    return F.coalesce(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), after), F.lit("")
    )


def _captures(pages: DataFrame) -> DataFrame:
    """Rows to be archived: key, page, url, payload, digest, and the page a revisit refers to."""
    rows = pick(pages, "page_id", "url", "html").select(
        url_key(F.col("url")).alias("key"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_PAGE)).alias("page"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    known = F.when(F.col("page") != _NO_PAGE, F.col("page"))
    firsts = (
        rows.where(F.col("size") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    refers = F.when(F.col("first") != F.col("page"), F.col("first"))
    return rows.join(small(written(firsts, "repeated-payloads")), "digest", "left").select(
        "key", "page", "url", "html", "digest", refers.alias("refers_to")
    )


def _record(page: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda p: f"<urn:page:{'none' if p == _NO_PAGE else p}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTABLE = "".join(chr(c) for c in range(33, 127))


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}, rest


def _page(name: str | None) -> int | None:
    number = name and name.removeprefix("<urn:page:").removesuffix(">")
    return None if number in (None, "none") else int(number)


def parse_record(data: bytes) -> dict:
    """Page, type, payload and digest of one record; raises if the payload does not have the
    digest the record states."""
    head, rest = _headers(data)
    block = rest[: int(head["content-length"])]
    http, payload = _headers(block)
    stated = head["warc-payload-digest"].removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != stated or len(payload) != int(http["content-length"]):
            raise ValueError(f"{head['warc-record-id']}: the payload is not the one stated")
    return {
        "page_id": _page(head["warc-record-id"]),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        archive = index = None
        place, lines, directory, first, last, count = 0, [], [], None, None, 0

        def close_block() -> None:
            at = index.tell()
            data = gzip.compress("\n".join(map(json.dumps, lines)).encode(), mtime=0)
            index.write(data)
            directory.append([*lines[0][:2], at, len(data)])
            lines.clear()

        for batch in batches:
            if batch.num_rows and archive is None:
                archive = files.open_output_stream(f"{name}.warc.gz", compression=None)
                index = files.open_output_stream(f"{name}.index", compression=None)
            for row in batch.to_pylist():
                record = _record(row["page"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                packed = gzip.compress(record, 6, mtime=0)
                archive.write(packed)
                last = [row["key"], row["page"]]
                first = first or last
                lines.append([*last, place, len(packed)])
                place, count = place + len(packed), count + 1
                if len(lines) == BLOCK_LINES:
                    close_block()
        if archive is None:
            return
        if lines:
            close_block()
        at = index.tell()
        index.write(gzip.compress(json.dumps(directory).encode(), mtime=0))
        index.write(struct.pack("<Q", at))
        index.close()
        archive.close()
        row = [*first, *last, f"{name}.warc.gz", f"{name}.index", at, count]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in row], names=[c.split()[0] for c in _MANIFEST.split(", ")]
        )

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page below ``folder``; the manifest is the result, also kept as
    the table ``manifest`` there.

    Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
    smallest page_id is stored and the others are revisits that refer to it; rows repeating
    that page_id are stored too.  A null html is an empty payload, a null page_id is greater
    than all others, and without any other no page is a revisit.
    """
    sorted_rows = _captures(pages).repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    manifest = sorted_rows.mapInArrow(_writer(f"{folder.rstrip('/')}/data"), _MANIFEST)
    return written(manifest, "manifest", f"{folder.rstrip('/')}/manifest")


class _Archives:
    """Lookups over the archives of a manifest; keeps what the last one has read."""

    def __init__(self, folder: str, manifest: list[tuple]):
        self._files, _ = FileSystem.from_uri(folder)
        self._manifest = manifest
        self._last = [(row[2], row[3]) for row in manifest]
        self._open: tuple = ()
        self._block: tuple = ()

    def _archive(self, row: tuple):
        if not self._open or self._open[0] != row[5]:
            for file in self._open[1:3]:
                file.close()
            index, archive = self._files.open_input_file(row[5]), self._files.open_input_file(row[4])
            size = index.size() - 8
            directory = json.loads(gzip.decompress(index.read_at(size - row[6], row[6])))
            self._open = row[5], index, archive, directory, [tuple(d[:2]) for d in directory]
            self._block = ()
        return self._open

    def _lines(self, number: int) -> list:
        _, index, _, directory, _ = self._open
        if not self._block or self._block[0] != number:
            _, _, at, size = directory[number]
            text = gzip.decompress(index.read_at(size, at)).decode()
            self._block = number, [json.loads(line) for line in text.split("\n")]
        return self._block[1]

    def find(self, key: str, page: int) -> Iterator[bytes]:
        """The records of one page at one key."""
        at = bisect.bisect_left(self._last, (key, page))
        if at == len(self._manifest) or (key, page) < tuple(self._manifest[at][:2]):
            return
        _, _, archive, directory, firsts = self._archive(self._manifest[at])
        number = max(0, bisect.bisect_left(firsts, (key, page)) - 1)
        while number < len(directory) and firsts[number] <= (key, page):
            lines = self._lines(number)
            for line in lines[bisect.bisect_left(lines, [key, page]) :]:
                if line[:2] != [key, page]:
                    return
                yield zlib.decompress(archive.read_at(line[3], line[2]), 31)
            number += 1


def lookup(folder: str, queries: DataFrame) -> DataFrame:
    """Records of the queried (url, page_id) pairs, read back through the index: page_id,
    payload_bytes, payload_digest, record_type and refers_to.

    A pair that was archived several times gives several rows, one that was not gives none;
    repeated queries count once.
    """
    spark = queries.sparkSession
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    # One row per archive that a task wrote: bounded by the number of partitions.
    rows = [tuple(r) for r in manifest.orderBy("first_key", "first_page").take(max(1, manifest.count()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(f"{folder.rstrip('/')}/data", rows)
        for batch in batches:
            found = [
                parse_record(record)
                for key, page in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist())
                for record in archives.find(key, page)
            ]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=_FOUND)

    asked = pick(queries, "url", "page_id").select(
        url_key(F.col("url")).alias("key"),
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_PAGE)).alias("page"),
    )
    ordered = asked.distinct().repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    return ordered.mapInArrow(
        run,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


_FOUND = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all pages and reads every one back through the index.

    An empty table gives no archive and no rows; columns other than page_id, url and html
    are not looked at.
    """
    folder = folder or scratch_dir(pages.sparkSession, "archives")
    write_archives(pages, folder)
    return lookup(folder, pages)
