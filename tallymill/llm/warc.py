"""WARC archives with a two-level capture index.

Pages become WARC records, one gzip member each, in one archive per task. A payload of
at least ``SMALL`` bytes that several pages share is stored once, with the smallest
page id; the others become revisit records. Index entries are sorted by (reversed-host
URL key, page id), cut into blocks of ``BLOCK`` lines that are compressed one by one, and
each index file ends with its block directory: the first key and page id, offset and length of every
block. The directory of directories, one row per index file, is all that a lookup holds
in memory; it binary-searches that, then a file's block directory, then reads the byte
range of one block, binary-searches its lines, and reads the byte ranges of records. Pairs of key
and page id are searched, so a URL with any number of captures costs a lookup one block.

Files are named by the task attempt that wrote them and known only through the table of
entries that the same attempt returned, so a repeated or speculative task can't mix two
versions; what a lost attempt wrote is never read. Paths may be in any store that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

SMALL, BLOCK, LEVEL = 100, 256, 6
DATE = "1970-01-01T00:00:00Z"
ENTRIES = "urlkey string, page_id long, archive string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def surt(url: str | None) -> str:
    """Reversed-host key of a URL; an unusable one is its own key."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else "//" + text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", text)
    if not host:
        return re.sub(r"\s", "%20", text)
    key = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")"
    return re.sub(r"\s", "%20", key + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member with a response record, or a revisit of ``refers_to``."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, more, body = "response", "", http + payload
    if refers_to is not None:
        kind, body = "revisit", http
        more = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{more}"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n") + packer.flush()


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_record(member: bytes) -> tuple:
    """A row of ``RECORDS`` from one gzip member; a response's digest is computed anew and compared."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    own = _headers(head)
    http, _, payload = rest[: int(own["content-length"])].partition(b"\r\n\r\n")
    digest, size = own["warc-payload-digest"].removeprefix("sha256:"), int(_headers(http)["content-length"])
    if own["warc-type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {own['warc-record-id']}")
    else:
        payload = None
    return _page(own["warc-record-id"]), own["warc-target-uri"], size, digest, own["warc-type"], _page(own.get("warc-refers-to")), payload


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Write all pages; returns the table of index entries (``ENTRIES``)."""
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    # the join's small side is a written table, so that both sides are dealt by Spark and a hot payload can be split
    shared = own.filter(F.col("size") >= SMALL).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.keep(shared.filter("n > 1 and first is not null").select("digest", "first"), "shared-payloads")
    ready = own.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    folder = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        name, at = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                keys, places, sizes = [], [], []
                for page, url, html, digest, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    member = record(page, url, html, digest, refers)
                    out.write(member)
                    keys.append(surt(url))
                    places.append(at)
                    sizes.append(len(member))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch["page_id"], pa.array([f"{folder}/{name}"] * len(keys), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["urlkey", "page_id", "archive", "offset", "length"])

    return scratch.keep(ready.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, ENTRIES), "entries")


def _line(key: str, page: int | None, archive: str, offset: int, length: int) -> str:
    return f"{key}\t{'' if page is None else page}\t{archive}\t{offset}\t{length}"


def _pair(key: str, page: int | None) -> tuple[str, int]:
    """What the index is sorted by; entries without a page id come first."""
    return key, -(1 << 63) - 1 if page is None else page


def _split(line: str) -> tuple[tuple[str, int], list[str]]:
    key, page, *rest = line.split("\t")
    return _pair(key, int(page) if page else None), rest


TOP = "file string, first string, first_page long, last string, last_page long, footer long, size long"


def write_index(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Write the sorted, blocked index; returns one row per index file (``TOP``)."""
    folder, parts = scratch.path("index"), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        path, pending, blocks, at, last = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.idx", [], [], 0, None
        with store.open_output_stream(f"{base}/{path}", compression=None) as out:

            def flush(n: int) -> None:
                nonlocal at
                block = zlib.compress("\n".join(_line(*e) for e in pending[:n]).encode("utf-8", "surrogatepass"))
                out.write(block)
                blocks.append((*pending[0][:2], at, len(block)))
                at += len(block)
                del pending[:n]

            for batch in batches:
                pending += zip(*(batch[c].to_pylist() for c in ("urlkey", "page_id", "archive", "offset", "length")))
                last = pending[-1][:2] if pending else last
                while len(pending) >= BLOCK:
                    flush(BLOCK)
            if pending:
                flush(len(pending))
            footer = zlib.compress("\n".join(f"{k}\t{'' if p is None else p}\t{o}\t{n}" for k, p, o, n in blocks).encode("utf-8", "surrogatepass"))
            out.write(footer)
            out.write(struct.pack("<q", len(footer)))
        if blocks:
            row = (f"{folder}/{path}", *blocks[0][:2], *last, at, at + len(footer) + 8)
            text, number = pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (text, text, number, text, number, number, number))], names=[c.split()[0] for c in TOP.split(", ")])

    return scratch.keep(ordered.mapInArrow(run, TOP), "directory")


class Reader:
    """Binary search in the two levels of the index. ``top``: (first pair, last pair, file, footer, size), sorted."""

    def __init__(self, top: list[tuple[tuple[str, int], tuple[str, int], str, int, int]]):
        self.top, self.directories, self.blocks = top, {}, {}
        self.lasts = [t[1] for t in top]

    def _bytes(self, uri: str, offset: int, length: int) -> bytes:
        store, path = _filesystem(uri)
        with store.open_input_file(path) as f:
            return f.read_at(length, offset)

    def directory(self, i: int) -> tuple[list[tuple[str, int]], list[tuple[int, int]]]:
        if i not in self.directories:
            if len(self.directories) > 8:
                self.directories.clear()
            _, _, file, footer, size = self.top[i]
            rows = [_split(r) for r in zlib.decompress(self._bytes(file, footer, size - footer - 8)).decode("utf-8", "surrogatepass").split("\n")]
            self.directories[i] = [pair for pair, _ in rows], [(int(r[0]), int(r[1])) for _, r in rows]
        return self.directories[i]

    def block(self, i: int, b: int) -> tuple[list[tuple[str, int]], list[list[str]]]:
        if (i, b) not in self.blocks:
            if len(self.blocks) > 64:
                self.blocks.clear()
            offset, length = self.directory(i)[1][b]
            lines = [_split(r) for r in zlib.decompress(self._bytes(self.top[i][2], offset, length)).decode("utf-8", "surrogatepass").split("\n")]
            self.blocks[i, b] = [pair for pair, _ in lines], [rest for _, rest in lines]
        return self.blocks[i, b]

    def find(self, key: str, page: int | None) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of every entry of a key and page id."""
        for _, *place in self._between(_pair(key, page), _pair(key, page)):
            yield tuple(place)

    def captures(self, key: str) -> Iterator[tuple[int | None, str, int, int]]:
        """(page id, archive, offset, length) of every capture under a key, one after the other."""
        for page, *place in self._between(_pair(key, None), (key, 1 << 63)):
            yield page if page >= -(1 << 63) else None, *place

    def _between(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[tuple[int, str, int, int]]:
        for i in range(bisect_left(self.lasts, low), len(self.top)):
            if self.top[i][0] > high:
                return
            firsts = self.directory(i)[0]
            for b in range(max(0, bisect_left(firsts, low) - 1), len(firsts)):
                if firsts[b] > high:
                    break
                pairs, places = self.block(i, b)
                for k in range(bisect_left(pairs, low), bisect_right(pairs, high)):
                    archive, offset, length = places[k]
                    yield pairs[k][1], archive, int(offset), int(length)


class Archive:
    """A written collection: index entries, the top directory, and lookups."""

    def __init__(self, pages: DataFrame):
        self.scratch = Scratch(pages.sparkSession, "warc")
        self.entries = write_archives(pages, self.scratch)
        self.directory = write_index(self.entries, self.scratch)
        # one row per index file, at most as many as shuffle partitions; byte order of UTF-8 is code-point order
        self.top = sorted((_pair(r["first"], r["first_page"]), _pair(r["last"], r["last_page"]), r["file"], r["footer"], r["size"]) for r in self.directory.collect())

    def resolve(self, requests: DataFrame) -> DataFrame:
        """Index entries of the requested (url, page_id) pairs, found through both levels of the index."""
        spark, shared = requests.sparkSession, requests.sparkSession.sparkContext.broadcast(self.top)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        @F.pandas_udf("string")
        def keyed(url: pd.Series) -> pd.Series:
            return url.map(surt, na_action=None)

        wanted = requests.select(keyed(F.col("url").cast("string")).alias("urlkey"), "page_id").distinct().repartitionByRange(parts, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            for batch in batches:
                rows = [(want, page, *place) for want, page in zip(batch["urlkey"].to_pylist(), batch["page_id"].to_pylist()) for place in reader.find(want, page)]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["urlkey", "page_id", "archive", "offset", "length"])

        return wanted.mapInArrow(run, ENTRIES)

    def read(self, places: DataFrame, payload: bool = True) -> DataFrame:
        """Records at the given places, by range reads in archive order."""
        parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = places.repartition(parts, "archive", F.expr("offset div 8388608")).sortWithinPartitions("archive", "offset")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, file = None, None
            for batch in batches:
                rows = []
                for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length"))):
                    if archive != name:
                        if file is not None:
                            file.close()
                        store, path = _filesystem(archive)
                        name, file = archive, store.open_input_file(path)
                    row = read_record(file.read_at(length, offset))
                    rows.append(row if payload else (*row[:-1], None))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            if file is not None:
                file.close()

        return ordered.mapInArrow(run, RECORDS)

    def lookup(self, requests: DataFrame, payload: bool = True) -> DataFrame:
        """Records of the requested (url, page_id) rows."""
        return self.read(self.resolve(requests), payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, look every one of them up in the index, and return what its record says.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A null html is an empty payload, a null url the empty key; rows with one
    payload and a null id revisit the smallest id; repeated rows of the smallest id are
    responses each. An empty table gives no rows; other columns are ignored.
    """
    return Archive(pages).lookup(pages, payload=False).drop("payload", "url")
