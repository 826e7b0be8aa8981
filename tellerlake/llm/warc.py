"""WARC archives with a two-level capture index.

Each task writes one archive in the shared folder, every record a gzip member of its own. Captures are sorted by reversed-host URL key into index
parts: compressed blocks of lines, and beside them a sparse directory with the first key of each block. A lookup searches the list of parts, the
part's directory and the block by bisection, and then reads only the bytes of the record. File names are new for each attempt and only rows that
arrive name them, so a task that runs again does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlake.llm.common import slices, written
from tellerlake.session import scratch

BLOCK_LINES = 256
NO_PAGE = -(1 << 63)  # sorts pages without id first
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAFE = {c: f"%{c:02X}" for c in [*range(33), 127]}
CAPTURE = "page_id long, url_key string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed-host key: `http://a.example.net/x` is `net,example,a)/x`; without `://` the text itself after a bracket."""
    if not url or "://" not in url:
        return f"){(url or '').translate(SAFE)}"
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return f"{','.join(reversed(rest[:cut].lower().split('.')))}){rest[cut:]}".translate(SAFE)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response, or a revisit of page `first` that keeps the HTTP head but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').translate(SAFE)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ] + ([] if first is None else [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"])
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Page, payload and type of a record; a payload that does not fit its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(lines["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest, number = lines["WARC-Payload-Digest"].removeprefix("sha1:"), lambda x: int(x[10:-1]) if x and x[10:-1] else None
    if lines["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {lines['WARC-Record-ID']}")
    return {"page_id": number(lines["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": lines["WARC-Type"], "refers_to": number(lines.get("WARC-Refers-To"))}


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each page (page_id, url, html) and return the captures. Of records with equal payloads of at least `least` bytes that with
    the smallest page_id is the response and the others revisit it; repeated rows of that page, and payloads that only pages without id hold, are
    responses. A null html is an empty payload."""
    payload = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    shared = payload.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    marked = payload.join(shared.select("sha", "first"), "sha", "left").select("page_id", "url", "payload", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for part in slices(batches, 2):
            rows = part.to_pylist()
            if out is None and rows:
                fs, path = store(name)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            made = []
            for r in rows:
                data = member(record(r["page_id"], r["url"], r["payload"], base64.b32encode(r["sha"]).decode(), r["first"]))
                made.append((r["page_id"], url_key(r["url"]), name, at, len(data)))
                out.write(data)
                at += len(data)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "url_key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return written(marked.mapInArrow(write, CAPTURE), "captures")


def sort_key(line: list) -> tuple[str, int]:
    return line[0], NO_PAGE if line[1] is None else line[1]


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index and return its parts in order: `part`, `key`, `page` (the first entry), `directory` (where the part's directory begins)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, directory, held, name = None, 0, [], [], f"{folder}/{uuid.uuid4().hex}.idx"

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress("\n".join(map(json.dumps, held)).encode(), 1)
            directory.append([*sort_key(held[0]), at, len(data)])
            out.write(data)
            at += len(data)
            held = []

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs, path = store(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                held.append([r["url_key"], r["page_id"], r["file"], r["offset"], r["length"]])
                if len(held) == BLOCK_LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode(), 1)
            out.write(data)
            out.close()
            yield pa.record_batch([pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([at], pa.int64()), pa.array([len(data)], pa.int64())], names=["part", "key", "page", "directory", "size"])

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "url_key", F.coalesce("page_id", F.lit(NO_PAGE))).sortWithinPartitions("url_key", F.coalesce("page_id", F.lit(NO_PAGE)))
    return written(ordered.mapInArrow(write, "part string, key string, page long, directory long, size long"), "index")


class Reader:
    """Range reads with the directories, blocks and files last used."""

    def __init__(self, parts: list[tuple[str, int, str, int, int]]):
        self.parts = sorted(parts)
        self.starts = [p[:2] for p in self.parts]
        self.held: OrderedDict = OrderedDict()

    def kept(self, key: tuple, make, most: int = 64):
        if key not in self.held:
            while len(self.held) >= most:
                self.held.popitem(last=False)
            self.held[key] = make()
        self.held.move_to_end(key)
        return self.held[key]

    def range(self, name: str, offset: int, length: int) -> bytes:
        def opened():
            fs, path = store(name)
            return fs.open_input_file(path)

        return self.kept(("file", name), opened).read_at(length, offset)

    def directory(self, i: int) -> list[list]:
        _, _, name, at, size = self.parts[i]
        return self.kept(("directory", name), lambda: json.loads(zlib.decompress(self.range(name, at, size))))

    def block(self, i: int, b: int) -> list[list]:
        name, (_, _, at, size) = self.parts[i][2], self.directory(i)[b]
        return self.kept(("block", name, b), lambda: [json.loads(x) for x in zlib.decompress(self.range(name, at, size)).decode().split("\n")])

    def entries(self, wanted: tuple[str, int]) -> Iterator[list]:
        """Index lines of a (key, page): from the last block that begins before it, on while lines fit."""
        i = max(0, bisect_right(self.starts, wanted) - 1)
        while i > 0 and self.starts[i] == wanted:
            i -= 1
        while i < len(self.parts) and self.starts[i] <= wanted:
            directory = self.directory(i)
            b = max(0, bisect_right(directory, wanted, key=lambda d: (d[0], d[1])) - 1)
            while b > 0 and (directory[b][0], directory[b][1]) == wanted:
                b -= 1
            while b < len(directory) and (directory[b][0], directory[b][1]) <= wanted:
                lines = self.block(i, b)
                at = bisect_right(lines, (wanted[0], wanted[1] - 1), key=sort_key)
                while at < len(lines) and sort_key(lines[at]) == wanted:
                    yield lines[at]
                    at += 1
                b += 1
            i += 1

    def record(self, name: str, offset: int, length: int) -> bytes:
        return zlib.decompress(self.range(name, offset, length), 31)


def read_captures(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Records of the wanted (url, page_id) rows, each pair once, found through the index: what `parsed` gives. The list of parts, one row for each
    index partition, goes to every executor; requests are sorted by key, so neighbours use the same block."""
    spark = wanted.sparkSession
    parts = spark.sparkContext.broadcast([(r.key, r.page, r.part, r.directory, r.size) for r in index.toLocalIterator()])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["url_key", "page_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(parts.value)
        for batch in batches:
            rows = [parsed(reader.record(*line[2:])) for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for line in reader.entries(sort_key([key, page]))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["url_key", F.coalesce("page_id", F.lit(NO_PAGE))]
    requests = wanted.select("url", "page_id").mapInArrow(keys, "url_key string, page_id long").distinct().repartitionByRange(n, *order).sortWithinPartitions(*order)
    return requests.mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages, index the archives and read every record back through the index."""
    folder = scratch(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, least)
    return read_captures(pages, build_index(captures, f"{folder}/index"))
