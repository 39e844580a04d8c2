"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, one after another in a
file. Two skippable frames close it: the record index, which maps the id of
every record to its frame and its place in the decompressed frame, and the seek
table of the frames. A reader takes the last bytes of a file, finds both, and
decompresses only the frames it needs; a plain decompressor sees one stream of
WARC records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from gazette.llm.files import RangeReader, new_folder, partition_id, write_whole
from gazette.scale import written

FRAME_BYTES = 256 << 10
FILE_BYTES = 128 << 20
LEVEL = 3
#: Payloads of fewer bytes are never stored as references.
LEAST_BYTES = 0
#: Magic numbers of the seekable Zstandard format: skippable frames and the seek table's end. Fixed values.
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("id", "S16"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> bytes:
    """16 bytes that name the record of a page with a payload."""
    return hashlib.md5(f"{page_id}|{digest}".encode()).digest()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> tuple[bytes, bytes]:
    """Id and bytes of a record; a revisit carries the HTTP head alone."""
    own = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "urn:x-none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=own)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.UUID(bytes=record_id(refers, digest))}>"]
    return own, "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class Bundle:
    """A file in the making."""

    def __init__(self, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        self.pack = zstandard.ZstdCompressor(level=level)
        self.frame_bytes, self.frames, self.sizes, self.entries = frame_bytes, [], [], []
        self.open: list[bytes] = []
        self.held = self.raw = 0

    def add(self, own: bytes, data: bytes) -> None:
        if self.held and self.held + len(data) > self.frame_bytes:
            self._close()
        self.entries.append((own, len(self.sizes), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        self.raw += len(data)

    def _close(self) -> None:
        frame = self.pack.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append((len(frame), self.held))
        self.open, self.held = [], 0

    def chunks(self):
        """The bytes of the file: frames, record index, seek table."""
        if self.open:
            self._close()
        yield from self.frames
        index = np.array(sorted(self.entries), _INDEX).tobytes()
        yield struct.pack("<II", INDEX_MAGIC, len(index)) + index
        table = b"".join(struct.pack("<II", *s) for s in [*self.sizes, (len(index) + 8, 0)]) + struct.pack("<IBI", len(self.sizes) + 1, 0, SEEK_END)
        yield struct.pack("<II", SEEK_MAGIC, len(table)) + table


class Archive:
    """A finished file, read by ranges."""

    def __init__(self, reader: RangeReader):
        self.reader = reader
        n, _, end = struct.unpack("<IBI", reader.read(reader.size - 9, 9))
        if end != SEEK_END:
            raise ValueError("no seek table")
        sizes = np.frombuffer(reader.read(reader.size - 9 - 8 * n, 8 * n), "<u4").reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(sizes[:, 0])
        self.frames, self.begin = sizes[:-1], ends - sizes[:, 0]
        self.index = np.frombuffer(reader.read(int(self.begin[-1]) + 8, int(sizes[-1, 0]) - 8), _INDEX)

    def frame(self, i: int) -> bytes:
        size, raw = self.frames[i].tolist()
        return zstandard.ZstdDecompressor().decompress(self.reader.read(int(self.begin[i]), size), max_output_size=raw)

    def record(self, own: bytes) -> bytes:
        """One record by its id: a search in the index and one frame."""
        at = np.searchsorted(self.index["id"], np.array(own, "S16"))
        if at == len(self.index) or self.index["id"][at].ljust(16, b"\0") != own:
            raise KeyError(own.hex())
        return self._slice(self.frame(self.index["frame"][at]), at)

    def _slice(self, frame: bytes, at: int) -> bytes:
        begin = int(self.index["offset"][at])
        return frame[begin : begin + int(self.index["length"][at])]

    def records(self):
        """All records, frame by frame."""
        order = np.lexsort((self.index["offset"], self.index["frame"]))
        number, frame = -1, b""
        for at in order.tolist():
            if self.index["frame"][at] != number:
                number = int(self.index["frame"][at])
                frame = self.frame(number)
            yield self._slice(frame, at)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record and the payload behind its HTTP head."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def with_roles(pages: DataFrame, page_id: str = "page_id", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every page with payload, sha1 of it, and the page it refers to where it is a revisit.

    Of equal payloads of at least `least_bytes` the largest id is the response;
    rows that repeat that id are responses too. Where all ids are null, all are.
    """
    base = pages.withColumn("_payload", F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")).withColumn("_sha1", F.sha1("_payload"))
    # Counts and maxima are combined before the shuffle; only payloads seen twice come back.
    again = (
        base.where(F.octet_length("_payload") >= least_bytes).groupBy("_sha1")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(page_id).alias("_first")).where((F.col("_n") > 1) & F.col("_first").isNotNull())
    )
    joined = base.join(again, "_sha1", "left")
    revisit = F.col("_first").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("_first"))
    return joined.withColumn("_revisit", revisit)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for every page; gives one row (part, path, records, bytes) per file.

    A null html is an empty payload, null ids and urls are written as such; other
    columns are not read. A task holds one file's compressed frames.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = with_roles(pages.select(page_id, url, html), page_id, html).select(page_id, url, "_payload", "_sha1", "_first", "_revisit")

    def run(batches):
        part, number, bundle = partition_id(), 0, Bundle()

        def flush():
            nonlocal number, bundle
            path, size = write_whole(folder, f"part-{part:06d}-{number:06d}.warc.zst", bundle.chunks())
            out = pa.RecordBatch.from_pydict({"part": [part], "path": [path], "records": [len(bundle.entries)], "bytes": [size]})
            number, bundle = number + 1, Bundle()
            return out

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                for page, target, payload, sha1, refers, revisit in zip(*(c.slice(a, 256).to_pylist() for c in batch.columns), strict=True):
                    bundle.add(*record(page, target, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers, revisit))
                    if bundle.raw >= file_bytes:
                        yield flush()
        if bundle.entries:
            yield flush()

    return written(rows.mapInArrow(run, "part bigint, path string, records bigint, bytes bigint"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """Every record of the files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are digested again and must agree with their records;
    a revisit gets its length and the page it refers to from the record it names.
    """

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("own", pa.binary()), ("refers", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with RangeReader(path) as reader:
                    for data in Archive(reader).records():
                        fields, payload = parse(data)
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} has changed")
                        key = lambda name: uuid.UUID(fields[name].strip("<>")).bytes if name in fields else None
                        rows.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, len(payload) if kind == "response" else None, digest, kind, key("WARC-Record-ID"), key("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # A file is a unit of work; as many tasks read them as wrote them.
    tasks = files.select("part").distinct().count()
    found = written(
        files.select("path").repartition(max(tasks, 1)).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, own binary, refers binary"),
        "warc-records",
    )
    named = found.where(F.col("refers").isNotNull()).select(F.col("refers").alias("own")).distinct()
    target = found.join(named, "own", "left_semi").groupBy("own").agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    joined = found.join(target.withColumnRenamed("own", "refers"), "refers", "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to")
    )
