"""WARC records in seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames of whole records, a skippable frame that maps record
identifiers to a frame and an offset inside it, and the seek table of the seekable format at the end. Bundles are
written by Spark's text writer, a bundle as one "line" in a file of its own, whose separator is the last byte of
the seek table; so they are plain files on any store that Spark can write, with its commit of finished tasks only.
They are read as binary files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored

FRAME_BYTES = 1 << 19
BUNDLE_BYTES = 8 << 20
LEVEL = 3
# Fixed values of the Zstandard seekable format.
SEEK_FRAME, SEEK_FOOTER, MAP_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
NO_DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = NO_DATE) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if ``refers_to`` is given, whose block has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


class Bundle:
    """Collects records; ``finish`` gives the bytes of the file."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.map: list[tuple[str, int, int, int]] = []
        self.open = bytearray()
        self.length = 0

    def add(self, name: str, raw: bytes) -> None:
        self.map.append((name, len(self.sizes), len(self.open), len(raw)))
        self.open += raw
        if len(self.open) >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.compressor.compress(bytes(self.open))
            self._append(frame, len(self.open))
            self.open = bytearray()

    def _append(self, frame: bytes, size: int) -> None:
        self.parts.append(frame)
        self.sizes.append((len(frame), size))
        self.length += len(frame)

    def finish(self) -> bytes:
        self._close()
        body = self.compressor.compress(json.dumps(self.map).encode())
        self._append(struct.pack("<II", MAP_FRAME, len(body)) + body, 0)
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), 0, SEEK_FOOTER)
        return b"".join([*self.parts, struct.pack("<II", SEEK_FRAME, len(table)), table])


class Reader:
    """Random access to the records of a bundle by the seek table and the record map."""

    def __init__(self, content: bytes):
        self.content = content
        count, _, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEK_FOOTER:
            raise ValueError("not a seekable bundle")
        table = content[-9 - 8 * count : -9]
        self.starts = [0]
        for size, _ in struct.iter_unpack("<II", table):
            self.starts.append(self.starts[-1] + size)
        last = content[self.starts[-2] + 8 : self.starts[-1]]
        self.map = [tuple(entry) for entry in json.loads(zstandard.ZstdDecompressor().decompress(last))]
        self.held: tuple[int, bytes] = (-1, b"")

    def at(self, frame: int, offset: int, length: int) -> bytes:
        """A record by frame and offset; decompresses that frame alone, and keeps the last one."""
        if self.held[0] != frame:
            raw = self.content[self.starts[frame] : self.starts[frame + 1]]
            self.held = (frame, zstandard.ZstdDecompressor().decompress(raw))
        return self.held[1][offset : offset + length]


# ---- jobs ----------------------------------------------------------------------------------------


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, code, refers_to) of the pages whose payload an equal page of larger id holds.

    Payloads are compared by SHA-256 on a narrow table, so an often repeated payload is counted map-side.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.filter(F.octet_length(html) >= least_bytes).select("page_id", F.sha2(html, 256).alias("code"))
    groups = narrow.groupBy("code").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows"))
    groups = groups.filter((F.col("rows") > 1) & F.col("refers_to").isNotNull()).drop("rows")
    found = narrow.join(groups, "code").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select("page_id", "code", "refers_to").distinct()


def write_bundles(
    pages: DataFrame, folder: str, least_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES
) -> None:
    """Writes every row of ``pages`` as a record into bundles in ``folder``, which must not exist."""
    known = stored(revisits(pages, least_bytes), "warc-revisits")
    known = known.select(F.col("page_id").alias("id"), "code", "refers_to")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("own"))
    marked = rows.join(known, (rows["own"] == known["code"]) & rows["page_id"].eqNullSafe(known["id"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bundle: Bundle) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bundle.finish()[:-1]], pa.binary())], ["content"])

        bundle = Bundle(frame_bytes)
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns):
                raw = record(page_id.as_py(), url.as_py(), payload.as_py().encode(), refers_to.as_py())
                bundle.add(record_id(page_id.as_py()), raw)
                if bundle.length >= bundle_bytes:
                    yield out(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.map:
            yield out(bundle)

    content = marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "content binary")
    writer = content.select(F.col("content").cast("string").alias("value")).write
    last = SEEK_FOOTER.to_bytes(4, "little")[-1:].decode("latin-1")
    writer.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", last).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "content")


def record_map(bundles: DataFrame) -> DataFrame:
    """(record_id, path, frame, offset, length): where each record is, from the bundles' own maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                entries = Reader(content.as_py()).map
                columns = [pa.array(column) for column in zip(*entries)]
                paths = pa.array([path.as_py()] * len(entries))
                yield pa.RecordBatch.from_arrays([columns[0], paths, *columns[1:]], ["record_id", "path", "frame", "offset", "length"])

    return bundles.mapInArrow(run, "record_id string, path string, frame long, offset long, length long")


def fetch(bundles: DataFrame, places: DataFrame) -> DataFrame:
    """(record_id, record binary) of rows of the record map, decompressing only the frames they lie in."""
    wanted = places.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(*batch.columns):
                reader = Reader(content.as_py())
                rows = [(p["record_id"], reader.at(p["frame"], p["offset"], p["length"])) for p in places.as_py()]
                names, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(raw, pa.binary())], ["record_id", "record"])

    return bundles.join(wanted, "path").select("content", "wanted").mapInArrow(run, "record_id string, record binary")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(bundles: DataFrame) -> DataFrame:
    """READ rows of all records, read out of the bundles; a revisit's payload size is in its HTTP head."""

    def number(name: str | None) -> int | None:
        text = name[len("<urn:page:") : -1] if name else "none"
        return None if text == "none" else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                reader, rows = Reader(content.as_py()), []
                for _, frame, offset, length in reader.map:
                    fields, http, payload = parse(reader.at(frame, offset, length))
                    size = int(http.decode().rpartition("Content-Length: ")[2])
                    if fields["WARC-Type"] == "response" and (size != len(payload) or fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    rows.append(
                        (
                            number(fields["WARC-Record-ID"]),
                            size,
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            fields["WARC-Type"],
                            number(fields.get("WARC-Refers-To")),
                        )
                    )
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in READ.split(", ")])

    return bundles.mapInArrow(run, READ)


def archived_rows(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """READ rows of all pages, written into bundles in the shared folder and read back.

    Of equal payloads of at least ``least_bytes`` bytes the page of largest id is the response and the others
    revisit it. Null payloads are empty; a null page_id is never the response of a group that has an id; rows
    that repeat a page_id and payload are records of the same kind; a null url is ``about:blank``. No rows
    give no rows. Columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc-bundles")
    write_bundles(pages, folder, least_bytes)
    return read_records(read_files(spark, folder))
