"""Files as rows: fingerprints, text assets, and the character set of every text file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FileEncodingError
from ..session import cut_lineage, scratch_path
from .hashing import Sha256

# --- fixed values: media types by file suffix ---
MEDIA_TYPES = {
    "csv": "text/csv",
    "txt": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "json": "application/json",
    "yaml": "application/yaml",
    "yml": "application/yaml",
    "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "zip": "application/zip",
    "tar": "application/x-tar",
    "tgz": "application/x-tar",
    "gz": "application/gzip",
    "parquet": "application/vnd.apache.parquet",
}
OTHER_MEDIA_TYPE = "application/octet-stream"


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(v) for pair in MEDIA_TYPES.items() for v in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.lit(OTHER_MEDIA_TYPE))


# --- longer files are hashed in pieces of about this length, one task each ---
WHOLE_BYTES = 256 << 20
PACK_BYTES = 1 << 20
# Spark's text reader would unpack these, so they are always read whole
PACKED_NAMES = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
PACKS = "file string, block long, part long, size long, content binary"
PACKS_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, size, media_type, sha256) per file; hashing runs where the files are read.

    A file above WHOLE_BYTES is hashed piece by piece, each piece by a task that takes up the hash where the
    piece before left it, so that no task reads a long file.
    """
    long = (F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.col("_metadata.file_name").rlike(PACKED_NAMES)
    files = spark.read.format("binaryFile").load(paths)
    # reads no contents
    listed = files.filter(long).select("path", "length", F.col("_metadata.file_path").alias("file"))
    hashed = files.filter(~long).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if not listed.isEmpty():
        hashed = hashed.unionByName(_hashed_in_pieces(spark, listed))
    return hashed.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        media_type(F.col("path")).alias("media_type"),
        "sha256",
    )


def _hashed_in_pieces(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """(path, length, sha256). The text reader splits files of any content over tasks; its lines and line feeds are the bytes.

    It leaves out a byte order mark at the start of a file and does not tell whether a line feed ends it; the length tells both.
    """
    # a file that the given paths name twice is read once; its name is no pattern
    once = cut_lineage(listed.distinct())
    names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in once.collect()]
    rounds = once.agg(F.max(F.ceil(F.col("length") / WHOLE_BYTES))).first()[0]
    lines = spark.read.text(names, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("content")
    )
    stored = scratch_path(spark, "pieces")
    packs = lines.mapInArrow(_packed, PACKS).withColumn("piece", F.floor(F.col("block") / WHOLE_BYTES))
    packs.write.partitionBy("piece").parquet(stored)
    packs = spark.read.schema(f"{PACKS}, piece long").parquet(stored)
    found = packs.groupBy("file").agg(F.sum("size").alias("found"))
    states = once.join(found, "file", "left").select(
        "file", F.lit(-2).cast("long").alias("block"), F.lit(0).cast("long").alias("part"), F.col("length").alias("size"), F.lit(b"").alias("content"), "found"
    )
    marks = states.filter("found < size").select(
        "file", F.lit(-1).cast("long").alias("block"), "part", F.lit(len(BYTE_ORDER_MARK)).cast("long").alias("size"), F.lit(BYTE_ORDER_MARK).alias("content")
    )
    states = cut_lineage(states.drop("found").unionByName(marks))
    for piece in range(rounds):
        rows = states.unionByName(packs.filter(F.col("piece") == piece).drop("piece"))
        states = cut_lineage(rows.repartition("file").sortWithinPartitions("file", "block", "part").mapInArrow(_resumed, PACKS))
    return listed.join(states, "file").select("path", "length", _finished("content", "size").alias("sha256"))


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PACKS_ARROW)], schema=PACKS_ARROW)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split put together, each with its line feed, in rows of little more than PACK_BYTES."""
    place, part, held, size = None, 0, [], 0
    for batch in batches:
        for now, run in groupby(zip(*[c.to_pylist() for c in batch.columns]), key=lambda r: r[:2]):
            if now != place:
                if held:
                    yield _packs([(*place, part, size, b"".join(held))])
                place, part, held, size = now, 0, [], 0
            for _, _, line in run:
                held += (line, b"\n")
                size += len(line) + 1
                if size >= PACK_BYTES:
                    yield _packs([(*place, part, size, b"".join(held))])
                    part, held, size = part + 1, [], 0
    if held:
        yield _packs([(*place, part, size, b"".join(held))])


def _resumed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each file carried on over its rows; the first row of a file holds its length and the state so far."""
    file, length, digest = None, 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["file"] != file:
                if digest:
                    yield _packs([(file, -2, 0, length, digest.state())])
                file, length, digest = row["file"], row["size"], Sha256(row["content"])
            else:
                digest.update(row["content"][: length - digest.length()])
    if digest:
        yield _packs([(file, -2, 0, length, digest.state())])


@F.pandas_udf(T.StringType())
def _finished(states: pd.Series, sizes: pd.Series) -> pd.Series:
    def end(state: bytes, size: int) -> str:
        digest = Sha256(state)
        if digest.length() != size:
            raise ValueError(f"{digest.length()} of {size} bytes were read")
        return digest.hexdigest()

    return pd.Series([end(a, b) for a, b in zip(states, sizes)], dtype=object)


def duplicate_files(assets: DataFrame) -> DataFrame:
    """(sha256, copies, first_path) of contents that occur more than once."""
    return (
        assets.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
        .filter("copies > 1")
    )


def text_assets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text): one row per text file that is kept without a table preview."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, bytes): undecoded lines; large files are split over tasks."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), F.col("value").cast("binary").alias("bytes")
    )


@F.pandas_udf(T.BooleanType())
def _reads_as_gb18030(lines: pd.Series) -> pd.Series:
    def good(raw: bytes) -> bool:
        try:
            raw.decode("gb18030")
            return True
        except UnicodeDecodeError:
            return False

    return lines.map(good)


@F.pandas_udf(T.StringType())
def _guess(contents: pd.Series) -> pd.Series:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return pd.Series([None] * len(contents), dtype=object)

    def name(raw: bytes) -> str | None:
        match = from_bytes(raw).best()
        return match.encoding if match else None

    return contents.map(name)


def charsets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, charset): byte-order mark, strict UTF-8, strict GB18030, then a statistical guess.

    Validity is a conjunction over lines, so one huge file is checked by many tasks. No multi-byte
    sequence of either encoding contains a line feed, which makes the line-wise check exact. The
    second pass reads only files that failed UTF-8, the guess only files that failed both.
    """
    lines = raw_lines(spark, paths)
    mark = F.hex(F.substring("bytes", 1, 2))
    # UTF-16 of two lines or more has a zero byte at each line end; other text with such a line start has none
    wide = F.bool_or(F.contains(F.col("bytes"), F.lit(b"\x00"))) | (F.count(F.lit(1)) == 1)
    first = lines.groupBy("path").agg(
        (F.bool_or(mark == "FFFE") & wide).alias("little"), (F.bool_or(mark == "FEFF") & wide).alias("big"), F.bool_and(F.is_valid_utf8("line")).alias("utf8")
    )
    known = first.withColumn(
        "charset", F.when(F.col("little"), "UTF-16LE").when(F.col("big"), "UTF-16BE").when(F.col("utf8"), "UTF-8")
    ).select("path", "charset")
    open_files = known.filter("charset IS NULL").select("path")
    if open_files.isEmpty():
        return known
    second = lines.join(open_files, "path").groupBy("path").agg(F.bool_and(_reads_as_gb18030("bytes")).alias("gb"))
    decided = second.select("path", F.when(F.col("gb"), "GB18030").alias("charset"))
    rest = decided.filter("charset IS NULL").select("path")
    if not rest.isEmpty():
        contents = spark.read.format("binaryFile").load(paths).join(rest, "path")
        guessed = contents.select("path", _guess("content").alias("charset"))
        decided = decided.filter("charset IS NOT NULL").unionByName(guessed)
    return known.filter("charset IS NOT NULL").unionByName(decided)


def require_charsets(found: DataFrame) -> list[tuple[str, str]]:
    """File list with charsets for the reader; files without one are an error."""
    rows = [(r["path"], r["charset"]) for r in found.collect()]
    lost = sorted(p for p, c in rows if c is None)
    if lost:
        raise FileEncodingError("the text encoding cannot be established", files=lost[:20], count=len(lost))
    return rows
