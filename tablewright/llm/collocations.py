"""Phrase collocations by Toivonen's sampling algorithm, per language.

A sample of the documents proposes words and phrases. The first full pass counts, exactly and at once, every word,
the proposed phrases and their negative border: each pair of proposed words and each triple of two proposed
pairs. Where the border fails, that is where something turns out frequent that the sample did not propose, a
further full pass counts the phrases that grow from it, until no pass finds anything new. Phrases of up to three
words close after at most three full passes, whatever the sample held; the sample only decides how many.

A pass reads texts in blocks of words, numbers the words of a block, counts in numpy and sends one row per block
and different phrase. What has been proposed, or is known as frequent, reaches the tasks as a bit table of
bounded size. A bit table may let further phrases through, which are then counted too; it never holds one back.
Which phrases earlier passes have counted follows from the same tables, so none is counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import MOST_BITS, BitTable, bit_table
from .common import stored

LEAST = 10
MOST_WORDS = 3
INSIDE_PERCENT = 50
TOP = 2000
UNIT = 1_000_000
NO_LANGUAGE = "und"

# The sample holds about this many bytes of text at most; its own threshold is half the expected count, 2 at least.
SAMPLE_BYTES = 32 * 1024 * 1024
SAMPLE_SLACK = 0.5
# Words in a block, and bytes of a text that are cut into words at once.
BLOCK_WORDS = 2_000_000
PART_BYTES = 1 << 20
RANK_PARTS = 16

COUNTS = "lang string, size int, phrase string, total long"

# Characters that end a piece become line feeds, tabs become spaces.
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
BREAK = 0


# ---- keys of words and pairs ----------------------------------------------------------------------------------


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    """The same as Spark's ``xxhash64(lang, word)``."""
    seed, digest = xxhash.xxh64_intdigest(lang, 42), xxhash.xxh64_intdigest
    return np.fromiter((digest(word, seed) for word in words), np.uint64, len(words))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left ^ ((right << np.uint64(17)) | (right >> np.uint64(47)))


def phrase_key(lang: Column, phrase: Column, size: int) -> Column:
    """The hash of a word, or of a pair of words, as a column."""
    words = F.split(phrase, " ")
    first = F.xxhash64(lang, words[0])
    if size == 1:
        return first
    second = F.xxhash64(lang, words[1])
    return first.bitwiseXOR(F.shiftleft(second, 17).bitwiseOR(F.shiftrightunsigned(second, 47)))


@dataclass
class Filters:
    """Tables of one pass: pairs are counted if both words are in ``words``, triples if both pairs are in ``pairs``."""

    words: Broadcast | None
    pairs: Broadcast | None


# ---- counting ------------------------------------------------------------------------------------


class _Numbers(dict):
    """Number of each word, given on first sight; the break between pieces has zero."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts that end at a space or break, so that a very long one is never a list of words at once."""
    at = 0
    while len(text) - at > PART_BYTES:
        space, line = text.find(b" ", at + PART_BYTES), text.find(b"\n", at + PART_BYTES)
        end = min(x for x in (space, line, len(text)) if x >= 0)
        yield text[at:end]
        at = end
    yield text[at:]


class _Block:
    """Words of one language, numbered."""

    def __init__(self) -> None:
        self.numbers = _Numbers({b"\n": BREAK, b"": 1})
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, text: str) -> None:
        body = text.encode("utf-8", "surrogatepass").lower().translate(_TABLE)
        get = self.numbers.__getitem__
        for part in _parts(body):
            words = part.replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(get, words), np.int64, len(words))
            ids = ids[ids != 1]
            self.words += len(ids)
            self.parts.append(ids)
        self.parts.append(np.zeros(1, np.int64))

    def counts(self, lang: str, passes: list[Filters]) -> Iterator[pa.RecordBatch]:
        """Rows of COUNTS: words in the first pass only, pairs and triples by the last pass's filters."""
        ids = np.concatenate(self.parts)
        words = list(self.numbers)
        names = pa.array(words, pa.binary())
        now, first_pass = passes[-1], len(passes) == 1
        hashes = word_hashes(lang.encode("utf-8", "surrogatepass"), words)
        if first_pass:
            seen = np.bincount(ids, minlength=len(words))
            seen[:2] = 0
            used = np.flatnonzero(seen)
            yield _rows(lang, 0, [pa.array([b""])], [int(seen.sum())])
            yield _rows(lang, 1, [names.take(pa.array(used))], seen[used])
        n = len(words)
        left, right = ids[:-1], ids[1:]
        pair = (left != BREAK) & (right != BREAK)
        if now.words is not None:
            inside = [f.words.value.has(hashes) for f in passes if f.words is not None]
            wanted = pair & inside[-1][left] & inside[-1][right]
            for earlier in inside[:-1]:
                wanted &= ~(earlier[left] & earlier[right])
            codes, seen = np.unique(left[wanted] * n + right[wanted], return_counts=True)
            yield _rows(lang, 2, [names.take(pa.array(part)) for part in (codes // n, codes % n)], seen)
        if now.pairs is not None:
            keys = pair_hashes(hashes[left], hashes[right])
            inside = [pair & f.pairs.value.has(keys) for f in passes if f.pairs is not None]
            wanted = inside[-1][:-1] & inside[-1][1:]
            for earlier in inside[:-1]:
                wanted &= ~(earlier[:-1] & earlier[1:])
            at = np.flatnonzero(wanted)
            firsts, number = np.unique(left[at] * n + right[at], return_inverse=True)
            codes, seen = np.unique(number * n + right[at + 1], return_counts=True)
            start = firsts[codes // n]
            yield _rows(lang, 3, [names.take(pa.array(part)) for part in (start // n, start % n, codes % n)], seen)


def _rows(lang: str, size: int, words: list[pa.Array], totals) -> pa.RecordBatch:
    """Rows of COUNTS; the phrases are the words of the arrays side by side, space-joined."""
    phrases = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
    n = len(phrases)
    columns = [pa.repeat(lang, n), pa.repeat(pa.scalar(size, pa.int32()), n), phrases.cast(pa.string()), pa.array(totals, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "total"])


def counted(docs: DataFrame, passes: list[Filters], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, size, phrase, total) over all rows of ``docs`` (lang, text) for the last of ``passes``.

    Size 0 holds the number of word occurrences of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                block = blocks.setdefault(lang.as_py(), _Block())
                before = block.words
                block.add(text.as_py())
                held += block.words - before
                if held >= block_words:
                    for name, block in blocks.items():
                        yield from block.counts(name, passes)
                    blocks, held = {}, 0
        for name, block in blocks.items():
            yield from block.counts(name, passes)

    # A block has each phrase once, so the rows are dealt as they are: adding them up before would find little.
    key = ["lang", "size", "phrase"]
    return docs.mapInArrow(run, COUNTS).repartition(*key).groupBy(*key).agg(F.sum("total").alias("total"))


def _filters(words: DataFrame | None, pairs: DataFrame | None, most_bits: int) -> Filters:
    def table(rows: DataFrame | None, size: int) -> Broadcast | None:
        if rows is None:
            return None
        key = phrase_key(F.col("lang"), F.col("phrase"), size)
        return rows.sparkSession.sparkContext.broadcast(bit_table(rows.filter(F.col("size") == size), key, most_bits))

    return Filters(table(words, 1), table(pairs, 2))


def _everything() -> Filters:
    """Lets all phrases through, for the sample."""
    return Filters(*[_Constant(BitTable(np.full(1, 0xFFFFFFFFFFFFFFFF, np.uint64)))] * 2)


@dataclass
class _Constant:
    value: BitTable


def frequent_phrases(
    docs: DataFrame,
    least: int = LEAST,
    sample_bytes: int = SAMPLE_BYTES,
    block_words: int = BLOCK_WORDS,
    most_bits: int = MOST_BITS,
    seed: int = 1,
) -> DataFrame:
    """(lang, size, phrase, total) of all phrases of up to three words that occur ``least`` times or more in a
    language, exactly, and the number of words of each language at size 0."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = min(1.0, sample_bytes / max(1, size))
    floor = max(2, int(SAMPLE_SLACK * share * least))
    picked = rows if share == 1.0 else rows.sample(share, seed)
    proposed = stored(counted(picked, [_everything()], block_words).filter(F.col("total") >= floor), "phrases-proposed")
    found = lambda frame: frame.filter((F.col("size") == 0) | (F.col("total") >= least))

    passes = [_filters(proposed, proposed, most_bits)]
    known = stored(found(counted(rows, passes, block_words)), "phrases-first")
    told = proposed
    while True:
        # Words and pairs that no filter so far was made of: what grows from them has not been counted yet.
        fresh = known.filter(F.col("size").isin(1, 2)).join(told, ["lang", "size", "phrase"], "left_anti")
        failed = {r["size"]: r["count"] for r in fresh.groupBy("size").count().collect()}
        if not failed:
            return known
        passes.append(_filters(known if 1 in failed else None, known if 2 in failed else None, most_bits))
        more = stored(found(counted(rows, passes, block_words)), "phrases-more")
        told = told.select("lang", "size", "phrase").unionByName(known.select("lang", "size", "phrase"))
        known = known.unionByName(more)


# ---- scores --------------------------------------------------------------------------------------


def _part_at(start: Column, length: Column) -> Column:
    """``length`` words of the phrase from word ``start`` on, counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), start, length), " ")


def scored(known: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of all phrases of two or three words, by their lowest-scoring cut."""
    phrases = known.filter(F.col("size") >= 2)
    cuts = phrases.select(
        "lang", "size", "phrase", F.col("total").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")
    ).withColumns({"head": _part_at(F.lit(1), F.col("cut")), "tail": _part_at(F.col("cut") + 1, F.col("size") - F.col("cut"))})
    parts = known.filter(F.col("size").between(1, MOST_WORDS - 1))
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("total").alias("l"))
    tails = parts.select("lang", F.col("phrase").alias("tail"), F.col("total").alias("r"))
    exact = lambda name: F.col(name).cast("decimal(16,0)")  # noqa: E731 - products stay within 38 digits
    joined = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    joined = joined.withColumns({"aa": exact("a") * exact("a") * F.lit(UNIT).cast("decimal(7,0)"), "lr": exact("l") * exact("r")})
    joined = joined.withColumn("score", F.expr("aa div lr"))
    lowest = F.min(F.struct("score", "cut", "a", "l", "r")).alias("best")
    return joined.groupBy("lang", "size", "phrase").agg(lowest).select("lang", "size", "phrase", "best.a", "best.l", "best.r", "best.score")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, inside_percent: int = INSIDE_PERCENT, **settings
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Texts are read whole; null and empty ones have no words, a null lang is ``und``. Repeated rows count as
    often as they occur. Equal scores and counts are ordered by phrase in UTF-8 byte order. Counts above 10^16
    are beyond the arithmetic and raise an error. No rows give no rows; columns other than lang and text are
    ignored. ``settings`` are those of ``frequent_phrases``.
    """
    known = frequent_phrases(docs, least, **settings)
    rated = stored(scored(known), "phrases-scored")
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " ")))
    longer = rated.filter(F.col("size") == 3).select("lang", inner.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = rated.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (F.col("size") == 3) | (100 * F.col("longest") < inside_percent * F.col("a"))
    )
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = kept.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    sizes = known.filter(F.col("size") == 0).select("lang", F.col("total").alias("n"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= top).join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
