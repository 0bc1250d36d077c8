"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Fingerprints within four bits of each other agree exactly on one of five bit blocks, so every fingerprint is
dealt to its five block values. Within a block value the fingerprints are sorted by Gray rank, which brings
shared bits together; runs of neighbours share a node whose mask holds the bits all of them agree on, and a
node's pattern leaves out what its upper node holds already. A search walks down from the top, adds up the
differences between a fingerprint and the patterns on its way, and drops a whole group once the sum passes the
limit. A bucket gives at most one link per fingerprint; components over all links are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import stored

SEED = 42
SHINGLE_WORDS = 4
MAX_BITS = 4
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
# A bucket with more members is split by blocks of its other bits, and beyond that by a grid of member pairs.
BUCKET_MEMBERS = 8192
FAN = 8
RUN_ROWS = 100_000
PAIRS_AT_ONCE = 2_000_000


# ---- fingerprints --------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 65536):
        upto = min(n, at + 65536)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, upto - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fingerprint(text.as_py(), shingle_words) for text in batch.column(1))
            prints = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, print long")


# ---- the index -----------------------------------------------------------------------------------


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in Gray-code order."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index of many buckets at once: ``prints`` sorted by (bucket, Gray rank), levels of nodes above them."""

    def __init__(self, prints: np.ndarray, buckets: np.ndarray, fan: int = FAN):
        self.order = np.lexsort((gray_rank(prints), buckets))
        self.prints = prints[self.order]
        bucket = buckets[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        n = len(prints)
        both, either = self.prints, self.prints
        levels = [(self.prints, np.full(n, full), np.arange(n), np.arange(n) + 1)]
        owner, first, last = bucket, np.arange(n), np.arange(n) + 1
        while True:
            fresh = np.ones(len(owner), bool)
            fresh[1:] = owner[1:] != owner[:-1]
            place = np.arange(len(owner))
            place = place - np.maximum.accumulate(np.where(fresh, place, 0))
            starts = np.flatnonzero(fresh | (place % fan == 0))
            stops = np.append(starts[1:], len(owner))
            both, either = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(either, starts)
            mask = ~(both ^ either)
            below = levels[-1]
            upper = np.repeat(mask, stops - starts)
            levels[-1] = (below[0] & ~upper, below[1] & ~upper, below[2], below[3])  # what the upper node holds is left out
            first, last, owner = first[starts], last[stops - 1], owner[starts]
            levels.append((both & mask, mask, starts, stops))
            self._spans = [*getattr(self, "_spans", []), (first, last)]
            if len(np.unique(owner)) == len(owner):
                break
        self.levels = levels
        self.root = np.repeat(np.arange(len(owner)), last - first)
        self.bucket_end = np.repeat(last, last - first)

    def pairs(self, queries: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) places with query < member, same bucket, at most ``max_bits`` apart."""
        query, node = queries, self.root[queries]
        sums = np.zeros(len(query), np.uint8)
        for level in range(len(self.levels) - 1, 0, -1):
            starts, stops = self.levels[level][2][node], self.levels[level][3][node]
            counts = stops - starts
            ahead = np.repeat(np.cumsum(counts) - counts, counts)
            query, sums = np.repeat(query, counts), np.repeat(sums, counts)
            node = np.arange(counts.sum()) - ahead + np.repeat(starts, counts)
            value, mask, _, _ = self.levels[level - 1]
            sums = sums + np.bitwise_count((self.prints[query] ^ value[node]) & mask[node])
            last = self._spans[level - 2][1][node] if level > 1 else node + 1
            near = (sums <= max_bits) & (last - 1 > query)
            query, node, sums = query[near], node[near], sums[near]
        return query, node

    def links(self, max_bits: int, pairs_at_once: int = PAIRS_AT_ONCE) -> np.ndarray:
        """Smallest connected place of every place, by the links inside its bucket."""
        n = len(self.prints)
        label = np.arange(n)
        work = np.cumsum(self.bucket_end - np.arange(n))
        at = 0
        while at < n:
            done = work[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(work, done + pairs_at_once)))
            a, b = self.pairs(np.arange(at, min(upto, n)), max_bits)
            while len(a):
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                low = np.minimum(la, lb)
                np.minimum.at(label, la, low)
                np.minimum.at(label, lb, low)
                while True:
                    next_label = label[label]
                    if (next_label == label).all():
                        break
                    label = next_label
            at = upto
        return label


def _bucket_links(max_bits: int):
    """Function over batches sorted by bucket (key, cell): star links (a, b) between representatives."""

    def closed(frame: pd.DataFrame) -> pd.DataFrame:
        fresh = (frame["key"].diff() != 0) | (frame["cell"].diff() != 0)
        buckets = fresh.cumsum().to_numpy()
        index = GrayIndex(frame["print"].to_numpy().view(np.uint64), buckets)
        label = index.links(max_bits)
        reps = frame["rep"].to_numpy()[index.order]
        far = label != np.arange(len(label))
        return pd.DataFrame({"a": reps[far], "b": reps[label[far]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < RUN_ROWS:
                continue
            frame = pd.concat(held, ignore_index=True)
            open_from = (frame["key"] == frame["key"].iloc[-1]) & (frame["cell"] == frame["cell"].iloc[-1])
            ready, rest = frame[~open_from], frame[open_from]
            if len(ready):
                yield closed(ready.reset_index(drop=True))
            held, rows = [rest], len(rest)
        if rows:
            yield closed(pd.concat(held, ignore_index=True))

    return run


def _block_keys(prints: Column, blocks: list[tuple[int, int]], prefix: Column | None = None) -> Column:
    """One whole-number key per bit block: (prefix, block, value)."""
    keys = []
    for j, (at, width) in enumerate(blocks):
        value = F.shiftrightunsigned(prints, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = F.lit(j + 1).cast("long") * 8192 + value
        keys.append(key if prefix is None else prefix * 65536 + key)
    return F.array(*keys)


def _other_blocks(taken: int) -> list[tuple[int, int]]:
    """Five blocks of the bits outside one of BLOCKS; a block may not straddle the gap, so bits are rotated first."""
    width = 64 - BLOCKS[taken][1]
    edges = [round(i * width / 5) for i in range(6)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(5)]


def _second_keys(prints: Column, key: Column) -> Column:
    """Keys of a hot bucket's members: agreeing on one block, they agree on one of five blocks of the other bits."""
    keys = F.lit(None).cast("array<bigint>")
    for j, (at, width) in enumerate(BLOCKS):
        turn = at + width
        turned = prints if turn == 64 else F.shiftrightunsigned(prints, turn).bitwiseOR(F.shiftleft(prints, 64 - turn))
        keys = F.when(F.floor(key / 8192) == j + 1, _block_keys(turned, _other_blocks(j), key)).otherwise(keys)
    return keys


def near_links(reps: DataFrame, max_bits: int = MAX_BITS, bucket_members: int = BUCKET_MEMBERS) -> DataFrame:
    """(a, b) links that connect all (print, rep) rows whose prints differ in at most ``max_bits`` <= 4 bits."""
    assert max_bits <= MAX_BITS, "five blocks find at most four differing bits"
    first = reps.select("print", "rep", F.explode(_block_keys(F.col("print"), BLOCKS)).alias("key"))

    def hot_keys(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
        return stored(counted.filter(F.col("members") > bucket_members), "simhash-hot")

    hot = hot_keys(first)
    cold = first.join(hot, "key", "left_anti")
    second = first.join(hot.select("key"), "key", "left_semi").select(
        "print", "rep", F.explode(_second_keys(F.col("print"), F.col("key"))).alias("key")
    )
    dense = hot_keys(second)
    whole = cold.unionByName(second.join(dense, "key", "left_anti")).withColumn("cell", F.lit(0).cast("long"))
    side = F.ceil(F.col("members") / bucket_members)
    grid = (
        second.join(dense, "key")
        .withColumn("side", side)
        .withColumn("own", F.pmod(F.xxhash64("print"), F.col("side")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
        .withColumn("cell", F.least("own", "other") * F.col("side") + F.greatest("own", "other"))
    )
    dealt = whole.select("key", "cell", "print", "rep").unionByName(grid.select("key", "cell", "print", "rep"))
    sorted_rows = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return sorted_rows.mapInPandas(_bucket_links(max_bits), "a long, b long")


# ---- components ----------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits. Null,
    empty and blank texts have fingerprint zero and are linked like any other. A row whose doc_id is null
    links nothing and gets a null component_id, unless its very fingerprint occurs with an id. Repeated rows
    stay rows of one component. No rows give no rows. Columns other than doc_id and text are ignored.
    """
    prints = stored(fingerprints(docs, shingle_words), "simhash-prints")
    reps = stored(
        prints.groupBy("print").agg(F.min("doc_id").alias("rep")).filter(F.col("rep").isNotNull()), "simhash-reps"
    )
    found = connected_components(near_links(reps, max_bits))
    classes = reps.join(found, reps["rep"] == found["node"], "left").select(
        F.col("print").alias("p"), F.coalesce("component", "rep").alias("component_id")
    )
    classes = stored(classes, "simhash-classes")
    return prints.join(classes, F.col("print") == F.col("p"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of rows repeating its doc_id the first
    by text. Rows without a doc_id stay, since nothing tells them apart. Columns are those of ``docs``."""
    found = near_duplicates(docs, shingle_words, max_bits)
    chosen = found.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("__id")).count()
    chosen = stored(chosen.withColumnRenamed("count", "__rows"), "simhash-kept")
    # The kept ids grow with the documents, so this join is a shuffle at every size.
    once = docs.join(chosen.filter("__rows = 1").hint("merge"), F.col("doc_id") == F.col("__id"), "left_semi")
    often = docs.join(chosen.filter("__rows > 1"), F.col("doc_id") == F.col("__id"), "left_semi")
    first = Window.partitionBy("doc_id").orderBy("text")
    often = often.withColumn("__place", F.row_number().over(first)).filter("__place = 1").drop("__place")
    return once.unionByName(often).unionByName(docs.filter(F.col("doc_id").isNull()))
