"""MinHash near-duplicates over an LSH forest.

Documents with equal shingle sets are one node. Each node has a MinHash signature and a place in several sorted
orders; an order's first two values name a region. In each order the neighbours with the longest common prefix
stand side by side and are the first candidates: pairs whose signatures agree enough are confirmed on the full
sets, the best of each class in a round, and linked. What is left are regions that still hold more than one class. A small
one compares its members of different classes by signature. In a dense one the forest grows deeper: it branches
into several sub-orders by further signature values, again and again until its regions are small, so that the depth
follows the density. Members that may be linked form clumps, of which only a spanning forest is written down; a
clump's full sets then meet in cells of bounded size, where all pairs of different classes are confirmed at once by
a product of membership matrices. So no step writes a row for each pair of a group. A clump too large for that is
confirmed in its regions.

A pair of similarity 0.8 shares a region of an order with chance 0.64, and comes together in some sub-order of a
dense region with chance 0.92 or more at any depth (four sub-orders of three values each), so 20 orders miss it
with a chance below 10^-7 (and 10^-8 where no region is dense). The chance falls further with the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .bits import bit_table
from .common import stored

SHINGLE_WORDS = 4
PERCENT = 80
ORDERS = 20
PREFIX = 2
VALUES = 160
# Signature values that must agree: at similarity 0.8 fewer agree with a chance of about 10^-9.
LEAST_AGREEING = 96
REGION_MEMBERS = 512
# A region of up to so many blocks of that size is searched by a grid of blocks, beyond that it grows deeper.
GRID_SIDE = 4
BRANCHES = 4
BRANCH_VALUES = 3
MOST_LEVELS = 8
# Most rounds in which each class confirms its best candidate; they end when a round links nothing. Classes at least
# halve wherever a round links. More rounds cost more shuffles than they save (quick check, eight rounds).
BEST_ROUNDS = 2
# Members and shingles in a block of a clump, blocks of a clump beyond which it is confirmed in its regions, and
# columns of a membership matrix at once.
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1_000_000
MOST_BLOCKS = 8
MATRIX_COLUMNS = 4096
RUN_ROWS = 50_000
SEED = 42

_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_TIMES = (_RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


# ---- signatures ----------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    joined = np.full(n, k, np.uint64)
    for j in range(k):  # the hash so far, moved on by each word: the order of words counts
        joined = _mixed(joined * _WEIGHTS[j % 4] + hashes[j : j + n])
    return np.unique(joined)


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima over permutations of 32-bit hashes."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, ((short[at : at + 256, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return least


_PRINTS = "doc_id long, code long, n_shingles long, set binary, keys array<long>, sketch binary"


def prints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: set is a 128-bit hash of the shingle set (null if empty), keys the region of each
    order, sketch the low byte of each signature value, code a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, keys, sketches = [], [], [], []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), shingle_words)
                sizes.append(len(shingles))
                if not len(shingles):
                    sets.append(None), keys.append(None), sketches.append(None)
                    continue
                values = signature(shingles)
                parts = values[: ORDERS * PREFIX].reshape(ORDERS, PREFIX)
                sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append([xxhash.xxh64_intdigest(p.tobytes(), i) - (1 << 63) for i, p in enumerate(parts)])
                sketches.append((values & np.uint32(255)).astype(np.uint8).tobytes())
            columns = [
                batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "n_shingles", "set", "keys", "sketch"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("code"), text.alias("text")).mapInArrow(run, _PRINTS)


# ---- full sets -----------------------------------------------------------------------------------


def full_sets(docs: DataFrame, nodes: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, shingles) of the given (node, set, code) rows: texts are read again and only those whose code is
    among the wanted ones, by a bounded bit table, are turned into sets."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_table(nodes, F.col("code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = wanted.value, set()
        for batch in batches:
            codes = batch.column(0).to_numpy()
            sets, found = [], []
            for i in np.flatnonzero(table.has(codes.view(np.uint64))).tolist():
                if codes[i] in seen:
                    continue
                seen.add(codes[i])
                shingles = shingle_set(batch.column(1)[i].as_py(), shingle_words)
                if len(shingles):
                    sets.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    found.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(found, pa.binary())], ["set", "shingles"])

    text = F.col("text").cast("string")
    made = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("code"), text.alias("text")).mapInArrow(run, "set binary, shingles binary")
    return made.join(nodes.select("set", "node"), "set").groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) of every pair, by the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    # Only the sets of a side's nodes move, not all sets once more for each round of few pairs.
    left, right = (sets.join(pairs.select(F.col(c).alias("node")).distinct(), "node", "left_semi") for c in ("a", "b"))
    left = left.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = right.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


# ---- the forest ----------------------------------------------------------------------------------


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def neighbours(members: DataFrame) -> DataFrame:
    """(a, b, agreeing) of neighbours in each order: rows (key, tree, node, sketch) are sorted by region and then by the
    values that follow, in ranges, so that a hot region spans many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, sketch = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _sketches(batch.column(2))
            if last is not None:
                key, node, sketch = np.append(last[0], key), np.append(last[1], node), np.vstack([last[2], sketch])
            last = key[-1:], node[-1:], sketch[-1:]
            agreeing = (sketch[1:] == sketch[:-1]).sum(axis=1)
            near = (key[1:] == key[:-1]) & (agreeing >= LEAST_AGREEING)
            a, b = node[:-1][near], node[1:][near]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(agreeing[near].astype(np.int32))], ["a", "b", "agreeing"]
            )

    following = F.substring("sketch", F.col("tree") * PREFIX + PREFIX + 1, F.lit(32))
    ranged = members.withColumn("following", following).repartitionByRange("key", "following").sortWithinPartitions("key", "following", "node")
    return ranged.select("key", "node", "sketch").mapInArrow(run, "a long, b long, agreeing int").distinct()


def deeper(hot: DataFrame, sketches: DataFrame, branches: int = BRANCHES, values: int = BRANCH_VALUES) -> DataFrame:
    """(key, tree, node, class) rows of dense regions dealt to sub-orders: each looks at further signature values.

    Sketches come from (node, sketch) rows and are left again at once, so that what is stored for each branch is narrow."""
    sub = hot.join(sketches, "node").withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
    sub = sub.withColumn("tree", F.xxhash64("tree", "branch"))
    picked = [F.substring("sketch", F.pmod(F.xxhash64("tree", F.lit(j)), F.lit(VALUES)).cast("int") + 1, F.lit(1)) for j in range(values)]
    return sub.withColumn("key", F.xxhash64("key", "tree", *picked)).select("key", "tree", "node", "class")


def mixed_regions(members: DataFrame) -> DataFrame:
    """(key, members) of the regions that hold more than one class."""
    sized = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("class").alias("low"), F.max("class").alias("high"))
    return sized.filter("low < high").select("key", "members")


def _runs(batches: Iterator[pd.DataFrame], found) -> Iterator[pd.DataFrame]:
    """``found`` of frames that hold whole (key, cell) groups of sorted batches."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < RUN_ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        still_open = (frame["key"] == frame["key"].iloc[-1]) & (frame["cell"] == frame["cell"].iloc[-1])
        ready, rest = frame[~still_open], frame[still_open]
        if len(ready):
            yield found(ready.reset_index(drop=True))
        held, rows = [rest], len(rest)
    if rows:
        yield found(pd.concat(held, ignore_index=True))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unions the labels of the pairs (a, b) of places in ``label``, in place; true for the pairs that joined two."""
    kept = np.zeros(len(a), bool)
    while True:
        apart = np.flatnonzero(label[a] != label[b])
        if not len(apart):
            return kept
        # One pair for each larger label: all of them join at once, each to a smaller label.
        high, low = np.maximum(label[a[apart]], label[b[apart]]), np.minimum(label[a[apart]], label[b[apart]])
        high, first = np.unique(high, return_index=True)
        kept[apart[first]] = True
        target = np.arange(int(label.max()) + 1)
        target[high] = low[first]
        while (target[target] != target).any():
            target = target[target]
        label[:] = target[label]


def _signature_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest (a, b) of the pairs of different classes that agree enough, within each (key, cell)."""

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        fresh = (frame["key"].diff() != 0) | (frame["cell"].diff() != 0)
        region, node, group = fresh.cumsum().to_numpy(), frame["node"].to_numpy(), frame["class"].to_numpy()
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, VALUES)
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        label = np.arange(len(frame))
        at, step = np.arange(len(frame)), 1
        while True:
            at = at[at + step < len(frame)]
            at = at[region[at] == region[at + step]]
            if not len(at):
                break
            open_ = at[(group[at] != group[at + step]) & (label[at] != label[at + step])]
            for i in range(0, len(open_), 65536):
                some = open_[i : i + 65536]
                near = some[(sketch[some] == sketch[some + step]).sum(axis=1) >= LEAST_AGREEING]
                near = near[_joined(label, near, near + step)]
                lefts.append(near), rights.append(near + step)
            step += 1
        return pd.DataFrame({"a": node[np.concatenate(lefts)], "b": node[np.concatenate(rights)]})

    return _runs(batches, found)


def _set_links(percent: int):
    """A spanning forest (a, b) of the linked pairs of different classes within each (key, cell), by the full sets."""

    def cell(node: np.ndarray, group: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in sets])
        values, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        column = np.cumsum(seen > 1) - 1  # shingles of one set only are in no intersection
        common = (seen > 1)[place]
        column, owner = column[place][common], owner[common]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
            lo, hi = np.searchsorted(column, [start, start + MATRIX_COLUMNS])
            matrix = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
            matrix[owner[lo:hi], column[lo:hi] - start] = 1
            both += matrix @ matrix.T  # whole numbers far below 2^24 are exact
        both = both.astype(np.int64)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        a, b = np.nonzero(np.triu(linked & (group[:, None] != group[None, :]), 1))
        keep = _joined(np.unique(group, return_inverse=True)[1].astype(np.int64), a, b)
        return node[a[keep]], node[b[keep]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []

        def done() -> pd.DataFrame:
            rows = {node: (group, np.frombuffer(x, np.uint64)) for node, group, x in held}
            nodes = np.array(list(rows), np.int64)
            a, b = cell(nodes, np.array([rows[n][0] for n in nodes], np.int64), [rows[n][1] for n in nodes])
            return pd.DataFrame({"a": a, "b": b})

        last = None
        for batch in batches:
            for row in zip(batch["key"], batch["cell"], batch["node"], batch["class"], batch["shingles"]):
                if row[:2] != last and held:
                    yield done()
                    held = []
                last = row[:2]
                held.append(row[2:])
        if held:
            yield done()

    return run


def _in_cells(rows: DataFrame, side, columns: list[str]) -> DataFrame:
    """Rows (key, node, ...) dealt to the cells of a grid of ``side`` blocks by hash, sorted for a streaming pass."""
    grid = rows.withColumn("side", side.cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("side")))
    grid = grid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
    cell = F.least("own", "other") * F.col("side") + F.greatest("own", "other")
    dealt = grid.withColumn("cell", cell).select("key", "cell", *columns)
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")


def small_regions(
    members: DataFrame, sketches: DataFrame, region_members: int = REGION_MEMBERS, grid_side: int = GRID_SIDE, most_levels: int = MOST_LEVELS
) -> DataFrame:
    """(key, members, node, class) of regions with more than one class, from (key, tree, node, class) rows and the
    sketches of the nodes.

    Dense regions are grown deeper; one that stays dense over ``most_levels`` is returned as it is.
    """
    small = []
    for level in range(most_levels + 1):
        regions = stored(mixed_regions(members), "minhash-regions")
        here = members.join(regions, "key").select("key", "members", "tree", "node", "class")
        dense = F.col("members") > region_members * grid_side
        if level == most_levels or regions.filter(dense).isEmpty():
            small.append(here)
            break
        small.append(here.filter(~dense))
        members = stored(deeper(here.filter(dense).drop("members"), sketches), "minhash-deeper")
    found = small[0]
    for part in small[1:]:
        found = found.unionByName(part)
    return found.drop("tree")


# ---- classes -------------------------------------------------------------------------------------


def _with_class(rows: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    known = classes.select(F.col("node").alias("__node"), F.col("component").alias("__class"))
    joined = rows.join(known, F.col(node) == F.col("__node"), "left")
    return joined.withColumn(name, F.coalesce("__class", node)).drop("__node", "__class")


def _best(pairs: DataFrame) -> DataFrame:
    """The best pair of each class, as (a, b): most values agree, then smallest nodes."""
    sides = pairs.withColumn("side", F.explode(F.array("ca", "cb")))
    order = F.min(F.struct((-F.col("agreeing")).alias("far"), "a", "b")).alias("best")
    return sides.groupBy("side").agg(order).select("best.a", "best.b").distinct()


def links(
    docs: DataFrame, nodes: DataFrame, shingle_words: int, percent: int, region_members: int, block_members: int, best_rounds: int
) -> DataFrame:
    """(node, component) of all nodes that are linked with another one; ``nodes`` has node, set, code, n_shingles, keys
    and sketch."""
    placed = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    shared = stored(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "minhash-shared")
    placed = stored(placed.join(shared, "key"), "minhash-placed")
    sketches = nodes.select("node", "sketch")
    pending = stored(neighbours(placed.join(sketches, "node")), "minhash-neighbours")

    def sets_of(pairs: DataFrame, without: DataFrame | None = None) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = wanted if without is None else wanted.join(without.select("node"), "node", "left_anti")
        return stored(full_sets(docs, nodes.join(wanted, "node").select("node", "set", "code"), shingle_words), "minhash-sets")

    def classes_with(before: DataFrame, linked: DataFrame) -> DataFrame:
        """Classes (node, component) after links (a, b) of nodes; only classes that change are contracted."""
        ends = _with_class(_with_class(linked, before, "a", "ca"), before, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        grown = stored(connected_components(ends.filter("a <> b").distinct()), "minhash-grown")
        moved = grown.select(F.col("node").alias("component"), F.col("component").alias("to"))
        old = before.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return stored(old.unionByName(grown.join(before.select("node"), "node", "left_anti")), "minhash-classes")

    sets = sets_of(pending)
    checked = None
    classes = nodes.sparkSession.createDataFrame([], "node long, component long")

    for _ in range(best_rounds):
        open_pairs = pending if checked is None else pending.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        open_pairs = _with_class(_with_class(open_pairs, classes, "a", "ca"), classes, "b", "cb").filter("ca <> cb")
        chosen = stored(_best(open_pairs), "minhash-chosen")
        if chosen.isEmpty():
            break
        now = stored(confirmed(chosen, sets, percent), "minhash-checked")
        checked = now if checked is None else checked.unionByName(now)
        linked = now.filter("linked").select("a", "b")
        if linked.isEmpty():
            break
        classes = classes_with(classes, linked)

    members = stored(_with_class(placed.withColumn("tree", F.col("tree").cast("long")), classes, "node", "class"), "minhash-members")
    regions = stored(small_regions(members, sketches, region_members), "minhash-small")
    compared = _in_cells(regions.join(sketches, "node"), F.ceil(F.col("members") / region_members), ["node", "class", "sketch"])
    near = compared.mapInPandas(_signature_links, "a long, b long")
    near = stored(near.distinct(), "minhash-near")
    if near.isEmpty():
        return classes
    sets = sets.unionByName(sets_of(near, sets))
    clumps = connected_components(near).withColumnRenamed("component", "key")
    clumps = clumps.join(nodes.select("node", "n_shingles"), "node")
    clumps = stored(_with_class(clumps, classes, "node", "class"), "minhash-clumps")
    sizes = clumps.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    side = F.greatest(F.ceil(F.col("members") / block_members), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    sized = clumps.join(stored(sizes.select("key", side.alias("blocks")), "minhash-clump-sizes"), "key")
    columns = ["node", "class", "shingles"]
    links_of = _set_links(percent)
    fits = sized.filter(F.col("blocks") <= MOST_BLOCKS).join(sets, "node")
    found = _in_cells(fits, F.col("blocks"), columns).mapInPandas(links_of, "a long, b long")
    large = stored(sized.filter(F.col("blocks") > MOST_BLOCKS).select("node"), "minhash-large")
    if not large.isEmpty():
        there = regions.join(large, "node", "left_semi").join(sets, "node")
        found = found.unionByName(_in_cells(there, F.ceil(F.col("members") / block_members), columns).mapInPandas(links_of, "a long, b long"))
    return classes_with(classes, stored(found, "minhash-found"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, region_members: int = REGION_MEMBERS,
    block_members: int = BLOCK_MEMBERS, best_rounds: int = BEST_ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of ``percent`` or more shared shingles of the union.
    Null, empty and blank texts have no shingles, link with nothing and keep their own doc_id. A row whose doc_id
    is null links its text like any other, and gets the smallest doc_id reachable, null if there is none; it is
    kept only in the latter case. Repeated rows stay rows of one class; rows that repeat a doc_id with another text
    are judged each by its own text. No rows give no rows. Columns other than doc_id and text are ignored.
    """
    found = stored(prints(docs, shingle_words), "minhash-prints")
    nodes = (
        found.filter(F.col("n_shingles") > 0)
        .groupBy("set")
        .agg(F.min("doc_id").alias("rep"), F.min("code").alias("code"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stored(nodes, "minhash-nodes")
    classes = links(docs, nodes, shingle_words, percent, region_members, block_members, best_rounds)
    labelled = _with_class(nodes.select("node", "set", "rep"), classes, "node", "class")
    smallest = labelled.groupBy("class").agg(F.min("rep").alias("component_id"))
    by_set = stored(labelled.join(smallest, "class").select(F.col("set").alias("__set"), "component_id"), "minhash-sets-classes")
    rows = found.select("doc_id", "n_shingles", "set").join(by_set, F.col("set") == F.col("__set"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
