"""Exact top-k by inner product: branch and bound over a ball tree per shard.

Vectors are dealt to shards by a hash of their id, and each shard is built once into a ball tree, stored as one
row. Queries come in blocks. A block meets the shards in waves of growing number; the scores found so far give
every query its current kth score, which the next wave starts from. In a shard, a ball's upper bound is the
product with its centre plus the query's norm times the radius; queries visit leaves from the highest bound on and
stop once the bound cannot beat the kth score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF_ROWS = 128
WAVE_GROWTH = 4
NONE = np.iinfo(np.int64).min


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the shortest integer type that holds them all."""
    for kind in (np.int16, np.int32):
        limit = np.iinfo(kind)
        if vectors.size and limit.min <= vectors.min() and vectors.max() <= limit.max:
            return vectors.astype(kind)
    return vectors


def _matrix(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors): shorter vectors are filled with zeros; of rows repeating an id the smallest vector stays."""
    vectors = np.zeros((len(frame), width), np.int64)
    for row, values in zip(vectors, frame["vector"]):
        row[: len(values)] = values
    ids = frame["vec_id"].to_numpy(np.int64)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; one beyond the range of a long is the nearest long."""
    most = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0))
    if most * max(1, left.shape[1]) < 2**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    limit = np.iinfo(np.int64)
    exact = np.dot(left.astype(object), right.astype(object).T)
    return np.clip(exact, limit.min + 1, limit.max).astype(np.int64)


class BallTree:
    """Nodes hold a range of the vectors, a centre, a radius and the smallest id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, centres: np.ndarray, radii: np.ndarray, least: np.ndarray):
        self.ids, self.vectors, self.nodes, self.centres, self.radii, self.least = ids, vectors, nodes, centres, radii, least

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> "BallTree":
        points = vectors.astype(float)
        order = np.arange(len(ids))
        nodes, centres, radii, least = [], [], [], []
        waiting = [(0, len(ids), -1)]
        while waiting:
            start, stop, parent = waiting.pop()
            own = points[order[start:stop]]
            centre = own.mean(axis=0)
            apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
            place = len(nodes)
            nodes.append([start, stop, -1, -1])
            centres.append(centre)
            radii.append(apart.max())
            least.append(ids[order[start:stop]].min())
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = place
            if stop - start > leaf_rows:  # along the line from the farthest point to the one farthest from it, in halves
                far = own[apart.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                along = np.argsort(own @ (other - far), kind="stable")
                order[start:stop] = order[start:stop][along]
                middle = (start + stop) // 2
                waiting += [(middle, stop, place), (start, middle, place)]
        return BallTree(ids[order], vectors[order], np.array(nodes), np.array(centres), np.array(radii), np.array(least))

    def dump(self) -> bytes:
        return _packed(ids=self.ids, vectors=_narrow(self.vectors), nodes=self.nodes, centres=self.centres, radii=self.radii, least=self.least)

    @staticmethod
    def load(raw: bytes) -> "BallTree":
        with np.load(io.BytesIO(raw)) as held:
            vectors = held["vectors"].astype(np.int64)
            return BallTree(held["ids"], vectors, *(held[name] for name in ("nodes", "centres", "radii", "least")))

    def search(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, kth_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of up to ``k`` vectors per query that may beat its (kth, kth_id); NONE scores fill up."""
        points = queries.astype(float)
        norms = np.sqrt((points**2).sum(axis=1))
        best = np.full((len(ids), k), NONE, np.int64)
        best_id = np.zeros((len(ids), k), np.int64)
        kth, kth_id = kth.copy(), kth_id.copy()

        def bound(node: int, who: np.ndarray) -> np.ndarray:
            reach = norms[who] * (np.sqrt((self.centres[node] ** 2).sum()) + self.radii[node])
            raw = points[who] @ self.centres[node] + norms[who] * self.radii[node] + 1e-9 * reach + 1e-6
            return np.floor(np.where(np.isnan(raw), np.inf, raw))

        def open_(bounds: np.ndarray, node: np.ndarray | int, who: np.ndarray) -> np.ndarray:
            return (bounds > kth[who]) | ((bounds == kth[who]) & (self.least[node] < kth_id[who]))

        leaves, columns = [], []
        waiting = [(0, np.arange(len(ids)))]
        while waiting:
            node, who = waiting.pop()
            bounds = bound(node, who)
            alive = open_(bounds, node, who)
            who, bounds = who[alive], bounds[alive]
            if not len(who):
                continue
            if self.nodes[node][2] < 0:
                column = np.full(len(ids), -np.inf)
                column[who] = bounds
                leaves.append(node)
                columns.append(column)
            else:
                waiting += [(child, who) for child in self.nodes[node][2:]]
        if not leaves:
            return best_id, best
        leaf_of, table = np.array(leaves), np.stack(columns, axis=1)
        ranked = np.argsort(-table, axis=1, kind="stable")
        active = np.arange(len(ids))
        for step in range(len(leaves)):
            choice = ranked[active, step]
            bounds = table[active, choice]
            active = active[(bounds >= kth[active]) & (bounds > -np.inf)]  # later leaves have no higher bound
            if not len(active):
                break
            choice = ranked[active, step]
            going = open_(table[active, choice], leaf_of[choice], active)
            for leaf in np.unique(choice[going]):
                who = active[going & (choice == leaf)]
                start, stop = self.nodes[leaf_of[leaf]][:2]
                scores = products(queries[who], self.vectors[start:stop])
                scores[self.ids[start:stop][None, :] == ids[who][:, None]] = NONE
                all_scores = np.concatenate([best[who], scores], axis=1)
                all_ids = np.concatenate([best_id[who], np.broadcast_to(self.ids[start:stop], scores.shape)], axis=1)
                top = np.lexsort((all_ids, ~all_scores), axis=-1)[:, :k]  # ~x falls as x rises, without overflow
                best[who], best_id[who] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
                last, last_id = best[who, -1], best_id[who, -1]
                better = (last > kth[who]) | ((last == kth[who]) & (last_id < kth_id[who]) & (last > NONE))
                kth[who] = np.where(better, last, kth[who])
                kth_id[who] = np.where(better, last_id, kth_id[who])
        return best_id, best


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of every query with another row.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id that picks the query rows. Ties go
    to the smaller vec_id; fewer candidates give fewer rows. Rows with a null vec_id, a null vector or null or
    non-finite components take no part. Shorter vectors count as filled with zeros, empty ones score zero.
    Rows repeating a vec_id are one, with the smallest vector. Scores beyond a long are the nearest long. No
    rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole_components(F.col("embedding"), scale).alias("vector")
    )
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"),
        F.coalesce(F.sum(queries.cast("long")), F.lit(0)).alias("queries"),
    ).first()
    width, shards, blocks = facts["width"], -(-facts["rows"] // shard_rows), -(-facts["queries"] // block_rows)
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    if shards and blocks:
        trees = stored(_trees(rows, shards, width), "topk-trees")
        asked = rows.filter(queries).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        done, wave = 0, 1
        while done < shards:
            upto = min(shards, done + wave)
            found = _wave(asked, trees, best, (done, upto), shards, width, k)
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            best = stored(best.unionByName(found).withColumn("rank", place).filter(F.col("rank") <= k).drop("rank"), "topk-best")
            done, wave = upto, wave * WAVE_GROWTH
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).select("query_id", "rank", "vec_id", "score")


def _trees(rows: DataFrame, shards: int, width: int) -> DataFrame:
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree.build(*_matrix(frame, width))
        return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "tree": [tree.dump()]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(build, "shard long, tree binary")


def _wave(asked: DataFrame, trees: DataFrame, best: DataFrame, places: tuple[int, int], shards: int, width: int, k: int) -> DataFrame:
    """Hits of every query block in the shards at ``places`` of its own round, which begins at its home shard."""
    last = F.struct("score", (-F.col("vec_id")).alias("back"))
    known = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"), F.min(last).alias("last"))
    known = known.filter(F.col("held") >= k).select(
        F.col("query_id").alias("vec_id"), F.col("last")["score"].alias("kth"), (-F.col("last")["back"]).alias("kth_id")
    )

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ids, matrix = _matrix(frame, width)
        limits = frame.drop_duplicates("vec_id").set_index("vec_id").loc[ids]
        kth = [NONE if pd.isna(x) else int(x) for x in limits["kth"]]
        kth_id = [0 if pd.isna(x) else int(x) for x in limits["kth_id"]]
        raw = _packed(ids=ids, vectors=_narrow(matrix), kth=np.array(kth, np.int64), kth_id=np.array(kth_id, np.int64))
        return pd.DataFrame({"block": frame["block"].iloc[:1].to_numpy(), "queries": [raw]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queries, tree in zip(batch["queries"], batch["tree"]):
                with np.load(io.BytesIO(queries)) as held:
                    ids = held["ids"]
                    found, scores = BallTree.load(tree).search(ids, held["vectors"].astype(np.int64), held["kth"], held["kth_id"], k)
                hit = scores > NONE
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[hit.ravel()], "vec_id": found[hit], "score": scores[hit]})

    # Exact longs on the way: a nullable long column would pass through pandas as a double.
    limited = asked.join(known, "vec_id", "left").withColumns({c: F.col(c).cast("string") for c in ("kth", "kth_id")})
    blocks = limited.groupBy("block").applyInPandas(pack, "block long, queries binary")
    dealt = blocks.withColumn("step", F.explode(F.sequence(F.lit(places[0]), F.lit(places[1] - 1)))).withColumn(
        "shard", F.pmod(F.col("block") + F.col("step"), F.lit(shards)).cast("long")
    )
    # Packed blocks and trees are megabytes a row, of which the size estimates know nothing: neither side may be broadcast.
    return dealt.hint("merge").join(trees.hint("merge"), "shard").select("queries", "tree").mapInPandas(search, "query_id long, vec_id long, score long")
