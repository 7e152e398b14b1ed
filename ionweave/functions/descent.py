"""Approximate nearest neighbours: random-projection buckets, then neighbour descent.

Seeds: ``trees`` trees of random hyperplanes, built on a bounded sample, cut the
points into buckets; within a bucket every pair is compared.  A bucket that came
out too large is dealt at random into several.  Descent: the nearest of a
point and those it is among the nearest of are compared with each other, and
whoever is nearer than a neighbour kept takes its place, until few lists change.

What moves per point and round is its lists and its vector once per block of
nearby points that needs it; blocks and buckets have bounded sizes, so work grows
with the number of points.  Up to ``BUCKET`` points there is one bucket, and the
result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..model import whole
from ..session import Scratch, cut

#: Points compared pair by pair; points of the sample a tree is built on; points of a block in the descent.
BUCKET, SAMPLE, BLOCK = 1024, 32_768, 8192
TREES, ROUNDS = 4, 2
#: Lists are as wide as this at least while they are refined.
WIDTH = 15
#: Points merged in one group, and the share of changed entries at which the descent ends.
_GROUP, _FEW = 8192, 0.01
#: Sample points that a node of a tree needs to be cut.
_LEAST = 16

_LISTS = "node long, block long, near array<long>, away array<double>"


class Tree:
    """Hyperplanes of a complete binary tree, node i having children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        inner = (1 << depth) - 1
        self.plane, self.at = np.zeros((inner, sample.shape[1])), np.full(inner, np.inf)
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = members.pop(node, np.zeros(0, int))
            if len(rows) < _LEAST:
                continue
            a, b = sample[rng.choice(rows, 2, replace=False)]
            plane = a - b if (a != b).any() else rng.normal(size=sample.shape[1])
            side = sample[rows] @ plane
            self.plane[node], self.at[node] = plane, np.median(side)
            right = side > self.at[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, counted from 0."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.plane[node]) > self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed hashes of integers."""
    x = values.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _best(node: np.ndarray, near: np.ndarray, away: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept rows sorted by node and distance, first rows of the nodes) for the ``width`` nearest others of each node.

    Equal distances go by a hash of the pair, so copies of a point don't all name the same few.
    """
    order = np.lexsort((away, near, node))
    n, m = node[order], near[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (n[1:] != n[:-1]) | (m[1:] != m[:-1])
    order = order[fresh & (n != m)]
    order = order[np.lexsort((_mix(near[order] ^ (node[order] << 20), 1), away[order], node[order]))]
    n = node[order]
    first = np.flatnonzero(np.r_[True, n[1:] != n[:-1]][: len(n)])
    rank = np.arange(len(n)) - np.repeat(first, np.diff(np.r_[first, len(n)]))
    order = order[rank < width]
    n = node[order]
    return order, np.flatnonzero(np.r_[True, n[1:] != n[:-1]][: len(n)])


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _lists(node: np.ndarray, near: np.ndarray, away: np.ndarray, block: dict[int, int] | None, width: int) -> pa.Table:
    kept, first = _best(node, near, away, width)
    offsets = pa.array(np.r_[first, len(kept)], pa.int32())
    nodes = node[kept][first]
    blocks = pa.array([block.get(i, -1) for i in nodes.tolist()] if block else np.full(len(nodes), -1), pa.int64())
    arrays = [pa.array(nodes), blocks, pa.ListArray.from_arrays(offsets, pa.array(near[kept])), pa.ListArray.from_arrays(offsets, pa.array(away[kept]))]
    return pa.table(arrays, names=["node", "block", "near", "away"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    vectors = column.to_pylist()
    return np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1).astype(np.float64)


def _distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0))


def _nearest(d: np.ndarray, width: int) -> np.ndarray:
    """Columns of the ``width`` smallest entries of each row, the row itself excluded."""
    np.fill_diagonal(d, np.inf)
    width = min(width, len(d) - 1)
    return np.argpartition(d, width - 1, axis=1)[:, :width] if width < len(d) - 1 else np.argsort(d, axis=1)[:, :width]


def _bucket(table: pa.Table, width: int) -> pa.Table:
    """Every pair of a bucket: each point's nearest."""
    table = table.sort_by("node")
    node = table["node"].to_numpy()
    d = _distances(_matrix(table["vec"]))
    found = _nearest(d, width)
    rows = np.repeat(np.arange(len(node)), found.shape[1])
    return _lists(node[rows], node[found.ravel()], d[rows, found.ravel()], None, width)


def _neighbourhoods(table: pa.Table, width: int) -> pa.Table:
    """(center, block, members) from a group's lists and the reverse links to its nodes.

    Rows with a block are lists; rows without are one reverse link each.
    """
    table = table.sort_by("node")
    values, lengths = _ragged(table["near"])
    away, _ = _ragged(table["away"])
    node, block = table["node"].to_numpy(), table["block"].to_numpy()
    center = np.repeat(node, lengths)
    back = np.repeat(block, lengths) < 0
    kept, _ = _best(center[back], values[back], away[back], width)
    own = np.unique(node[block >= 0])
    centers = np.concatenate([center[~back], center[back][kept], own])
    members = np.concatenate([values[~back], values[back][kept], own])
    pairs = np.unique(np.stack([centers, members], 1), axis=0)
    first = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]][: len(pairs)])
    where = dict(zip(node[block >= 0].tolist(), block[block >= 0].tolist()))
    ids = pairs[first, 0]
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pairs)], pa.int32()), pa.array(pairs[:, 1]))
    return pa.table([pa.array(ids), pa.array([where[i] for i in ids.tolist()], pa.int64()), lists], names=["node", "block", "members"])


def _join(centers: pa.Table, vectors: pa.Table, width: int) -> pa.Table:
    """Members of a neighbourhood compared with each other, for all centers of a block."""
    if not centers.num_rows or not vectors.num_rows:
        return _lists(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)), None, width)
    vectors = vectors.sort_by("member")
    ids, x = vectors["member"].to_numpy(), _matrix(vectors["vec"])
    members, lengths = _ragged(centers.sort_by("node")["members"])
    at = np.searchsorted(ids, members)
    node, near, away, size = [], [], [], 0
    done: list[tuple[np.ndarray, ...]] = []

    def settle() -> None:
        n, m, d = (np.concatenate(v) for v in (node, near, away))
        kept, _ = _best(n, m, d, width)
        done.append((n[kept], m[kept], d[kept]))

    for rows in np.split(at, np.cumsum(lengths)[:-1]):
        if len(rows) < 2:
            continue
        d = _distances(x[rows])
        found = _nearest(d, width)
        left = np.repeat(np.arange(len(rows)), found.shape[1])
        node.append(ids[rows[left]])
        near.append(ids[rows[found.ravel()]])
        away.append(d[left, found.ravel()])
        size += len(left)
        if size > 2_000_000:
            settle()
            node, near, away, size = [], [], [], 0
    if node:
        settle()
    if not done:
        return _lists(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)), None, width)
    return _lists(*(np.concatenate(v) for v in zip(*done)), None, width)


def _merge(table: pa.Table, width: int) -> pa.Table:
    """The lists of a group with those found for them: the nearest of both, and how many are new."""
    table = table.sort_by([("node", "ascending"), ("block", "descending")])
    values, lengths = _ragged(table["near"])
    away, _ = _ragged(table["away"])
    node, block = table["node"].to_numpy(), table["block"].to_numpy()
    owner, old = np.repeat(node, lengths), np.repeat(block, lengths) >= 0
    merged = _lists(owner, values, away, dict(zip(node[block >= 0].tolist(), block[block >= 0].tolist())), width)
    now, n = _ragged(merged["near"])
    key = lambda a, b: _mix(a, 2) ^ _mix(b, 3)
    new = ~np.isin(key(np.repeat(merged["node"].to_numpy(), n), now), key(owner[old], values[old]))
    changed = np.add.reduceat(new.astype(np.int64), np.r_[0, np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
    return merged.append_column("changed", pa.array(changed))


def _grouped(lists: DataFrame, groups: int) -> DataFrame:
    return lists.withColumn("grp", F.pmod(F.xxhash64("node"), F.lit(groups)))


def _prepared(points: DataFrame, n: int, trees: int, seed: int) -> DataFrame:
    """(node, vec, leaf array, block): float32 vectors, a leaf per tree, and the block of the first tree."""
    limit = (1 << 63) - 1 if n <= SAMPLE else SAMPLE * ((1 << 63) - 1) // n
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("obs_ord").cast("long"), F.lit(seed)), 1) <= F.lit(limit)
    sample = points.where(drawn).select(F.col("obs_ord").cast("long").alias("node"), "vec").toArrow().sort_by("node")
    x = sample["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(sample.num_rows, -1)
    del sample
    depth = max(0, math.ceil(math.log2(n / BUCKET)))
    rng = np.random.default_rng(seed)
    forest = [Tree(x, depth, rng) for _ in range(trees if depth else 1)]
    up = max(0, depth - max(0, int(math.log2(BLOCK / BUCKET))))  # levels above a block of about BLOCK points
    sent = points.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            leaves = np.stack([tree.leaf(v) for tree in sent.value], 1)
            offsets = pa.array(np.arange(len(v) + 1) * leaves.shape[1], pa.int32())
            rows = [r.tobytes() for r in v.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(leaves.ravel())), pa.array(leaves[:, 0] >> (depth - up))], ["node", "vec", "leaf", "block"])

    return cut(points.select(F.col("obs_ord").cast("long").alias("node"), "vec").mapInArrow(run, "node long, vec binary, leaf array<long>, block long"))


def _parts(sizes: dict[tuple, int], most: int) -> dict[tuple, int]:
    return {k: -(-n // most) for k, n in sizes.items() if n > most}


def _dealt(df: DataFrame, keys: list[str], parts: dict[tuple, int], seed: int) -> DataFrame:
    """``df`` with ``part``: 0, or one of the parts of an oversized key, by a hash of the node."""
    if not parts:
        return df.withColumn("part", F.lit(0).cast("long"))
    rows = [(*k, n) for k, n in parts.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join(f"{k} long" for k in keys) + ", _n long")
    mixed = df.join(F.broadcast(table), keys, "left")  # at most a line per leaf of the trees
    return mixed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed), *keys), F.coalesce("_n", F.lit(1)))).drop("_n")


def approximate_knn(points: DataFrame, k: int, seed: int = 0, trees: int = TREES, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """(obs_id, rank, neighbor, distance): the k nearest others of most points by Euclidean distance, as ``knn``."""
    pairs, _ = neighbors(points, k, seed, trees, rounds, width)
    ids = points.select(F.col("obs_ord").cast("long").alias("node"), "obs_id")
    named = pairs.join(ids, "node").join(ids.toDF("other", "neighbor"), "other")
    return named.select("obs_id", "rank", "neighbor", "distance")


def neighbors(points: DataFrame, k: int, seed: int = 0, trees: int = TREES, rounds: int = ROUNDS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """((node, rank, other, distance), (node, block)): neighbours found, and blocks of nearby points.

    ``points(obs_id, obs_ord, vec)``; obs_ord is an integer of its own for every
    point and names its node.  A seed gives the same result for any partitioning.
    The buckets of one tree share no neighbours, so the descent needs two trees or more.
    """
    whole("k", k, AnalysisError)
    whole("trees", trees, AnalysisError)
    whole("rounds", rounds, AnalysisError, low=0)
    n = points.count()
    width = max(width, k)
    if n < 2:
        none = points.sparkSession.createDataFrame([], "node long, rank int, other long, distance double")
        return none, points.select(F.col("obs_ord").cast("long").alias("node"), F.lit(0).cast("long").alias("block"))
    made = _prepared(points, n, trees, seed)
    groups = max(1, -(-n // _GROUP))

    leaves = made.select("node", "vec", F.posexplode("leaf").alias("tree", "leaf")).withColumn("tree", F.col("tree").cast("long"))
    sizes = {(r.tree, r.leaf): r["count"] for r in leaves.groupBy("tree", "leaf").count().collect()}  # a line per leaf
    buckets = _dealt(leaves, ["tree", "leaf"], _parts(sizes, 2 * BUCKET), seed)
    seeds = buckets.groupBy("tree", "leaf", "part").applyInArrow(lambda t: _bucket(t, width), _LISTS)
    sizes = {(r.block,): r["count"] for r in made.groupBy("block").count().collect()}
    blocked = _dealt(made.select("node", "block"), ["block"], _parts(sizes, 2 * BLOCK), seed)
    # block and part as one number, as lists carry it
    blocked = blocked.select("node", (F.col("block") * F.lit(1 << 20) + F.col("part")).alias("block"))
    empty = F.array().cast("array<long>"), F.array().cast("array<double>")
    own = blocked.select("node", "block", empty[0].alias("near"), empty[1].alias("away"))
    merged = f"{_LISTS}, changed long"
    scratch = Scratch(points.sparkSession, "descent")
    lists = scratch.keep("lists", _grouped(seeds.union(own), groups).groupBy("grp").applyInArrow(lambda t: _merge(t, width), merged))

    vectors = made.select(F.col("node").alias("member"), "vec")
    for _ in range(rounds if n > BUCKET else 0):
        links = lists.select("node", F.posexplode("near").alias("at", "other"), "away")
        back = links.select(F.col("other").alias("node"), F.lit(-1).cast("long").alias("block"), F.array("node").alias("near"), F.array(F.get("away", F.col("at"))).alias("away"))
        around = _grouped(lists.drop("changed").union(_nearest_links(back, width)), groups)
        centers = scratch.keep("centers", around.groupBy("grp").applyInArrow(lambda t: _neighbourhoods(t, width), "node long, block long, members array<long>"))
        needed = centers.select(F.col("block").alias("place"), F.explode("members").alias("member")).distinct().join(vectors, "member")
        found = centers.groupBy("block").cogroup(needed.groupBy("place")).applyInArrow(lambda c, v: _join(c, v, width), _LISTS)
        lists = scratch.keep("lists", _grouped(lists.drop("changed").union(found), groups).groupBy("grp").applyInArrow(lambda t: _merge(t, width), merged))
        if (lists.agg(F.sum("changed")).first()[0] or 0) <= _FEW * n * width:
            break

    pairs = lists.select("node", F.slice("near", 1, k).alias("near"), "away").select("node", F.posexplode("near").alias("at", "other"), "away")
    return pairs.select("node", (F.col("at") + 1).alias("rank"), "other", F.get("away", F.col("at")).alias("distance")), lists.select("node", "block")


def _nearest_links(back: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest reverse links of every node; limited before the shuffle, so a hub's links do not meet in one task."""
    order = Window.partitionBy("node").orderBy(F.get("away", F.lit(0)), F.xxhash64(F.col("node"), F.get("near", F.lit(0))))
    return back.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r")
