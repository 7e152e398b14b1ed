"""Communities of a weighted graph by Leiden rounds over blocks of nodes.

A level has three phases.  Local moving: nodes go to the neighbouring community
that raises modularity most; each block of nodes is worked by one task in turn,
seeing the labels of other blocks as they were when the round began, and of the
nodes with links to other blocks about half may move in a round, so neighbours
seldom pass each other.  Refinement: communities are gathered into blocks, and in each single nodes join
well-connected groups they are linked to, which are therefore connected.
Aggregation: groups become the nodes of the next level and start in their
community.  As levels shrink, neighbouring blocks are merged; once one block is
left, a task finishes the hierarchy.

Weights become whole numbers, so sums are exact and the same seed gives the same
communities for any partitioning.  Communities that came out disconnected are
split into their components.  The driver holds one line per block.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..model import number, whole
from ..session import Scratch, cut

#: Links, counted from both ends, that a merged block may have; moving rounds of a level; share of nodes whose moves end them.
BLOCK_LINKS, ROUNDS, _STILL = 100_000, 4, 0.02
#: Weights are multiples of this part.
UNIT = 1 << 20

_STATE = "node long, block long, comm long, strength long, moved boolean"


class _Graph:
    """Links of local nodes 0..n-1: ``inner`` names a local node or is -1, ``outer`` then holds the link's fixed community."""

    def __init__(self, n: int, a: np.ndarray, inner: np.ndarray, outer: np.ndarray, weight: np.ndarray):
        order = np.lexsort((outer, inner, a))
        self.n, self.at = n, np.searchsorted(a[order], np.arange(n + 1)).tolist()
        self.inner, self.outer, self.weight = (x[order].tolist() for x in (inner, outer, weight))


def _move(g: _Graph, comm: list[int], strength: list[int], volume: list[int], total: int, resolution: float, order: np.ndarray, free: list[bool]) -> None:
    """Local moving until no free node gains; ``comm`` and ``volume`` are changed."""
    at, inner, outer, weight = g.at, g.inner, g.outer, g.weight
    queue, waits = deque(order.tolist()), bytearray(b"\1") * g.n
    left = 50 * g.n  # each move gains, so this only guards against rounding
    while queue and left:
        left -= 1
        i = queue.popleft()
        waits[i] = 0
        if not free[i]:
            continue
        links: dict[int, int] = {}
        for j in range(at[i], at[i + 1]):
            t = inner[j]
            c = comm[t] if t >= 0 else outer[j]
            links[c] = links.get(c, 0) + weight[j]
        here, k = comm[i], strength[i]
        part = resolution * k / total
        best, top = here, links.get(here, 0) - part * (volume[here] - k) + 1e-6
        for c, x in links.items():
            gain = x - part * volume[c]
            if c != here and gain > top:
                best, top = c, gain
        if best != here:
            comm[i] = best
            volume[here] -= k
            volume[best] += k
            for j in range(at[i], at[i + 1]):
                t = inner[j]
                if t >= 0 and not waits[t] and comm[t] != best:
                    waits[t] = 1
                    queue.append(t)


def _refine(g: _Graph, comm: list[int], strength: list[int], volume: list[int], total: int, resolution: float, order: np.ndarray) -> list[int]:
    """The group of each local node: connected parts of its community, named by one of their nodes."""
    at, inner, outer, weight = g.at, g.inner, g.outer, g.weight
    group, mass, alone = list(range(g.n)), list(strength), bytearray(b"\1") * g.n
    for i in order.tolist():
        if not alone[i]:
            continue
        links: dict[int, int] = {}
        inside, here, k = 0, comm[i], strength[i]
        for j in range(at[i], at[i + 1]):
            t = inner[j]
            if (comm[t] if t >= 0 else outer[j]) == here:
                inside += weight[j]
                if t >= 0:
                    links[group[t]] = links.get(group[t], 0) + weight[j]
        if inside < resolution * k * (volume[here] - k) / total:
            continue  # not well connected to its community
        best, top = i, 0.0
        for c, x in links.items():
            gain = x - resolution * k * mass[c] / total
            if gain > top:
                best, top = c, gain
        if best != i:
            # alone[i] says that i's group is i itself; the group joined is named by ``best``
            group[i] = best
            mass[best] += k
            alone[i] = alone[best] = 0
    return group


def _connected(n: int, a: np.ndarray, b: np.ndarray, comm: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches within its community."""
    same = comm[a] == comm[b]
    a, b = a[same], b[same]
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _dense(*labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct labels, each array as positions in them)."""
    names, at = np.unique(np.concatenate(labels), return_inverse=True)
    return names, np.split(at, np.cumsum([len(x) for x in labels])[:-1])


def hierarchy(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, strength: np.ndarray, comm: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """All further levels of one graph: a connected community per node, named by its smallest node.  ``a`` and ``b`` list every link both ways."""
    rng = np.random.default_rng(seed)
    total = max(1, int(strength.sum()))
    ends, place = (a, b), np.arange(n)
    size, now, mass = n, np.unique(comm, return_inverse=True)[1], strength.astype(np.int64)
    while True:
        g = _Graph(size, a, b, np.zeros(len(a), np.int64), weight)
        labels, volume = now.tolist(), np.bincount(now, mass, int(now.max(initial=0)) + 1).astype(np.int64).tolist()
        _move(g, labels, mass.tolist(), volume, total, resolution, rng.permutation(size), [True] * size)
        group = _refine(g, labels, mass.tolist(), volume, total, resolution, rng.permutation(size))
        now = np.array(labels, np.int64)
        names, at = np.unique(np.array(group, np.int64), return_inverse=True)
        if len(names) == size:
            break
        place, now = at[place], now[names]
        now = np.unique(now, return_inverse=True)[1]
        mass = np.bincount(at, mass, len(names)).astype(np.int64)
        a, b = at[a], at[b]
        keep = a != b
        pair, index = np.unique(a[keep] * len(names) + b[keep], return_inverse=True)
        weight = np.bincount(index, weight[keep], len(pair)).astype(np.int64)
        a, b, size = pair // len(names), pair % len(names), len(names)
    return _connected(n, *ends, now[place])


def _local(state: pa.Table, links: pa.Table):
    """A block's nodes and links as local numbers: (graph, node, names of communities, own positions, strength, volume)."""
    state = state.sort_by("node")
    node, comm, strength, volume = (state[c].to_numpy() for c in ("node", "comm", "strength", "volume"))
    other, other_comm = links["other"].to_numpy(), links["other_comm"].to_numpy()
    names, (own, outer) = _dense(comm, other_comm)
    a = np.searchsorted(node, links["node"].to_numpy())
    at = np.minimum(np.searchsorted(node, other), len(node) - 1)
    inner = np.where(node[at] == other, at, -1)
    mass = np.zeros(len(names), np.int64)
    mass[outer] = links["other_volume"].to_numpy()
    mass[own] = volume
    return _Graph(len(node), a, inner, outer, links["weight"].to_numpy()), node, names, own, strength, mass


def _hash(values: np.ndarray, salt: int) -> np.ndarray:
    x = (values.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)


def _moved_block(state: pa.Table, links: pa.Table, total: int, resolution: float, seed: int, turn: int) -> pa.Table:
    g, node, names, own, strength, volume = _local(state, links)
    border = np.zeros(g.n, bool)
    border[np.repeat(np.arange(g.n), np.diff(g.at))[np.array(g.inner, np.int64) < 0]] = True
    free = ~border | (_hash(node, turn) % np.uint64(2) == 0)
    labels = own.tolist()
    rng = np.random.default_rng([seed, turn, int(node[0]) & 0xFFFFFFFF])
    _move(g, labels, strength.tolist(), volume.tolist(), total, resolution, rng.permutation(g.n), free.tolist())
    now = np.array(labels, np.int64)
    block = np.full(g.n, state["block"][0].as_py(), np.int64)
    return pa.table([pa.array(x) for x in (node, block, names[now], strength, now != own)], names=["node", "block", "comm", "strength", "moved"])


def _refined_block(state: pa.Table, links: pa.Table, total: int, resolution: float, seed: int) -> pa.Table:
    g, node, _, own, strength, volume = _local(state, links)
    rng = np.random.default_rng([seed, 1 << 20, int(node[0]) & 0xFFFFFFFF])
    group = _refine(g, own.tolist(), strength.tolist(), volume.tolist(), total, resolution, rng.permutation(g.n))
    return pa.table([pa.array(node), pa.array(node[np.array(group, np.int64)])], names=["node", "grp"])


def _apart(links: DataFrame) -> DataFrame:
    """Links with their block under a name of its own, so that they can meet nodes in a cogroup."""
    return links.withColumn("place", F.col("block") + 0).drop("block")


def _seen(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the volume of their community, and links with the community at their other end."""
    volumes = nodes.groupBy("comm").agg(F.sum("strength").alias("volume"))
    state = nodes.select("node", "block", "comm", "strength").join(volumes, "comm")
    ends = state.select(F.col("node").alias("other"), F.col("comm").alias("other_comm"), F.col("volume").alias("other_volume"))
    return state, _apart(links.join(ends, "other"))


def _merged(nodes: DataFrame, links: DataFrame, most: int) -> tuple[DataFrame, DataFrame, int]:
    """``nodes`` and ``links`` with neighbouring blocks merged while their links fit, and the number of blocks."""
    rows = links.select("block").union(nodes.select("block")).groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()  # a line per block
    number, size, names = 0, 0, []
    for r in rows:
        if size and size + r.n > most:
            number, size = number + 1, 0
        size += r.n
        names.append((r.block, number))
    table = F.broadcast(nodes.sparkSession.createDataFrame(names, "block long, _new long"))  # a line per block
    nodes, links = (t.join(table, "block").withColumn("block", F.col("_new")).drop("_new") for t in (nodes, links))
    return nodes, links, number + 1


def _gathered(nodes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Nodes in the block of one of their community's nodes, so that whole communities are refined.

    Where that would fill a block to four times its size, its newcomers stay where they are.
    """
    homes = nodes.groupBy("comm").agg(F.min_by("block", F.xxhash64("node")).alias("home"))
    moved = nodes.join(homes, "comm")
    degrees = links.groupBy("node").agg(F.count("*").alias("n"))
    sizes = moved.join(degrees, "node").groupBy("home").agg(F.sum("n").alias("n")).collect()  # a line per block
    full = [r.home for r in sizes if r.n > 4 * most]
    home = F.when(F.col("home").isin(full), F.col("block")).otherwise(F.col("home")) if full else F.col("home")
    return moved.select("node", home.alias("block"), "comm", "strength")


def _whole_graph(state: pa.Table, links: pa.Table, resolution: float, seed: int) -> pa.Table:
    state = state.sort_by("node")
    node, comm, strength = (state[c].to_numpy() for c in ("node", "comm", "strength"))
    a, b = (np.searchsorted(node, links[c].to_numpy()) for c in ("node", "other"))
    found = hierarchy(len(node), a, b, links["weight"].to_numpy(), strength, comm, resolution, seed)
    return pa.table([pa.array(node), pa.array(node[found])], names=["node", "comm"])


def _split(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comm) with communities split into their connected parts, named by their smallest node."""
    scratch = Scratch(nodes.sparkSession, "split")
    comm = nodes.select("node", "comm")
    same = links.join(comm, "node").join(comm.toDF("other", "_c"), "other").where("comm = _c").select("node", "other")
    same, now = scratch.keep("same", same), scratch.keep("now", nodes.select("node", F.col("node").alias("comm")))
    while True:
        least = same.join(now.toDF("other", "m"), "other").groupBy("node").agg(F.min("m").alias("m"))
        low = now.join(least, "node", "left").select("node", F.least("comm", "m").alias("up"), F.col("comm").alias("was"))
        # one hop through the label found, too
        far = now.toDF("up", "far")
        now = scratch.keep("now", low.join(far, "up").select("node", F.least("up", "far").alias("comm"), "was"))
        moved = now.where("comm <> was").limit(1).count()
        now = now.select("node", "comm")
        if not moved:
            return now


def leiden(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(node, community) of ``edges(a, b, weight)``, pairs of different nodes; equal pairs add up.

    ``nodes(node, block)`` lists every node, an integer, with its block: nodes of a
    block should be near each other, and a block's number next to those of nearby
    blocks.  A community is named by one of its nodes.
    """
    number("resolution", resolution, AnalysisError, above=0)
    whole("seed", seed, AnalysisError, low=0, high=2**32 - 1)
    heavy = F.round(F.col("weight") * F.lit(UNIT)).cast("long")
    once = edges.where("a <> b").select("a", "b", heavy.alias("weight"))
    scratch = Scratch(edges.sparkSession, "leiden")
    links = scratch.keep("links", once.union(once.select("b", "a", "weight")).groupBy(F.col("a").alias("node"), F.col("b").alias("other")).agg(F.sum("weight").alias("weight")).where("weight > 0"))
    strength = links.groupBy("node").agg(F.sum("weight").alias("strength"))
    nodes = nodes.select("node", "block").join(strength, "node", "left").select("node", "block", F.col("node").alias("comm"), F.coalesce("strength", F.lit(0)).alias("strength"))
    total = int(links.agg(F.sum("weight")).first()[0] or 0)
    nodes = cut(nodes)
    lone, nodes = nodes.where("strength = 0").select("node", F.col("node").alias("community")), scratch.keep("nodes", nodes.where("strength > 0"))
    if not total:
        return lone
    places = scratch.keep("places", nodes.select("node", F.col("node").alias("now")))
    links, count, level = scratch.keep("links", links.join(nodes.select("node", "block"), "node")), nodes.count(), 0
    while True:
        nodes, links, blocks = _merged(nodes, links, BLOCK_LINKS)
        if blocks == 1:
            whole_graph = nodes.groupBy("block").cogroup(_apart(links).groupBy("place")).applyInArrow(lambda n, e: _whole_graph(n, e, resolution, seed), "node long, comm long")
            break
        for turn in range(ROUNDS):
            state, seen = _seen(nodes, links)
            turned = level * ROUNDS + turn
            nodes = scratch.keep("nodes", state.groupBy("block").cogroup(seen.groupBy("place")).applyInArrow(lambda n, e: _moved_block(n, e, total, resolution, seed, turned), _STATE))
            if nodes.where("moved").count() <= _STILL * count:
                break
        nodes = scratch.keep("nodes", _gathered(nodes, links, BLOCK_LINKS))
        links = scratch.keep("links", links.drop("block").join(nodes.select("node", "block"), "node"))
        state, seen = _seen(nodes, links)
        groups = scratch.keep("groups", state.groupBy("block").cogroup(seen.groupBy("place")).applyInArrow(lambda n, e: _refined_block(n, e, total, resolution, seed), "node long, grp long"))
        shrunk = groups.select("grp").distinct().count()
        if shrunk > 0.98 * count:
            whole_graph = _split(nodes, links)
            break
        ends = groups.toDF("other", "_to")
        # the nodes of a group share their block, so links keep theirs
        joined = links.join(groups, "node").join(ends, "other").where("grp <> _to")
        links = scratch.keep("links", joined.groupBy(F.col("grp").alias("node"), F.col("_to").alias("other")).agg(F.sum("weight").alias("weight"), F.min("block").alias("block")))
        nodes = nodes.join(groups, "node").groupBy(F.col("grp").alias("node")).agg(F.min("block").alias("block"), F.min("comm").alias("comm"), F.sum("strength").alias("strength"))
        nodes = scratch.keep("nodes", nodes)
        places = scratch.keep("places", places.join(groups.toDF("now", "grp"), "now").select("node", F.col("grp").alias("now")))
        count, level = shrunk, level + 1
    named = whole_graph.select(F.col("node").alias("now"), F.col("comm").alias("community"))
    return places.join(named, "now").select("node", "community").union(lone)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels(node, community)`` on ``edges(a, b, weight)``, each pair once."""
    both = edges.where("a <> b").select("a", "b", "weight").join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    inside, total = both.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.sum("weight")).first()
    ends = both.select(F.col("ca").alias("c"), "weight").union(both.select("cb", "weight")).groupBy("c").agg(F.sum("weight").alias("v"))
    squares = ends.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    return (inside or 0.0) / total - resolution * squares / (4 * total * total) if total else 0.0
