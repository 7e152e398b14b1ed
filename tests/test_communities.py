"""Neighbour descent and Leiden communities against exact and sequential versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from ionweave.errors import AnalysisError
from ionweave.functions import blocks, descent
from ionweave.operators import analysis as an
from ionweave.operators import communities as co


def cloud(seed, n, latent=6, dims=20, clusters=5):
    """Points near low-dimensional sheets, one for each cluster."""
    rng = np.random.default_rng(seed)
    sheet, centre = rng.normal(size=(clusters, latent, dims)), rng.normal(size=(clusters, dims)) * 4
    c = rng.integers(0, clusters, n)
    return np.einsum("nl,nld->nd", rng.normal(size=(n, latent)), sheet[c]) + centre[c] + rng.normal(size=(n, dims)) * 0.05, c


def frame(spark, x):
    rows = pd.DataFrame({"obs_id": [f"o{i}" for i in range(len(x))], "obs_ord": range(len(x)), "vec": list(x.tolist())})
    return spark.createDataFrame(rows, "obs_id string, obs_ord long, vec array<double>")


def exact(x, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2) if len(x) < 1500 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(int(r.obs_id[1:]), {})[r["rank"]] = (int(r.neighbor[1:]), r.distance)
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(descent, "BUCKET", 128)
    monkeypatch.setattr(descent, "BLOCK", 512)
    monkeypatch.setattr(descent, "_GROUP", 700)


def recall(found, want):
    return np.mean([len({j for j, _ in found[i].values()} & set(want[i])) / len(want[i]) for i in range(len(want))])


def test_descent_finds_the_neighbours(spark, small):
    x, _ = cloud(1, 3000)
    want, d = exact(x, 10)
    points = frame(spark, x)
    found = lists(descent.approximate_knn(points, 10))
    assert recall(found, want) >= 0.95
    assert all(sorted(v) == list(range(1, 11)) and i not in [j for j, _ in v.values()] for i, v in found.items()) and len(found) == 3000
    for i in range(0, 3000, 97):
        away = [found[i][r] for r in range(1, 11)]
        assert [a for _, a in away] == pytest.approx([d[i, j] for j, _ in away], abs=1e-4) == sorted(a for _, a in away)
    seeds, refined = (recall(lists(descent.approximate_knn(points, 10, trees=2, rounds=r)), want) for r in (0, 3))
    assert seeds < 0.85 and refined > 0.98
    assert lists(descent.approximate_knn(points.repartition(7), 10)) == found


def test_few_points_are_compared_exactly(spark):
    x, _ = cloud(2, 300)
    got = lists(descent.approximate_knn(frame(spark, x), 4))
    want, _ = exact(x, 4)
    assert {i: [v[r][0] for r in sorted(v)] for i, v in got.items()} == {i: w.tolist() for i, w in enumerate(want)}
    # the same pairs as the exact operator gives
    plain = lists(an.knn(frame(spark, x), 4))
    assert {i: [j for j, _ in v.values()] for i, v in plain.items()} == {i: [v[r][0] for r in sorted(v)] for i, v in got.items()}


def test_copies_do_not_make_hubs(spark, small):
    x, _ = cloud(3, 1500)
    x[:500] = x[0]
    found = lists(descent.approximate_knn(frame(spark, x), 5))
    assert len(found) == 1500 and all(len(v) == 5 for v in found.values())
    assert all(a == pytest.approx(0, abs=1e-3) for i in range(500) for _, a in found[i].values())
    named = np.bincount([j for i in range(500) for j, _ in found[i].values()], minlength=1500)
    assert named.max() < 100


def test_descent_of_nothing_and_of_one(spark):
    assert descent.approximate_knn(frame(spark, np.zeros((0, 3))), 2).count() == 0
    assert descent.approximate_knn(frame(spark, np.zeros((1, 3))), 2).count() == 0
    assert len(lists(descent.approximate_knn(frame(spark, np.zeros((4, 3))), 9))[0]) == 3
    with pytest.raises(AnalysisError):
        descent.approximate_knn(frame(spark, np.zeros((4, 3))), 0)


# --------------------------------------------------------------------------
# communities


def sequential(n, a, b, w, resolution, seed):
    """Seeded local moving and aggregation until modularity stops rising, on one machine and without refinement."""
    rng = np.random.default_rng(seed)
    labels = np.arange(n)
    while True:
        size = labels.max() + 1
        ends, back = labels[a], labels[b]
        strength = np.bincount(ends, w, size) + np.bincount(back, w, size)
        links = [{} for _ in range(size)]
        for i, j, x in zip(ends.tolist(), back.tolist(), w.tolist()):
            if i != j:
                links[i][j] = links[i].get(j, 0) + x
                links[j][i] = links[j].get(i, 0) + x
        own, volume, total, moved = np.arange(size), strength.copy(), strength.sum(), False
        for _ in range(50):
            changed = 0
            for i in rng.permutation(size).tolist():
                near = {}
                for j, x in links[i].items():
                    near[own[j]] = near.get(own[j], 0) + x
                here = own[i]
                volume[here] -= strength[i]
                gain = {c: x - resolution * strength[i] * volume[c] / total for c, x in near.items()}
                stay = gain.get(here, -resolution * strength[i] * volume[here] / total)
                best = max(sorted(gain), key=lambda c: gain[c], default=here)
                if best != here and gain[best] > stay + 1e-12:
                    own[i], changed = best, changed + 1
                volume[own[i]] += strength[i]
            moved |= bool(changed)
            if not changed:
                break
        if not moved:
            return labels
        labels = np.unique(own, return_inverse=True)[1][labels]


def quality(n, a, b, w, labels, resolution=1.0):
    strength = np.bincount(a, w, n) + np.bincount(b, w, n)
    volume = np.bincount(labels, strength)
    return w[labels[a] == labels[b]].sum() / w.sum() - resolution * (volume**2).sum() / (4 * w.sum() ** 2)


def pieces(a, b, labels):
    """Number of connected parts of the communities."""
    parent = list(range(len(labels)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        if labels[i] == labels[j]:
            parent[find(i)] = find(j)
    return len({find(i) for i in range(len(labels))})


def tables(spark, n, a, b, w, block):
    edges = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "weight": w}))
    return edges, spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "block": np.asarray(block, np.int64)}))


def found(df, n):
    rows = {r.node: r.community for r in df.collect()}
    assert sorted(rows) == list(range(n))
    return np.unique([rows[i] for i in range(n)], return_inverse=True)[1]


def neighbour_graph(n=1500, k=8):
    """k nearest neighbours of points on sheets; blocks are slices along one axis."""
    x, _ = cloud(4, n, latent=4, clusters=8)
    near, d = exact(x, k)
    pairs = {}
    for i in range(n):
        for j in near[i].tolist():
            key = min(i, j), max(i, j)
            pairs[key] = pairs.get(key, 0) + 1 / (1 + d[i, j])
    a, b = np.array(list(pairs)).T
    block = np.argsort(np.argsort(x[:, 0])) * 16 // n
    return n, a, b, np.array(list(pairs.values())), block


@pytest.mark.parametrize("links", [400_000, 6_000])
def test_communities_are_as_good_as_sequential_ones(spark, monkeypatch, links):
    monkeypatch.setattr(co, "BLOCK_LINKS", links)
    n, a, b, w, block = neighbour_graph()
    edges, nodes = tables(spark, n, a, b, w, block)
    best = max(quality(n, a, b, w, sequential(n, a, b, w, 1.0, s)) for s in range(3))
    result = co.leiden(edges, nodes, 1.0, 0)
    labels = found(result, n)
    assert quality(n, a, b, w, labels) >= 0.99 * best
    assert pieces(a, b, labels) == labels.max() + 1
    assert co.modularity(edges, result) == pytest.approx(quality(n, a, b, w, labels), abs=1e-9)
    again = found(co.leiden(edges.repartition(7), nodes.repartition(3), 1.0, 0), n)
    assert (again == labels).all()
    assert found(co.leiden(edges, nodes, 20.0, 0), n).max() > labels.max()


def test_planted_communities_repeats_and_loops(spark):
    """Pairs given twice or in both directions add up; self-loops count for nothing; lone nodes stay alone."""
    a, b = np.array([0, 1, 1, 2, 3, 4, 3, 2, 2]), np.array([1, 0, 2, 0, 4, 5, 5, 3, 2])
    edges, nodes = tables(spark, 8, a, b, np.array([1, 1, 1, 1, 1, 1, 1, 0.1, 0.5]), [0] * 8)
    labels = found(co.leiden(edges, nodes), 8)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1, 2, 3]
    assert found(co.leiden(edges.where("a < 0"), nodes), 8).tolist() == list(range(8))
    for bad in (dict(resolution=0), dict(seed=-1)):
        with pytest.raises(AnalysisError):
            co.leiden(edges, nodes, **bad)


def test_groups_are_connected_and_inside_their_community():
    n, a, b, w, _ = neighbour_graph(400)
    ends = np.concatenate([a, b]), np.concatenate([b, a])
    weight = np.concatenate([w, w]) * 1000
    g = co._Graph(n, ends[0], ends[1], np.zeros(2 * len(a), np.int64), weight.astype(np.int64))
    comm = np.random.default_rng(0).integers(0, 3, n)  # communities that are not connected
    strength = np.bincount(ends[0], weight.astype(np.int64), n).astype(np.int64)
    volume = np.bincount(comm, strength).astype(int).tolist()
    group = np.array(co._refine(g, comm.tolist(), strength.tolist(), volume, int(strength.sum()), 0.2, np.arange(n)))
    assert all(len(set(comm[group == i])) == 1 for i in set(group.tolist())) and len(set(group.tolist())) < n
    assert pieces(a, b, group) == len(set(group.tolist()))


def test_disconnected_communities_are_split(spark):
    a, b = np.array([0, 1, 3, 4, 2, 6]), np.array([1, 2, 4, 5, 3, 7])
    edges, nodes = tables(spark, 8, a, b, np.ones(6), [0] * 8)
    links = edges.selectExpr("a as node", "b as other").union(edges.selectExpr("b", "a"))
    comm = nodes.selectExpr("node", "CASE WHEN node IN (2, 3) THEN 1L WHEN node = 7 THEN 2L ELSE 0L END AS comm")
    assert {r.node: r.comm for r in co._split(comm, links).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}
    assert co._connected(8, a, b, np.array([0, 0, 1, 1, 0, 0, 0, 2])).tolist() == [0, 0, 2, 2, 4, 4, 6, 7]


def test_components_that_become_single_nodes_are_kept(spark, monkeypatch):
    """Cliques apart from each other lose all links when they are aggregated, in blocks of their own."""
    monkeypatch.setattr(co, "BLOCK_LINKS", 20)
    a, b = zip(*[(5 * c + i, 5 * c + j) for c in range(12) for i in range(5) for j in range(i)])
    edges, nodes = tables(spark, 60, np.array(a), np.array(b), np.ones(len(a)), np.arange(60) // 5)
    assert found(co.leiden(edges, nodes), 60).tolist() == [i // 5 for i in range(60)]


def test_a_graph_that_does_not_shrink_ends_with_its_moves(spark, monkeypatch):
    """Blocks that cut every link leave nothing to refine; the moves still stand."""
    monkeypatch.setattr(co, "BLOCK_LINKS", 1)
    a, b = np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7])
    edges, nodes = tables(spark, 8, a, b, np.ones(4), range(8))
    labels = found(co.leiden(edges, nodes), 8)
    assert pieces(a, b, labels) == labels.max() + 1


def test_clusters_of_many_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(co, "BLOCK_LINKS", 4_000)
    x, c = cloud(5, 900, latent=2, clusters=4)
    points = frame(spark, x)
    pairs, near = descent.neighbors(points, 8)
    assert near.select("block").distinct().count() > 1 and near.count() == 900
    edges = an.neighbor_graph(pairs.toDF("obs_id", "rank", "neighbor", "distance"))
    labels = found(co.leiden(edges, near, 0.3, 1), 900)
    assert all(len(set(c[labels == i])) == 1 for i in range(labels.max() + 1))
    assert blocks.BLOCK == 2000
