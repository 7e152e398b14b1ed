from __future__ import annotations

import random

import pytest

from ionweave.llm import simhash_dedup as s
from ionweave.llm.common import components

from . import helpers as h

MASK = (1 << 64) - 1


def test_fingerprint_equals_brute_force():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "One", "one two", "a b c d", "ÀÉ Straße İ x\x1cy z\x85w", "X" * 5000, h.prose(rng, 70000)]
    texts += [h.prose(rng, rng.randint(1, 40)) for _ in range(60)]
    for t in texts:
        assert s.fingerprint(None if t is None else t.encode()) == h.simhash(t)
    assert s.fingerprint(b"A\x0bB\rC\x0cD") == s.fingerprint(b"a b  c\td\n")


def _expected(rows):
    known = dict(rows)
    first = {}
    for i, f in sorted(known.items()):
        first.setdefault(f, i)
    by_rep = {i: f for f, i in first.items()}
    found = h.components(by_rep, lambda a, b: h.hamming(by_rep[a], by_rep[b]) <= 4)
    return {i: found[first[f]] for i, f in known.items()}


def fingerprints_with_clusters(rng, clusters=6, size=25, loose=60):
    out = []
    for _ in range(clusters):
        centre = rng.getrandbits(64)
        for _ in range(size):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            out.append(f)
    out += [rng.getrandbits(64) for _ in range(loose)]
    chain = rng.getrandbits(64)
    for k in range(12):  # neighbours in steps of 4 bits
        out.append(chain)
        for b in rng.sample(range(64), 4):
            chain ^= 1 << b
    return out


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("segments", s.LAYOUTS)
@pytest.mark.parametrize("hot", [s.HOT, 3])
def test_links_span_the_components(spark, hot, segments):
    """With ``hot`` 3 nearly every bucket of a cluster is split into blocks."""
    rng = random.Random(hot)
    prints = fingerprints_with_clusters(rng)
    want = h.components({signed(f) for f in prints}, lambda a, b: h.hamming(a & MASK, b & MASK) <= 4)
    nodes = spark.createDataFrame([(f,) for f in want], "fp long")
    got = {r.node: r.component for r in components(s.links(nodes, hot, segments)).collect()}
    assert {f: got.get(f, f) for f in want} == want


def test_layout_follows_the_count_and_covers_the_distance():
    assert s.layout(10**6) == s.LAYOUTS[0] and s.layout(10**12) == s.LAYOUTS[1]
    for segments in s.LAYOUTS:
        assert sum(r + 1 for _, _, r in segments) > s.DISTANCE and sum(w for _, w, _ in segments) == 64
    assert len(s.masks(32, 2)) == 32 + 496 and sorted(s.masks(3, 1)) == [1, 2, 4]


def test_distances_at_the_limit(spark):
    base = 0x0123456789ABCDEF
    for bits in ([0, 1, 2, 3], [0, 20, 21, 41], [0, 21, 42, 63], [20, 22, 43, 44], [42, 43, 62, 63]):
        near = base
        for b in bits:
            near ^= 1 << b
        far = near ^ (1 << 50)
        for other, expected in ((near, 1), (far, 0)):
            nodes = spark.createDataFrame([(base,), (signed(other),)], "fp long")
            assert [min(1, s.links(nodes, segments=x).count()) for x in s.LAYOUTS] == [expected] * 2


def test_documents(spark):
    rng = random.Random(4)
    body = h.prose(rng, 400)
    near = body.replace(body.split()[200], "changed", 1)
    texts = [body, near, body.upper(), None, "", "  \n", h.prose(rng, 300), body, "Solo", "solo"]
    docs = h.documents(spark, texts, extra=True)
    got = {r.doc_id: (r.fp & MASK, r.component_id) for r in s.near_duplicates(docs).collect()}
    prints = [(i, h.simhash(t)) for i, t in enumerate(texts)]
    want = _expected(prints)
    assert got == {i: (f, want[i]) for i, f in prints}
    stay = s.near_dedup(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({want[i] for i, _ in prints})


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e"), (None, "alone here")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in s.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 5)]
    assert s.near_duplicates(docs.limit(0)).collect() == [] and s.near_dedup(docs.limit(0)).collect() == []


def test_stage_leaves_one_row_of_each_component(spark):
    """Ids that repeat, with equal and other texts, and missing ids: rows are judged, not ids."""
    rng = random.Random(11)
    body = h.prose(rng, 300)
    near = body.replace(body.split()[100], "changed", 1)
    other, third = h.prose(rng, 200), h.prose(rng, 200)
    rows = [(1, body), (5, near), (5, other), (None, body), (1, body), (None, third), (None, third), (7, None), (3, ""), (5, other.upper())]
    docs = spark.createDataFrame([(i, t, n % 2) for n, (i, t) in enumerate(rows)], "doc_id long, text string, group int").repartition(4)
    prints = [h.simhash(t) for _, t in rows]
    groups = h.components(range(len(rows)), lambda a, b: h.hamming(prints[a], prints[b]) <= 4)
    stay = [(r.doc_id, r.text) for r in s.near_dedup(docs, 2).collect()]
    assert len(stay) == len(set(groups.values()))
    for root in set(groups.values()):
        own = [rows[n] for n in groups if groups[n] == root]
        kept = [r for r in own if r in stay]
        assert len(set(kept)) == 1 and kept[0][0] == min((i for i, _ in own if i is not None), default=None)


def test_components_on_random_graphs(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]):
        nodes = {x for e in edges for x in e}
        linked = {frozenset(e) for e in edges}
        want = h.components(nodes, lambda a, b: frozenset((a, b)) in linked)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {n: got.get(n, n) for n in nodes} == want
