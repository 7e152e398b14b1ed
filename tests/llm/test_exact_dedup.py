from __future__ import annotations

import hashlib
import random
import re

import pytest

from ionweave.llm import exact_dedup as e

from . import helpers as h


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        group = [j for (j, _), m in zip(rows, norm) if m == n]
        known = [j for j in group if j is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(group), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in df.collect()], key=str)


@pytest.mark.parametrize("capacity", [e.CAPACITY, 2])
def test_groups_equal_brute_force(spark, capacity):
    rng = random.Random(1)
    texts = [None, "", " ", "a  b", "a\tb", "a b", "a\u00a0b", "a b ", "\x0b\x0c", "A b", "x" * 200_000, "x" * 200_000, "a\x1cb"]
    texts += [rng.choice(["p q", "p  q", "r s", "t"]) for _ in range(40)] + [h.prose(rng, 5) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "a  b"), (None, "only here"), (None, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(e.duplicate_groups(docs, capacity)) == brute(rows)


def test_no_duplicates_and_empty(spark):
    docs = h.documents(spark, ["a", "b"], extra=True)
    assert got(e.duplicate_groups(docs)) == brute([(0, "a"), (1, "b")])
    assert e.duplicate_groups(docs.limit(0)).collect() == []
    assert e.exact_dedup(docs).columns == docs.columns


def test_stage_keeps_the_smallest(spark):
    docs = h.documents(spark, ["a  b", "c", "a b", None, ""], start=10)
    assert sorted(r.doc_id for r in e.exact_dedup(docs).collect()) == [10, 11, 13]


@pytest.mark.parametrize("seed", range(3))
def test_stage_leaves_one_row_of_each_group(spark, seed):
    """Ids that repeat, with equal and other texts, and missing ids: rows are judged, not ids."""
    rng = random.Random(seed)
    texts = ["x", "x ", "x\t", "y  z", "y z", None, "", "unique", "long " * 30_000]
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "x"), (5, "x"), (5, "unique"), (None, "only"), (None, "twice"), (None, "twice")]
    rows += [(rng.choice([None, 1, 2, 3, 4]), rng.choice(texts)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, rng.randint(0, 1), "c") for i, t in rows], "doc_id long, text string, n int, key string").repartition(4)
    stay = [(r.doc_id, r.text) for r in e.exact_dedup(docs, 3).collect()]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in stay) == sorted(set(norm))
    for i, t in stay:
        own = [j for (j, _), m in zip(rows, norm) if m == re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
        assert i == min((j for j in own if j is not None), default=None)
    assert e.exact_dedup(docs.limit(0)).collect() == []


def test_owners_decide_by_their_buckets(spark):
    """Every entry lies in the bucket that the directory names, and look-ups go there."""
    docs = h.documents(spark, [f"t{n % 40}" for n in range(60)])
    index = e.Index(docs, 4)
    entries = index.entries.collect()
    assert len(entries) == 40 and sum(r.n for r in entries) == 60 and len({r.bucket for r in entries}) > 5
    assert {(r.h, r.bucket) for r in index.routed(index.keys.select("h")).collect()} == {(r.h, r.bucket) for r in entries}
    assert index.chains(docs).count() == 20
    assert index.looked_up(index.chains(docs).limit(0)).where("n is not null").count() == 0


def test_directory_doubles_and_covers_all_slots():
    rng = random.Random(3)
    histogram = {}
    for _ in range(500):
        k = rng.randrange(1 << 10) if rng.random() < 0.5 else 7
        histogram[k] = histogram.get(k, 0) + 1
    depth, buckets = e.directory(histogram, 20, 10)
    spans = [(p << (10 - d), (p + 1) << (10 - d)) for p, d in buckets]
    assert spans[0][0] == 0 and spans[-1][1] == 1 << 10 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert depth == max(d for _, d in buckets)
    for (low, high), (_, d) in zip(spans, buckets):
        assert sum(n for k, n in histogram.items() if low <= k < high) <= 20 or d == 10
    assert e.directory({}, 5) == (0, [(0, 0)])


def test_equal_hash_and_other_bytes_stay_apart(spark, monkeypatch):
    """A hash of the length alone: collisions chain by their bytes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(e.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd"), (5, "ef")]
    assert got(e.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
