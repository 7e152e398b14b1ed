from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from ionweave.llm import common
from ionweave.llm import product_quantizer as pq

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """The contract, one number at a time with Python's integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def near(book, x):
        d = [sum((a - b) ** 2 for a, b in zip(c, x)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[near(books[p], cut(v)[p])[0]].append(cut(v)[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(books[p], members)]
    out, sums = [], {}
    for i, v, l in kept:
        found = [near(books[p], x) for p, x in enumerate(cut(v))]
        error = sum(e for _, e in found)
        sums[l] = sums.get(l, 0) + error
        out.append((i, "".join(f"{k:02x}" for k, _ in found), error, l))
    text = ",".join(str(x) for book in books for c in book for x in c)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted((i, c, e, sums[l], digest) for i, c, e, l in out)


def random_rows(seed, n, dim, odd=True):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.3)]) for _ in range(dim)], rng.choice([None, 1, 1, 2])) for i in range(n)]
    if odd:
        rows += [(n, None, 1), (n + 1, [float("nan")] + [0.0] * (dim - 1), 1), (n + 2, [float("-inf")] * dim, None), (-1, [None] + [0.0] * (dim - 1), 2)]
        rows += [(3, rows[5][1], 1), (3, rows[5][1], 1), (n + 3, rows[0][1], None)]
    rng.shuffle(rows)
    return rows


def run(spark, df, tmp_path, name="t"):
    df.write.parquet(str(tmp_path / name / "embeddings.parquet"))
    found = pq.op11_vector_codes(spark, str(tmp_path / name))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("seed,n,dim", [(1, 400, 8), (2, 60, 4), (3, 300, 12)])
def test_query_equals_brute_force(spark, tmp_path, seed, n, dim):
    rows = random_rows(seed, n, dim)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 4, 256, 4)
    assert run(spark, df.repartition(5), tmp_path) == want


@pytest.mark.parametrize("parts,entries,rounds", [(2, 5, 3), (1, 16, 0), (3, 2, 6)])
def test_parameters(spark, parts, entries, rounds):
    rows = random_rows(parts, 150, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    fitted = pq.fit(df, parts=parts, entries=entries, rounds=rounds)
    got = sorted((r.vec_id, r.code.hex(), r.error) for r in pq.encode(fitted).collect())
    want = brute(rows, parts, entries, rounds)
    assert got == [w[:3] for w in want] and fitted.codebooks.sha256() == want[0][4]


def test_same_for_any_partitioning(spark, tmp_path):
    df = spark.createDataFrame(random_rows(9, 200, 8), SCHEMA)
    one = run(spark, df.coalesce(1), tmp_path, "a")
    assert run(spark, df.repartition(7), tmp_path, "b") == one


def test_wide_values_are_computed_in_64_bits():
    rng = np.random.default_rng(0)
    for most in (200, 20_000, pq.MOST):
        block, entries = rng.integers(-most, most + 1, (6, 300)), rng.integers(-most, most + 1, (9, 6))
        index, distance = pq.nearest(pq._narrow(block), entries)
        exact = ((block.T[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_cases(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(spark, empty, tmp_path, "empty") == []
    # another length, an empty vector, a null id, a huge component, columns named as the operator's own
    rows = [(1, [0.0] * 4, 1), (2, [1.0] * 4, 1), (3, [1.0] * 8, 1), (4, [], 1), (None, [1e30] * 4, 2), (5, [0.5] * 3, 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as error", "3 as _label", "'x' as n", "'y' as data")
    df.write.parquet(str(tmp_path / "odd" / "embeddings.parquet"))
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in pq.op11_vector_codes(spark, str(tmp_path / "odd")).collect()}
    assert got == {1: ("00" * 4, 0, 0), 2: ("01" * 4, 0, 0), None: ("02" * 4, 0, 0)}


def test_label_errors_without_broadcast(spark, monkeypatch):
    """Many labels, one of them with most rows, and nulls: the joined sums are those of the groups."""
    rows = [(i, bytes([i % 7]), i % 11, None if i % 5 == 0 else 1 if i % 3 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, code binary, error long, label int")
    want = {}
    for _, _, e, l in rows:
        want[l] = want.get(l, 0) + e
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = pq.label_errors(df).collect()
        assert len(got) == 900 and all(r.label_error == want[r.label] for r in got)


def test_decoding_gives_the_coded_entries(spark):
    rows = random_rows(4, 300, 8, odd=False)
    fitted = pq.fit(spark.createDataFrame(rows, SCHEMA), entries=64)
    coded = pq.encode(fitted)
    errors = {r.vec_id: r.error for r in coded.collect()}
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    for r in pq.decode(coded, fitted.codebooks).collect():
        d = np.floor(by_id[r.vec_id] * 1024) - np.array(r.embedding) * 1024
        assert (d * d).sum() == errors[r.vec_id]
    text = spark.createDataFrame([(f"v{i}", v, str(l)) for i, v, l in rows], "vec_id string, embedding array<double>, label string")
    assert pq.encode(pq.fit(text, entries=8)).count() == 300
