from __future__ import annotations

import random
import re

from ionweave.llm import decontaminate as d

from . import helpers as h


def words(t):
    return [w for w in re.findall(r"[^\W_]+", (t or "").lower())]


def brute(docs, items):
    out = set()
    for i, t in docs:
        dw = words(t)
        for j, u in items:
            iw = words(u)
            k = min(5, len(iw))
            if i is None or j is None or not k:
                continue
            want = {tuple(iw[n : n + k]) for n in range(len(iw) - k + 1)}
            have = {tuple(dw[n : n + k]) for n in range(len(dw) - k + 1)}
            found = len(want & have)
            if found * 5 >= len(want) * 4:
                out.add((i, j, len(want), found))
    return out


def test_contained_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(k, h.prose(rng, n)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 15, 40, 55])] + [(20, None), (21, ""), (22, "... !"), (None, h.prose(rng, 9)), (23, "same same same same same same same")]
    docs = []
    for n, (_, text) in enumerate(items):
        ws = (text or "").split()
        filler = h.prose(rng, rng.randint(0, 400), "bcdfgh")
        docs.append((n, f"{filler} {text or ''} {filler}"))
        docs.append((100 + n, f"{filler}, {(text or '').upper().replace(' ', ',  ')}! {filler}"))
        if len(ws) > 10:
            for changed in (1, 2, 3):
                broken = ws[:]
                for p in range(changed):
                    broken[len(ws) * (p + 1) // (changed + 1)] = "other"
                docs.append((200 + 10 * n + changed, f"{filler} {' '.join(broken)} {filler}"))
            docs.append((400 + n, " ".join(ws[: int(len(ws) * 0.9)])))
    docs += [(900, None), (901, ""), (902, h.prose(rng, 20_000, "xyz") + " " + items[7][1]), (None, items[7][1]), (903, "same same same same same")]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in d.contained(docs_df, items_df).collect()}
    assert got == brute(docs, items)
    assert any(i == 902 for i, *_ in got)
    left = {r.doc_id for r in d.decontaminate(docs_df, items_df).collect()}
    assert left == {i for i, _ in docs if i is not None} - {i for i, *_ in got}


def test_stage_judges_rows(spark):
    """Ids that repeat, with clean and contaminated texts, and missing ids."""
    item = "one two three four five six seven"
    rows = [(5, f"x {item}"), (5, "clean"), (None, item), (None, "clean too"), (5, "clean"), (6, None), (7, item), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in d.decontaminate(docs, items).collect()), key=str)
    assert left == sorted([(5, "clean"), (None, "clean too"), (5, "clean"), (6, None)], key=str)
    assert sorted(tuple(r) for r in d.contained(docs, items).collect()) == [(5, 1, 3, 3), (7, 1, 3, 3)]
    assert d.decontaminate(docs.limit(0), items).collect() == [] and d.decontaminate(docs, items.limit(0)).count() == 8


def test_candidates_keep_every_containment(spark):
    """Items of every size with as many shingles lost as the threshold allows: the estimate's recall is 1."""
    rng = random.Random(3)
    docs, items = [], []
    for n in range(5, 60):
        ws = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(ws)))
        lost = (n - 4) - -(-(n - 4) * 4 // 5)
        docs.append((n, " ".join(ws[: n - lost])))
        docs.append((100 + n, " ".join(ws[rng.randint(0, lost) :])))
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in d.contained(docs_df, items_df).collect()} == brute(docs, items)


def test_repeats_clashes_and_empty(spark):
    text = "one two three four five six seven"
    docs = h.documents(spark, [text, text, "nothing of it"], extra=True).union(h.documents(spark, [text], extra=True))
    items = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "item_id long, text string, doc_id string").drop("doc_id")
    assert sorted(tuple(r) for r in d.contained(docs, items).collect()) == [(0, 1, 3, 3), (1, 1, 3, 3)]
    assert d.contained(docs.limit(0), items).collect() == []
    assert d.contained(docs, items.limit(0)).collect() == []
    assert d.decontaminate(docs, items).columns == docs.columns


def test_main_path_is_native(spark):
    docs, items = h.documents(spark, ["a b c d e f"]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = d.contained(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
