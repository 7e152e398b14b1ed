from __future__ import annotations

import random
import re

import corpus_pipeline
from ionweave.llm import quality, registry

from . import helpers as h
from .test_models import corpus


def test_stages_take_effect(spark, tmp_path):
    texts, labels = corpus(200)
    rng = random.Random(9)
    passage = h.prose(rng, 40)
    good = [i for i, y, _ in labels if y]
    texts += [texts[good[0]].replace(" ", "  "), h.prose(rng, 300) + " " + passage]
    body = h.prose(rng, 500)
    texts += [body, body.replace(body.split()[250], "other", 1), None, ""]
    docs = h.documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = {r.doc_id for r in now.collect()}
        assert now.columns == docs.columns or name == corpus_pipeline.STAGES[-1][0]
    bad = {i for i, y, _ in labels if not y}
    assert len(seen["quality"] & bad) < len(bad) * 0.2 and len(seen["quality"] & set(good)) > 0.9 * len(good)
    assert 200 in seen["quality"] and 200 not in seen["exact_dedup"]
    assert 203 in seen["exact_dedup"] and 203 not in seen["near_dedup"] and 202 in seen["near_dedup"]
    assert 201 in seen["near_dedup"] and seen["near_dedup"] - seen["decontaminate"] == {201}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["byte_bpe"]


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_null_and_repeated_ids_against_brute_force(spark, tmp_path):
    """Each stage by rows: what the classifier keeps, one of equal texts, one of a component, nothing with an item."""
    texts, labels = corpus(120)
    rng = random.Random(12)
    passage = h.prose(rng, 30)
    body = h.prose(rng, 300)
    near = body.replace(body.split()[150], "other", 1)
    rows = [(i, t) for i, t in enumerate(texts)]
    for text in (body, near, body + " ", h.prose(rng, 50) + " " + passage, h.prose(rng, 60), None, ""):
        rows += [(rng.choice([None, 3, 500]), text) for _ in range(3)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", n) for n, (i, t) in enumerate(rows)], h.DOCS + ", key string, fp int").repartition(4)
    where = tables(spark, tmp_path, docs, labels, [(1, passage), (None, body), (2, None)])
    model = quality.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    ids_of = quality.Indicators()
    now, docs_now = [t or "" for _, t in rows], docs

    def texts_of(frame):
        return sorted((r.text or "") for r in frame.collect())

    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t)

    stages = dict(corpus_pipeline.STAGES)
    docs_now = stages["quality"](spark, docs_now, where)
    now = [t for t in now if model.score(ids_of(t.encode())) >= quality.THRESHOLD]
    assert texts_of(docs_now) == sorted(now) and docs_now.columns == docs.columns
    docs_now = stages["exact_dedup"](spark, docs_now, where)
    now = texts_of(docs_now)
    assert sorted(map(norm, now)) == sorted({norm(t) for t in map(norm, (r.text or "" for r in stages["quality"](spark, docs, where).collect()))})
    docs_now = stages["near_dedup"](spark, docs_now, where)
    prints = [h.simhash(t) for t in now]
    groups = h.components(range(len(now)), lambda a, b: h.hamming(prints[a], prints[b]) <= 4)
    left = texts_of(docs_now)
    assert len(left) == len(set(groups.values())) and len({groups[now.index(t)] for t in left}) == len(left)
    docs_now = stages["decontaminate"](spark, docs_now, where)
    assert texts_of(docs_now) == sorted(t for t in left if f" {passage} " not in f" {t} ") and len(texts_of(docs_now)) < len(left)
    assert stages["byte_bpe"](spark, docs_now, where).count() == docs_now.count() == corpus_pipeline.run(spark, where).count()


def test_empty_tables(spark, tmp_path):
    docs = h.documents(spark, ["a b c", None, "a  b c"])
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", docs.limit(0), [], [])).count() == 0
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", docs, [], [])).count() == 2


def test_registry_has_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 13))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
