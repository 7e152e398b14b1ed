from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ionweave.llm import packing as p

from . import helpers as h

PATH = public_tokenizers.path(p.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def library(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(2)
    letters = " \t\n\r\x0b\x0c\x00\x1c\x85 　abcXYZßΣİé漢字'’12½٣!?$.,\"()[]🎉́st'll<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1200)]
    return [*texts, None, "", "<|endoftext|>", "a" * 3000, '("Word.") it\'s (DON\'T)', h.prose(rng, 9000), " é ́e "]


def test_ids_equal_the_library(tokenizer, monkeypatch):
    texts = odd_texts()
    want = [library(tokenizer, t) for t in texts]
    assert [i.tolist() for i in p.WordIds(PATH).encode(texts)] == want
    monkeypatch.setattr(p, "MEMO", 10)
    words = p.WordIds(PATH)
    assert [i.tolist() for t in texts for i in words.encode([t])] == want
    assert [i.tolist() for i in words.encode(texts)] == want
    words.known = False
    assert [i.tolist() for i in words.encode(texts)] == want


def test_simple_texts_are_cut_as_the_library_does(tokenizer):
    rng = random.Random(5)
    simple = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
    letters = simple * 2 + list("\'\'\'sStTmMdDlLvVrReE") * 8 + [" "] * 40
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(4000)]
    words = p.WordIds(PATH)
    assert words.known and all(re.match(words.SIMPLE.replace("z", "Z"), t) for t in texts)
    assert [i.tolist() for i in words.encode(texts)] == [library(tokenizer, t) for t in texts]


def naive_first_fit(sizes, room):
    free, out = [], []
    for s in sizes:
        b = next((i for i, f in enumerate(free) if f >= s), len(free))
        if b == len(free):
            free.append(room)
        free[b] -= s
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_tree_finds_the_first_bin_and_cuts_are_exact(seed):
    rng = random.Random(seed)
    room = rng.choice([1, 7, 64, 100])
    sizes = sorted((rng.randint(1, room) for _ in range(rng.randint(0, 80))), reverse=True)
    assert p.first_fit(sizes, room) == naive_first_fit(sizes, room)
    placed = p.pack_sizes(sizes, room)
    covered, filled = defaultdict(list), defaultdict(list)
    for piece, start, n, sequence, offset in placed:
        covered[piece].append((start, n))
        filled[sequence].append((offset, n))
    for parts, whole in [(covered, sizes), (filled, None)]:
        for key, spans in parts.items():
            spans.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
            total = sum(n for _, n in spans)
            assert total == whole[key] if whole else total == room or total & (total - 1) == 0
    assert len(covered) == len(sizes) and sum(sum(n for _, n in s) == room for s in filled.values()) >= sum(sizes) // room


def check(rows, docs, tokenizer, room):
    """Pieces hold every id of every row once, sequences are gapless and need no padding."""
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple([*library(tokenizer, text), p.END])] += 1
    left = defaultdict(list)
    filled = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        left[r.doc_id, r.doc_tokens].append((r.start, ids))
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        total = sum(n for _, n in spans)
        assert total == room or total < room and total & (total - 1) == 0
    for (doc_id, ids), times in want.items():
        parts = left[doc_id, len(ids)]
        for _ in range(times):
            at = 0
            while at < len(ids):
                found = next(x for x in parts if x[0] == at and tuple(x[1]) == ids[at : at + len(x[1])])
                parts.remove(found)
                at += len(found[1])
    assert not any(left.values())


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 50, "", "c" * 9, "d" * 9, "e" * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    parts = [b.column(0).to_pylist() for b in p._bounded([batch, batch.slice(0, 0)], 20)]
    assert sum(parts, []) == list(range(7)) and all(len(x) == 1 or sum(len(texts[i] or "") for i in x) <= 20 for x in parts)


@pytest.mark.parametrize("room,group_rows", [(64, 2048), (64, 40), (4096, 100)])
def test_pack(spark, tokenizer, room, group_rows):
    rng = random.Random(room)
    texts = [h.prose(rng, rng.randint(0, 300)) for _ in range(150)] + ["copy of it"] * 90 + odd_texts()[-8:]
    df = h.documents(spark, texts, extra=True)
    df = df.unionByName(df.where("doc_id < 3")).unionByName(df.where("doc_id < 2").selectExpr("null as doc_id", *[c for c in df.columns if c != "doc_id"]))
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    check(p.pack(df.repartition(3), room=room, group_rows=group_rows).collect(), docs, tokenizer, room)


def test_equal_rows_spread_over_groups_and_order_does_not_matter(spark):
    rows = [(1, "same words again and again")] * 600 + [(i, f"text {i}") for i in range(300)]
    schema = "doc_id long, text string"
    a, b = (p.pack(spark.createDataFrame(x, schema).coalesce(1), room=32, group_rows=30) for x in (rows, rows[::-1]))
    pieces = [sorted(map(tuple, x.collect())) for x in (a, b)]
    assert pieces[0] == pieces[1]
    groups = 30
    per_group = Counter(r[4] % groups for r in pieces[0])
    assert len(per_group) == groups and max(per_group.values()) < 120


def test_sequences_are_whole(spark, tokenizer):
    docs = h.documents(spark, [h.prose(random.Random(i), 40) for i in range(30)])
    pieces = p.pack(docs, room=128).cache()
    rows = p.sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.length and r.starts[0] == 0 and len(r.starts) == len(r.doc_ids) for r in rows)
    ids = [i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert sorted(ids) == sorted(i for r in docs.collect() for i in [*library(tokenizer, r.text), p.END])
    pieces.unpersist()


def test_empty_and_text_ids(spark):
    assert p.pack(spark.createDataFrame([], h.DOCS)).count() == 0
    one = p.pack(spark.createDataFrame([("a", None)], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [("a", 0, 1, 1, 0)]


def test_query_columns(spark, tmp_path, tokenizer):
    h.documents(spark, ["one two", None]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = p.op12_packing(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert list(rows[0].asDict()) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = [*library(tokenizer, "one two"), p.END]
    assert [r.ids_crc32 for r in rows if r.doc_id == 1] == [zlib.crc32(np.array([p.END], "<u4").tobytes())]
    assert sum(r.length for r in rows if r.doc_id == 0) == len(ids)
