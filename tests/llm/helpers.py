"""Tables and brute-force versions that several tests share."""

from __future__ import annotations

import random

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHES = {c: "clash" for c in ("h", "n", "fp", "rep", "a", "b", "norm", "score", "ids", "kept", "path", "line", "key", "block", "words", "base", "span", "item_id", "quality", "rate")}


def prose(rng: random.Random, n: int, letters: str = "aeioulnrst") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, texts, start: int = 0, extra: bool = False):
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    return df


def simhash(text: str | None) -> int:
    words, out = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if out:
                words.append(out)
            out = ""
        else:
            out += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if out:
        words.append(out)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(nodes, linked) -> dict:
    """Smallest reachable node per node, by brute force over all pairs."""
    nodes = sorted(nodes)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def hamming(a: int, b: int) -> int:
    return int(np.bitwise_count(np.uint64(a) ^ np.uint64(b)))
