"""Language identification by prediction by partial matching (PPM).

Every language has a context tree over bytes, up to ``ORDER`` bytes deep.  A
context with T symbols seen, D of them distinct, gives a seen byte c/(T+D) and
escapes to the next shorter context with D/(T+D); below the empty context all
256 bytes are equal.  With frozen statistics the code length of a byte depends
only on it and the three bytes before it, so the trees are compiled to tables:
bits per language for every four-byte string seen in training, and for the rest the
escape and the tables of the shorter contexts.  A text's score is its exact
total code length, and the language with the shortest code wins.

Training uses a bounded sample of every language: about ``SAMPLE`` documents,
chosen by a hash of doc_id among the rows with crc32(doc_id as text) mod 5 not 0.
The trees are counted on the executors.  The driver takes the most frequent
four-byte strings of each language, ``GRAMS`` over all languages but at least
``LEAST`` each.  Tables are dense over the strings of ``GROUP`` languages at a time, so
the model takes at most about GRAMS x GROUP x 8 bytes (LEAST times the languages, if
that is more), however many languages there are.

Cases: null texts and texts without a letter are ``und`` with score 0; ties go
to the first language by name; texts of any length are coded whole, in blocks;
rows without doc_id are predicted (held_out null) but not learned from; repeated
rows count and are predicted like others; further columns are ignored; without
training rows everything is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, in_training, read_table, sample_hash, sample_limit, slices

ORDER = 3
SAMPLE = 1500
#: Four-byte strings of all languages that are learned, and least of one language.
GRAMS, LEAST = 1 << 22, 1024
#: Languages whose tables are dense together.
GROUP = 8
_BLOCK = 1 << 19


def _grams(data: np.ndarray) -> np.ndarray:
    """The four-byte string ending at each byte from the fourth, as a number."""
    x = data.astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def count_grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(np.frombuffer(b"\0\0\0" + text, np.uint8)), return_counts=True)


class Slots:
    """Open-addressing index of distinct uint32 keys, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of rivals for one slot the last stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for those that are absent."""
        at = self._home(keys)
        got = self.slot[at]
        open_ = np.flatnonzero((got >= 0) & (self.keys[got] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got[open_] = self.slot[at[open_]]
            left = got[open_]
            open_ = open_[(left >= 0) & (self.keys[left] != keys[open_])]
        return got


def _level(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a level's (context, byte) keys: bits of each, its contexts, and bits of their escapes."""
    context, at = np.unique(keys >> np.uint32(8), return_inverse=True)
    total, distinct = np.bincount(at, counts), np.bincount(at).astype(float)
    return np.log2((total + distinct)[at] / counts), context, np.log2((total + distinct) / distinct), at


class Tables:
    """Compiled context trees of a group of languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        n = len(self.names)
        if not n:
            return
        levels = []  # per language: for orders 3..0 (keys, bits, contexts, escapes)
        for name in self.names:
            keys, seen = counts[name]
            own = []
            for order in range(ORDER, -1, -1):
                mask = np.uint32((1 << 8 * (order + 1)) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
                low, at = np.unique(keys & mask, return_inverse=True)
                bits, context, escape, _ = _level(low, np.bincount(at, seen))
                own.append((low, bits, context, escape))
            levels.append(own)
        self.keys, self.bits, self.contexts, self.escape = [None] * 4, [None] * 4, [None] * 4, [None] * 4
        for order in range(ORDER + 1):
            own = [x[ORDER - order] for x in levels]
            if order == 0:
                keys, contexts = np.arange(256, dtype=np.uint32), np.zeros(1, np.uint32)
            elif order == 1:
                keys, contexts = np.arange(1 << 16, dtype=np.uint32), np.arange(256, dtype=np.uint32)
            else:
                keys = np.unique(np.concatenate([x[0] for x in own]))
                contexts = np.unique(np.concatenate([x[2] for x in own]))
            escape, bits = np.zeros((len(contexts), n), np.float32), np.zeros((len(keys), n), np.float32)
            self.keys[order], self.contexts[order] = Slots(keys), Slots(contexts)
            for i, (low, own_bits, context, esc) in enumerate(own):
                escape[self.contexts[order].find(context), i] = esc
            self.escape[order] = escape
            shorter = self.cost(order - 1, keys & np.uint32((1 << 8 * order) - 1)) if order else np.full((256, n), 8.0)
            bits[:] = escape[self.contexts[order].find(keys >> np.uint32(8))] + shorter
            for i, (low, own_bits, _, _) in enumerate(own):
                bits[self.keys[order].find(low), i] = own_bits
            self.bits[order] = bits

    def cost(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Bits per language of (context, byte) keys of ``order`` context bytes."""
        found = self.keys[order].find(keys)
        out = self.bits[order][found]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            rest = keys[missing]
            at = self.contexts[order].find(rest >> np.uint32(8))
            escape = np.where((at >= 0)[:, None], self.escape[order][at], 0) if len(self.escape[order]) else 0
            out[missing] = escape + self.cost(order - 1, rest & np.uint32((1 << 8 * order) - 1))
        return out


class Ppm:
    """Context trees of several languages, compiled group by group."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        groups = [self.names[i : i + GROUP] for i in range(0, len(self.names), GROUP)]
        self.groups = [Tables({n: counts[n] for n in group}) for group in groups]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Total bits of each text in each language; texts share blocks, long ones span several."""
        out = np.zeros((len(texts), len(self.names)))
        starts, grams, size = [], [], 0
        block = _BLOCK
        for i, text in enumerate(texts):
            data = np.frombuffer(b"\0\0\0" + text, np.uint8)
            for at in range(0, len(data) - 3, block):
                part = _grams(data[at : at + block + 3])
                starts.append((i, size))
                grams.append(part)
                size += len(part)
                if size >= block:
                    self._add(out, starts, grams)
                    starts, grams, size = [], [], 0
        self._add(out, starts, grams)
        return out

    def _add(self, out: np.ndarray, starts: list[tuple[int, int]], grams: list[np.ndarray]) -> None:
        if starts:
            keys, texts, at = np.concatenate(grams), [i for i, _ in starts], [s for _, s in starts]
            for n, group in enumerate(self.groups):
                # a text begins at most one run per call, so its sums add up over calls
                sums = np.add.reduceat(group.cost(ORDER, keys), at, axis=0, dtype=np.float64)
                np.add.at(out[:, n * GROUP : (n + 1) * GROUP], texts, sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and self.names and any(map(str.isalpha, t))]
        if known:
            bits = self.code_lengths([texts[i].encode() for i in known])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for i, b, s in zip(known, best.tolist(), share.tolist()):
                names[i], scores[i] = self.names[b], s
        return names, scores


def train(docs: DataFrame, sample: int = SAMPLE) -> Ppm:
    """Context trees from about ``sample`` training documents of each language."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & in_training(F.col("doc_id")))
    per_language = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    limits = docs.sparkSession.createDataFrame([(r.lang, sample_limit(r.n, sample)) for r in per_language], "lang string, most long")
    limits = F.broadcast(limits) if len(per_language) <= BROADCAST_ROWS else limits
    chosen = known.join(limits, "lang").where(sample_hash(F.col("doc_id")) <= F.col("most"))

    def count(batches):
        for batch in slices(batches):
            seen: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, []).append(b"\0\0\0" + text)
            for lang, texts in seen.items():
                grams = np.concatenate([np.zeros(0, np.uint32)] + [_grams(np.frombuffer(t, np.uint8)) for t in texts if len(t) > 3])
                keys, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    grams = chosen.select(F.col("lang").cast("string"), F.col("text").cast("binary")).mapInArrow(count, "lang string, gram long, n long")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's strings come from its sample, whatever the size of the corpus
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    most = max(LEAST, GRAMS // max(1, len(per_language)))
    table = table.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "gram", "n").toArrow()
    gram, n = (table.column(c).to_numpy() for c in ("gram", "n"))
    lang = table.column("lang").combine_chunks().dictionary_encode()
    at = lang.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(lang.dictionary) + 1))
    own = {name: order[a:b] for name, a, b in zip(lang.dictionary.to_pylist(), bounds, bounds[1:])}
    return Ppm({name: (gram[rows].astype(np.uint32), n[rows].astype(float)) for name, rows in own.items()})


def identify(docs: DataFrame, model: Ppm) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            names, scores = held.value.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
