"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: one 64-bit hash, one
displacement and one compare resolve a whole pre-token.  Tier two merges the
bytes of the others: a heap of adjacent pairs over a doubly linked list, lowest
rank first and leftmost among equals, O(n log n) for a pre-token of n bytes.
Pre-tokens met before are kept in a bounded per-worker memo.

The vocabulary (rank file and split pattern) is a parameter; the built table is
of the vocabulary's size (about 50,000 entries) and is broadcast.

Cases: null or empty text has no ids and decodes to no bytes; texts of any
length are encoded whole; repeated rows are encoded alike; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens kept by a worker before its memo starts anew.
MEMO = 300_000
#: Characters encoded together, and pieces of a longer text taken at a time.
_CHARS = 1 << 21
_PIECES = 1 << 16
_MASK = (1 << 64) - 1
_MIX = (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _place(h: int, shift: int, n: int) -> int:
    x = ((h ^ (shift * _MIX[0])) * _MIX[1]) & _MASK
    return (x >> 32) % n


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: ``n`` keys, ``n`` slots.

    Keys fall into about n/3 groups; the largest first, each group takes the
    first displacement that puts all its keys on free slots.  A group of one key
    stores its slot itself, as a negative number.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = len(ranks)
        self.groups = n // 3 + 1
        self.shift = np.zeros(self.groups, np.int32)
        self.rank = np.zeros(n, np.int32)
        members: dict[int, list[tuple[int, int]]] = {}
        for key, rank in ranks.items():
            h = xxhash.xxh64_intdigest(key)
            members.setdefault(h % self.groups, []).append((h, rank))
        free = bytearray(b"\1") * n
        singles = []
        for group, keys in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(keys) == 1:
                singles.append((group, keys[0][1]))
                continue
            shift = 1
            while True:
                slots = {_place(h, shift, n) for h, _ in keys}
                if len(slots) == len(keys) and all(free[s] for s in slots):
                    break
                shift += 1
            self.shift[group] = shift
            for h, rank in keys:
                slot = _place(h, shift, n)
                free[slot] = 0
                self.rank[slot] = rank
        for (group, rank), slot in zip(singles, (i for i in range(n) if free[i])):
            self.shift[group] = -slot - 1
            self.rank[slot] = rank

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The rank each key has if it is in the vocabulary; the caller compares the bytes."""
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        shift = self.shift[(h % np.uint64(self.groups)).astype(np.int64)].astype(np.int64)
        moved = (h ^ (np.maximum(shift, 0).astype(np.uint64) * np.uint64(_MIX[0]))) * np.uint64(_MIX[1])
        slot = np.where(shift < 0, -shift - 1, ((moved >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64))
        return self.rank[slot]


class Codec:
    """Encoder and decoder of one vocabulary; pickles to its rank table and hash."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.hash = PerfectHash(ranks)
        self.pattern = pattern
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "hash": self.hash, "pattern": self.pattern, "_ready": False}

    def _prepare(self) -> None:
        """Merge table by pairs of ids: every split of a token into two tokens."""
        ranks = {token: rank for rank, token in self.tokens.items()}
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.shift = max(ranks.values()).bit_length()
        self.pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.split, self.pieces = regex.compile(self.pattern).findall, regex.compile(self.pattern).finditer
        self._forget()
        top = max(self.tokens) + 1
        self.spelled_size = np.array([len(self.tokens.get(r, b"")) for r in range(top)], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.spelled = np.frombuffer(b"".join(self.tokens.get(r, b"") for r in range(top)), np.uint8)
        self._ready = True

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: ids of one pre-token that is not in the vocabulary.

        Heap entries are rank * 2^32 + position; a removed byte has id -1.
        """
        pair, shift, n = self.pairs.get, self.shift, len(piece)
        ids = [*map(self.byte.__getitem__, piece)]
        ranks = [pair(a << shift | b, -1) for a, b in zip(ids, ids[1:])]  # of the pair that starts at each position
        heap = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        if not heap:
            return tuple(ids)
        ranks.append(-1)
        heapq.heapify(heap)
        after, before, pop, push = [*range(1, n + 1)], [*range(-1, n - 1)], heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            if ranks[i] != entry >> 32:
                continue  # one of the two was merged meanwhile
            j, rank = after[i], ranks[i]
            ids[i], ids[j], ranks[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                up = ranks[i] = pair(rank << shift | ids[k], -1)
                if up >= 0:
                    push(heap, up << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                up = ranks[h] = pair(ids[h] << shift | rank, -1)
                if up >= 0:
                    push(heap, up << 32 | h)
        return tuple([x for x in ids if x >= 0])

    def _resolve(self, pieces) -> None:
        """Give every piece a place in the memo: its index, and its ids in one flat array."""
        if len(self.memo) > MEMO:
            self._forget()
        new = list(set(pieces).difference(self.memo))
        if not new:
            return
        raw = [piece.encode() for piece in new]
        ids = [(rank,) if self.tokens[rank] == data else self.merge(data) for data, rank in zip(raw, self.hash.candidates(raw).tolist())]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of resolved pieces, one array per list of them."""
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ends = np.concatenate([[0], np.cumsum(self.size[at])])[np.cumsum(counts)]
        return np.split(_ragged(self.flat, self.begin[at], self.size[at]), ends[:-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays; a long text is taken some pieces at a time."""
        if not self._ready:
            self._prepare()
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            if len(texts[at] or "") > _CHARS:
                found = (m[0] for m in self.pieces(texts[at]))
                parts = []
                while pieces := list(islice(found, _PIECES)):
                    self._resolve(pieces)
                    parts += self._ids([pieces])
                out.append(np.concatenate(parts))
                at += 1
                continue
            split, size = [], 0
            while at < len(texts) and size <= _CHARS and len(texts[at] or "") <= _CHARS:
                split.append(self.split(texts[at]) if texts[at] else [])
                size += len(texts[at] or "")
                at += 1
            self._resolve(chain.from_iterable(split))
            out += self._ids(split)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if not self._ready:
            self._prepare()
        return _ragged(self.spelled, self.spelled_at[ids], self.spelled_size[ids]).tobytes()


def _ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin:begin + size] of every pair, joined."""
    total = np.cumsum(size)
    return flat[np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)]


def load_codec(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(read_ranks(path or public_tokenizers.path(VOCABULARY)), pattern)


def _ids_array(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))


def encode_batches(codec: Codec, batches):
    """(doc_id, text) batches to (doc_id, ids) batches."""
    for part in slices(batches, 256):
        yield pa.RecordBatch.from_arrays([part.column(0), _ids_array(codec.encode(part.column(1).to_pylist()))], ["doc_id", "ids"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def decode_batches(codec: Codec, batches):
    """(doc_id, ids) batches to (doc_id, ids, data) batches, data being the decoded bytes."""
    for batch in batches:
        data = pa.array([codec.decode(x) for x in _lists(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["doc_id", "ids", "data"])


def digest_batches(batches):
    """(doc_id, ids, data) batches to (doc_id, n_tokens, ids_sha256, decoded_sha256) batches."""
    for batch in batches:
        ids = _lists(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in batch.column(2).to_pylist()], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    codec = docs.sparkSession.sparkContext.broadcast(load_codec(path, pattern))
    return _texts(docs).mapInArrow(lambda batches: encode_batches(codec.value, batches), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, data): the bytes of every row's ``ids``."""
    codec = encoded.sparkSession.sparkContext.broadcast(load_codec(path))

    def run(batches):
        for batch in decode_batches(codec.value, batches):
            yield batch.select(["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); encodes, decodes and digests in one pass."""
    codec = docs.sparkSession.sparkContext.broadcast(load_codec(path))
    return _texts(docs).mapInArrow(
        lambda batches: digest_batches(decode_batches(codec.value, encode_batches(codec.value, batches))),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids, with the digest of what they decode to."""
    codec = docs.sparkSession.sparkContext.broadcast(load_codec(path))

    def run(batches):
        for batch in decode_batches(codec.value, encode_batches(codec.value, batches)):
            counts = pa.array([len(x) for x in _lists(batch.column(1))], pa.int64())
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, batch.column(1), digests], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_byte_level_bpe": op4_byte_level_bpe}
ORACLE_SQL: dict[str, str] = {}
