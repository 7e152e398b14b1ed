"""Packing of tokenised documents into sequences of one length.

Documents are tokenised once, cut at multiples of the sequence length, and the
pieces dealt at random into groups of bounded size, each packed by itself:
first-fit decreasing, where a tournament tree over the bins' free room finds the
first bin that takes a piece in O(log bins).  What first-fit leaves free is then
filled by cutting pieces of the emptiest bins, and the group's last tokens become
sequences of powers of two, which need no padding.

A piece's group follows from a hash of its row's content, of the partition it
was read from and of how often that row was seen there before, so equal rows
spread over all groups, and a task that runs again deals alike whatever the order
of its rows.

Cases: null or empty text is the end id alone; any id, null or repeated too, is
carried along and rows with it are packed one by one; equal lengths are packed in
order of their hash; texts of any length are tokenised whole; further columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _ragged
from .common import read_table

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END = 2
#: Documents and bytes of text that a group holds on average.
GROUP_ROWS = 2048
GROUP_BYTES = 1 << 24
#: Words kept by a worker in each of two memos.
MEMO = 450_000
#: Bytes of text cut together, new words that go to the library together, and pieces in one Arrow batch.
_BYTES = 1 << 24
_WORDS = 8192
_PIECES = 1024


class _Memo(dict):
    """Gives every word not met before the next number and notes it in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of whole texts by the library, which sees every word once.

    The vocabulary's normaliser and splitter never join what ASCII white space
    parts, so a text's ids are those of its words, one after the other.  A text of
    ASCII and Latin letters only is normalised by lower-casing it, and ``SPLIT``
    cuts its words as the vocabulary's own pattern does; new ones of these pieces go
    to the library as one text, where the suffix of a piece's last token parts them.
    Arrow finds repeats, so the memo is asked once for each distinct word of a batch.
    Texts with other characters or special tokens are cut at white space only.
    A vocabulary that splits otherwise gets whole texts.

    Two generations of words are kept: a full memo becomes the old one, from which
    words still in use are copied.
    """

    SIMPLE = r"^[\t\n\r -~À-ÖØ-öø-ÿ]*\z"
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+").findall
    #: How the vocabulary normalises and splits.
    NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as lines:
            form = json.load(lines)
        splits = ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.known = (form.get("normalizer") or {}).get("normalizers") == self.NORMALIZER and splits.get("pattern") == {"Regex": self.PATTERN} and form["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"] for t in form.get("added_tokens", [])]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.memo = _Memo()
        self._turn()

    def _turn(self) -> None:
        """Start an empty memo and keep the last one as the old."""
        self.old = (self.memo, self.begin, self.size, self.flat) if self.memo else (self.memo, *[np.zeros(0, np.int64)] * 3)
        self.memo = _Memo()
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words; those met for the first time wait in ``memo.new``."""
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def _put(self, at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Note the ids of the words numbered ``at``, one after the other."""
        more = np.zeros(len(self.memo) - len(self.size), np.int64)
        self.begin, self.size = np.concatenate([self.begin, more]), np.concatenate([self.size, more])
        self.begin[at], self.size[at] = len(self.flat) + np.cumsum(size) - size, size
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def _learn(self, cut: bool) -> None:
        """Get the ids of the words that wait; ``cut`` says that they are lower-cased words of simple texts, for SPLIT."""
        new, self.memo.new = self.memo.new, []
        old, *arrays = self.old
        at = np.fromiter((old.get(w, -1) for w in new), np.int64, len(new))
        numbers, again = self._numbers(new), at >= 0
        self._put(numbers[again], arrays[1][at[again]], _ragged(arrays[2], arrays[0][at[again]], arrays[1][at[again]]))
        fresh = [w for w, k in zip(new, again.tolist()) if not k]
        if not cut:
            parted = (fresh[i : i + _WORDS] for i in range(0, len(fresh), _WORDS))
            found = [np.array(e.ids, np.uint32) for words in parted for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            self._put(numbers[~again], np.fromiter(map(len, found), np.int64, len(found)), np.concatenate([*found, self.flat[:0]]))
            return
        pieces = list(map(self.SPLIT, fresh))
        several = [p for p in pieces if len(p) != 1]
        parts = self._numbers(list(chain.from_iterable(several)))  # which may be new themselves, and are then whole
        single = [p[0] for p in pieces if len(p) == 1] + self.memo.new
        single, self.memo.new = list(dict.fromkeys(single)), []
        single = [w for w in single if not self._known(w)]
        if single:
            parted = (" ".join(single[i : i + _WORDS]) for i in range(0, len(single), _WORDS))
            ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32) for text in parted])
            self._put(self._numbers(single), np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0), ids)
        if several:
            sizes = np.r_[0, np.cumsum(self.size[parts])]
            ends = np.cumsum(np.fromiter(map(len, several), np.int64, len(several)))
            whole = self._numbers([w for w, p in zip(fresh, pieces) if len(p) != 1])
            self._put(whole, np.diff(sizes[ends], prepend=0), _ragged(self.flat, self.begin[parts], self.size[parts]))

    def _known(self, word: str) -> bool:
        number = self.memo[word]
        return number < len(self.size) and self.size[number] > 0

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """uint32 ids of whole texts, without special tokens."""
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts).fill_null("")
        if not self.known:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        if len(self.memo) > MEMO:
            self._turn()
        simple = pc.match_substring_regex(texts, self.SIMPLE)
        for token in self.special:
            simple = pc.and_not(simple, pc.match_substring(texts, token))
        out: list = [None] * len(texts)
        for kind, rows in ((True, simple), (False, pc.invert(simple))):
            found = texts.filter(rows)
            words = pc.ascii_split_whitespace(pc.utf8_lower(found) if kind else found)
            coded = words.flatten().dictionary_encode()
            numbers = self._numbers(coded.dictionary.to_pylist())
            self._learn(kind)
            at = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else numbers
            ends = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))
            for i, part in zip(np.flatnonzero(rows.to_numpy(zero_copy_only=False)).tolist(), np.split(at, ends)):
                out[i] = _ragged(self.flat, self.begin[part], self.size[part])
        return out


def first_fit(sizes: list[int], room: int) -> list[int]:
    """The bin of each size, first-fit in the order given; every size is at most ``room``.

    ``free[1]`` is the root, ``free[leaves + b]`` the room left in bin b, and each
    inner node the larger of its two children.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    free, out = [room] * (2 * leaves), []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out.append(node - leaves)
        free[node] -= size
        while node > 1:
            node //= 2
            top = max(free[2 * node], free[2 * node + 1])
            if free[node] == top:
                break
            free[node] = top
    return out


def powers(n: int) -> list[int]:
    """Powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_sizes(sizes: list[int], room: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset in it) for pieces in decreasing order of size.

    First-fit decreasing, then the fullest ``sum // room`` bins are kept and
    filled up with the pieces of the others, cut where a bin is full.  What is
    left over makes sequences of powers of two.
    """
    bins: dict[int, list[int]] = {}
    for piece, b in enumerate(first_fit(sizes, room)):
        bins.setdefault(b, []).append(piece)
    total = sum(sizes)
    order = sorted(bins, key=lambda b: (-sum(sizes[i] for i in bins[b]), b))
    full = total // room
    out, gaps = [], []
    for sequence, b in enumerate(order[:full]):
        offset = 0
        for i in bins[b]:
            out.append((i, 0, sizes[i], sequence, offset))
            offset += sizes[i]
        if offset < room:
            gaps.append((sequence, offset, room - offset))
    gaps += [(full + k, 0, size) for k, size in enumerate(powers(total % room))]
    gaps.reverse()
    for i in sorted(i for b in order[full:] for i in bins[b]):
        start = 0
        while start < sizes[i]:
            sequence, offset, gap = gaps.pop()
            n = min(gap, sizes[i] - start)
            out.append((i, start, n, sequence, offset))
            start += n
            if n < gap:
                gaps.append((sequence, offset + n, gap - n))
    return out


def _bounded(batches, most: int):
    """(doc_id, text) batches of at most ``most`` bytes of text or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _cut_batches(batches, path: str, groups: int, room: int, end: int):
    """(doc_id, text) batches to pieces of at most ``room`` ids with their group."""
    words, part = WordIds(path), TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def packed(batch, columns):
        rows, *rest = columns
        arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(v, k) for v, k in zip(rest, kinds)]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "grp", "key", "start", "length", "doc_tokens", "ids"])

    for batch in _bounded(batches, _BYTES):
        columns: list[list] = [[] for _ in range(7)]
        texts = batch.column(1).to_pylist()
        for row, (doc_id, text, ids) in enumerate(zip(batch.column(0).to_pylist(), texts, words.encode(batch.column(1)))):
            content = xxhash.xxh64_intdigest(f"{doc_id}\n{text}".encode())
            times = seen[content] = seen.get(content, 0) + 1
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            for start in range(0, len(ids), room):
                key = xxhash.xxh64_intdigest(f"{content} {part} {times} {start}") >> 1
                piece = ids[start : start + room]
                for values, value in zip(columns, (row, key % groups, key, start, len(piece), len(ids), piece.tobytes())):
                    values.append(value)
                if len(columns[0]) >= _PIECES:
                    yield packed(batch, columns)
                    columns = [[] for _ in range(7)]
        yield packed(batch, columns)


def _pack_group(table: pa.Table, groups: int, room: int) -> pa.Table:
    """One group's pieces, cut and placed."""
    table = table.sort_by([("length", "descending"), ("key", "ascending"), ("start", "ascending")])
    start, ids = table["start"].to_pylist(), table["ids"]
    placed = pack_sizes(table["length"].to_pylist(), room)
    group = table["grp"][0].as_py()
    piece = [p[0] for p in placed]
    same = table.select(["doc_id", "doc_tokens"]).take(pa.array(piece, pa.int64()))
    own = {
        "start": pa.array([start[i] + at for i, at, *_ in placed], pa.int64()),
        "length": pa.array([n for _, _, n, _, _ in placed], pa.int64()),
        "sequence_id": pa.array([group + groups * s for *_, s, _ in placed], pa.int64()),
        "offset": pa.array([o for *_, o in placed], pa.int64()),
        "ids": pa.array([ids[i].as_buffer().slice(4 * at, 4 * n).to_pybytes() for i, at, n, _, _ in placed], pa.binary()),
    }
    for name, values in own.items():
        same = same.append_column(name, values)
    return same


def pack(docs: DataFrame, path: str | None = None, room: int = LENGTH, end: int = END, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, doc_tokens, start, length, sequence_id, offset, ids): a row per piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.  The
    pieces of a sequence fill it from 0 without a gap; every sequence has ``room``
    ids or a power of two of them.  Ids pass one shuffle, to their groups.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // group_rows), -(-size // GROUP_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = texts.mapInArrow(
        lambda batches: _cut_batches(batches, path, groups, room, end),
        f"doc_id {kind}, grp long, key long, start long, length long, doc_tokens long, ids binary",
    )
    return pieces.groupBy("grp").applyInArrow(
        lambda table: _pack_group(table, groups, room),
        f"doc_id {kind}, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, starts, ids): whole sequences of ``pack``, a document's first id per entry."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return whole.select(
        "sequence_id",
        F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("starts"),
        F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select(F.col("doc_id").cast("long"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_packing": op12_packing}
ORACLE_SQL: dict[str, str] = {}
