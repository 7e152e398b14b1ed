"""Vector code compression: a product quantiser fitted and applied in integers.

Vectors are scaled, floored and cut into equal parts; every part position has a
codebook of up to 256 entries.  The kept rows are written once as column-major
NumPy blocks of their parts to the shared folder.  A round of the fit is one
``treeAggregate`` over these blocks: distances to all entries accumulate one
dimension at a time, ``np.add.at`` puts the nearest entries' sums and counts into
int64 tensors, and these merge through the reduction tree.  Only the tensors
(entries x dimension numbers) reach the driver, whatever the number of rows.

All arithmetic is exact: a block is computed in 32-bit integers where its largest
value proves that they suffice, else in 64 bits, and integer sums do not depend on
the order of rows or partitions.

Cases: rows with a null vector or null or non-finite components are dropped, and
so are vectors whose length is not the commonest length that ``parts`` divides
(of several, the smallest; the empty vector has no parts); components are held
within +-2**26 after scaling, so that errors fit a long; repeated vec_ids and
vectors are rows like others; null vec_ids sort last for the start entries, equal
ones by their vector; fewer rows than ``entries`` give as many entries; a null
label is a label of its own; a label's error beyond a long is null; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .common import look_up, read_table, shared_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Largest absolute component after scaling.
MOST = 1 << 26
#: Rows of a stored block, and rows whose distances are held at a time.
BLOCK = 2048
_AT_ONCE = 128


@dataclass
class Codebooks:
    """``entries[part, entry, position]``, int64."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled and floored components."""
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def _narrow(values: np.ndarray) -> np.ndarray:
    """``values`` in the smallest of 16, 32 and 64 bits that holds them."""
    most = int(np.abs(values).max(initial=0))
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every column of ``block[position, row]``.

    ``entries[entry, position]``.  |x - c|^2 - |x|^2 = |c|^2 - 2xc is summed dimension by dimension; ties go to the lower index.
    """
    size, rows = block.shape
    most = max(int(np.abs(block).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if 3 * size * most * most < 1 << 31 else np.int64
    twice, norm = (-2 * entries.T).astype(kind), (entries * entries).sum(1).astype(kind)
    index, score = np.empty(rows, np.int64), np.empty(rows, np.int64)
    total, step = np.empty((_AT_ONCE, len(entries)), kind), np.empty((_AT_ONCE, len(entries)), kind)
    for at in range(0, rows, _AT_ONCE):
        x = block[:, at : at + _AT_ONCE].astype(kind)
        n = x.shape[1]
        total[:n] = norm
        for d in range(size):
            np.multiply(x[d][:, None], twice[d], out=step[:n])
            np.add(total[:n], step[:n], out=total[:n])
        index[at : at + n] = best = total[:n].argmin(1)
        score[at : at + n] = total[np.arange(n), best]
    wide = block.astype(np.int64)
    return index, score + (wide * wide).sum(0)


def _part_blocks(row, parts: int) -> np.ndarray:
    """The stored block of a row as [part, position, row]."""
    return np.frombuffer(row["data"], f"<i{row['width']}").reshape(parts, -1, row["n"])


def _tally(state, row, codebooks: np.ndarray):
    """Add a block's sums and counts by part and nearest entry to ``state``."""
    sums, counts = state
    parts, entries, size = codebooks.shape
    for p, block in enumerate(_part_blocks(row, parts)):
        index, _ = nearest(block, codebooks[p])
        np.add.at(counts[p], index, 1)
        for d in range(size):
            np.add.at(sums[p, :, d], index, block[d].astype(np.int64))
    return sums, counts


def _merge(a, b):
    return a[0] + b[0], a[1] + b[1]


def _kept(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, embedding, label) that take part, and the length of their vectors."""
    component = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select("vec_id", component.alias("embedding"), label.alias("label")).where(F.col("embedding").isNotNull() & finite)
    size = F.size("embedding")
    lengths = rows.where((size > 0) & (size % parts == 0)).groupBy(size.alias("size")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "size").limit(1).collect()
    length = common[0]["size"] if common else parts
    return rows.where(size == length), length


def _blocks(rows: DataFrame, length: int, parts: int, scale: int) -> DataFrame:
    """``rows`` as blocks (vec_ids, labels, n, width, data), written to the shared folder."""
    spark = rows.sparkSession
    vec_id, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                values = _narrow(whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, length), scale))
                data = np.ascontiguousarray(values.T).tobytes()
                ids, labels = (pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(c)) for c in (0, 2))
                numbers = [pa.array([n], pa.int32()), pa.array([values.itemsize], pa.int32()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, labels, *numbers], ["vec_ids", "labels", "n", "width", "data"])

    path = shared_path(spark, "vector-blocks")
    made = rows.mapInArrow(run, f"vec_ids array<{vec_id}>, labels array<{label}>, n int, width int, data binary")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


class Fitted:
    """Codebooks with the blocks they were fitted on."""

    def __init__(self, codebooks: Codebooks, blocks: DataFrame):
        self.codebooks, self.blocks = codebooks, blocks


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Fitted:
    """Codebooks of ``vectors(vec_id, embedding[, label])``, started from the rows of the smallest vec_ids.

    Each round assigns every part to its nearest entry and moves each used entry
    to its parts' componentwise floor(sum / count).
    """
    rows, length = _kept(vectors, parts)
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = whole(np.array([r.embedding for r in first], np.float64).reshape(len(first), length), scale)
    books = start.reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    blocks = _blocks(rows, length, parts, scale)
    sc = rows.sparkSession.sparkContext
    numbers = blocks.select("n", "width", "data").rdd
    for _ in range(rounds if len(first) else 0):
        sent = sc.broadcast(books)
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = numbers.treeAggregate(zero, lambda state, row: _tally(state, row, sent.value), _merge)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        sent.unpersist()
    return Fitted(Codebooks(books, scale), blocks)


def encode(fitted: Fitted) -> DataFrame:
    """(vec_id, label, code, error): a byte per part, and the squared distance to the entries coded."""
    blocks = fitted.blocks
    vec_id, label = (blocks.schema[c].dataType.elementType.simpleString() for c in ("vec_ids", "labels"))
    sent = blocks.sparkSession.sparkContext.broadcast(fitted.codebooks.entries)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("n", "width", "data")}
                books = sent.value
                found = [nearest(block, books[p]) for p, block in enumerate(_part_blocks(row, len(books)))]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                error = pa.array(sum(e for _, e in found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, code, error], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {vec_id}, label {label}, code binary, error long")


def decode(encoded: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``encoded`` with ``embedding``: the coded entries, scaled back."""
    sent = encoded.sparkSession.sparkContext.broadcast(codebooks.entries / codebooks.scale)
    kind = encoded.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            books, n = sent.value, batch.num_rows
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, len(books))
            values = np.concatenate([books[p][codes[:, p]] for p in range(len(books))], 1)
            offsets = pa.array(np.arange(n + 1) * values.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["vec_id", "embedding"])

    return encoded.select("vec_id", "code").mapInArrow(run, f"vec_id {kind}, embedding array<double>")


def label_key(label: Column) -> Column:
    """Text that tells a null label from all others."""
    return F.when(label.isNull(), "-").otherwise(F.concat(F.lit("+"), label.cast("string")))


def label_errors(encoded: DataFrame) -> DataFrame:
    """``encoded`` with ``label_error``: the sum of errors over equal labels, nulls together.

    Sums combine before the shuffle; they are joined back by broadcast where the
    labels are few, else with the rows of hot labels dealt over parts.
    """
    rows = encoded.withColumn("_label", label_key(F.col("label")))
    sums = cut(rows.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    return look_up(rows, sums.select("_label", "label_error"), sums.select("_label", "n"), "_label", ["vec_id", "code"]).drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = fit(read_table(spark, sf_dir, "embeddings"))
    coded = label_errors(cut(encode(fitted)))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(fitted.codebooks.sha256()).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL: dict[str, str] = {}
