"""SimHash near-duplicates through multi-index hashing.

A text's fingerprint sums the bits of the XXH64 hashes of its 4-word shingles.
Two fingerprints link at 4 or fewer differing bits; a component is everything
reachable over links.

Search.  The 64 bits fall into segments, each searched to a radius, such that
the radii plus one exceed 4 in sum: two fingerprints within 4 bits then agree up
to the radius in at least one segment.  A fingerprint is stored once per segment
and asks for the Hamming balls around its segments; every fetched candidate is
verified on all 64 bits.  Two layouts, both exact, the cheaper one is taken from
the counted number of fingerprints: segments of 21, 21, 22 bits at radius 1, 1, 0
(42 probes and 3 stored rows, some 42 N / 2^21 candidates), or two of 32 bits at
radius 2 and 1 (562 probes, 2 stored rows, some 562 N / 2^32 candidates), which pays
from about 10^10 fingerprints on.

Skew.  Equal fingerprints are merged before the search.  A segment value with
more than ``HOT`` stored fingerprints is cut into blocks, and every pair of
blocks meets in a task of its own; a task holds one block of at most about
``HOT`` fingerprints and streams the rest past it.  Tasks emit a spanning
forest of the verified links, never all pairs, which keeps every component.

The stage ``near_dedup`` judges rows, not ids: of each component exactly one row
stays, the smallest doc_id's, also where ids are null or repeated.

Cases: null or empty texts (and texts of separators only) have fingerprint
zero and link like any other; fewer than four words hash as one shingle; rows
without ``doc_id`` link like others, and a component without any id has a null
component_id; repeated rows share their component; an empty table gives an empty
result; texts of any length are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forest, keep_one, look_up, read_table, row_key, sized, slices

WORDS = 4
SEED = 42
DISTANCE = 4
#: Layouts of (first bit, bits, radius searched) per segment; radii plus one exceed DISTANCE in sum.
LAYOUTS = (((0, 21, 1), (21, 21, 1), (42, 22, 0)), ((0, 32, 2), (32, 32, 1)))
#: What moving one row costs, in comparisons of two fingerprints.
ROW_COST = 500
#: Stored fingerprints of one segment value that one task takes.
HOT = 8192
_CHUNK = 1 << 16
_PAIRS = 1 << 22


def _words(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by one space each, and where each begins and ends in that string."""
    data = np.frombuffer(text.lower(), np.uint8)  # bytes: lowers A-Z only
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep, data = ~gap, data.copy()
    data[ends[:-1]], keep[ends[:-1]] = 32, True
    size = ends - starts
    ends = np.cumsum(size + 1) - 1
    return data[keep].tobytes(), ends - size, ends


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; zero without words."""
    joined, starts, ends = _words(text or b"")
    if not len(starts):
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(starts) < WORDS:
        return hash64(joined, SEED)
    starts, ends = starts[: len(starts) - WORDS + 1], ends[WORDS - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([hash64(joined[s:e], SEED) for s, e in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for batch in slices(batches):
        found = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, key, fp) with the fingerprint's 64 bits in a signed long."""
    shape = "struct<a: bigint, b: bigint>"
    key = F.lit(None).cast(shape) if key is None else key
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"doc_id long, key {shape}, fp long")


def masks(width: int, radius: int) -> list[int]:
    """The differences of the Hamming ball around a value of ``width`` bits, without 0."""
    return [sum(1 << bit for bit in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def layout(n: int) -> tuple[tuple[int, int, int], ...]:
    """The layout that costs least for ``n`` fingerprints."""

    def cost(segments) -> float:
        return sum((1 + len(masks(width, radius))) * (ROW_COST + n / 2**width) for _, width, radius in segments)

    return min(LAYOUTS, key=cost)


def _entries(nodes: DataFrame, segments) -> DataFrame:
    """Stored rows (probe false) and probes of every segment: key, probe, fp."""

    def rows(n: int, first: int, width: int, radius: int) -> Column:
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(n << 32)
        own = F.array(F.struct((value + tag).alias("key"), F.lit(False).alias("probe")))
        ball = F.lit([0, *masks(width, radius)]).cast("array<bigint>")
        probes = F.transform(F.slice(ball, 2, F.size(ball)), lambda m: F.struct((value.bitwiseXOR(m) + tag).alias("key"), F.lit(True).alias("probe")))
        return F.concat(own, probes)

    keys = [rows(n, *segment) for n, segment in enumerate(segments)]
    return nodes.select(F.explode(F.concat(*keys)).alias("e"), "fp").select("e.key", "e.probe", "fp")


def _verified(fp, left, right):
    near = np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE
    return fp[left[near]].view(np.int64), fp[right[near]].view(np.int64)


def _meet(store, fp, probe):
    """Links of the arriving rows of one group with ``store`` [fingerprints]; stored rows join it."""
    for at in range(0, len(fp), 2048):
        a, p = fp[at : at + 2048], probe[at : at + 2048]
        if not p.all():
            store[0] = np.concatenate([store[0], a[~p]])
        for s in range(0, len(store[0]), 2048):
            i, j = np.nonzero(np.bitwise_count(a[:, None] ^ store[0][None, s : s + 2048]) <= DISTANCE)
            left, right = a[i].view(np.int64), store[0][s + j].view(np.int64)
            yield forest(left[left != right], right[left != right])


def _link_batches(batches):
    """Rows sorted by (key, block, probe) in, forest edges (a, b) out.

    State between batches is the stored part of the last group alone.
    """
    last, store = None, [np.zeros(0, np.uint64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block, probe, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        probe, fp = probe.astype(bool), fp.view(np.uint64)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(key)]])
        found = []
        if last == (key[0], block[0]):
            found += _meet(store, fp[: ends[0]], probe[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if len(starts):
            s = starts[-1]
            last, store = (key[s], block[s]), [np.zeros(0, np.uint64)]
            found += _meet(store, fp[s:], probe[s:])
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            # every stored row meets the rows behind it in its group, which sort stored rows first
            inner = np.arange(starts[0], ends[-1])
            behind = np.repeat(ends, ends - starts) - inner - 1
            keep = ~probe[inner] & (behind > 0)
            inner, behind = inner[keep], behind[keep]
            total = np.cumsum(behind)
            at = 0
            while at < len(inner):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS)))
                many = behind[at:to]
                left = np.repeat(inner[at:to], many)
                right = left + 1 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append(forest(*_verified(fp, left, right)))
                at = to
        found = [x for x in found if len(x[0])]
        if found:
            a, b = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(nodes: DataFrame, hot: int = HOT, segments=None) -> DataFrame:
    """Edges (a, b) between fingerprints that span the components of ``nodes(fp)``."""
    entries = _entries(nodes, segments or layout(nodes.count()))
    heavy, rows = sized(entries.where(~F.col("probe")).groupBy("key").count().where(F.col("count") > hot).select("key", F.ceil(F.col("count") / hot).cast("int").alias("blocks")))
    if not rows:
        units = entries.withColumn("block", F.lit(0))
    else:
        # a row of block i is stored in unit i and a probe in the units behind it; probes go to every unit
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        placed = entries.join(heavy, "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), own).otherwise(F.lit(0)))
        last = F.coalesce(F.col("blocks"), F.lit(1)) - 1
        placed = placed.withColumn("block", F.explode(F.sequence(F.when(F.col("probe"), F.lit(0)).otherwise(F.col("own")), last)))
        units = placed.withColumn("probe", F.col("probe") | (F.col("block") != F.col("own")))
    units = units.select("key", "block", "probe", "fp")
    return units.repartition("key", "block").sortWithinPartitions("key", "block", "probe").mapInArrow(_link_batches, "a long, b long")


def _grouped(prints: DataFrame, hot: int) -> DataFrame:
    """(fp, n, low, group) of distinct fingerprints: rows, smallest doc_id, component's smallest fingerprint."""
    nodes = cut(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    found = components(links(nodes.select("fp"), hot)).withColumnRenamed("node", "fp")
    return cut(nodes.join(found, "fp", "left").select("fp", "n", "low", F.coalesce("component", "fp").alias("group")))


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, fp a signed long."""
    prints = cut(fingerprints(docs).drop("key"))
    nodes = _grouped(prints, hot)
    named = cut(nodes.groupBy("group").agg(F.min("low").alias("component_id"), F.sum("n").alias("n")))
    named = look_up(nodes.select("fp", "group"), named.select("group", "component_id"), named.select("group", "n"), "group", ["fp"])
    out = look_up(prints, cut(named.select("fp", "component_id")), nodes.select("fp", "n"), "fp", ["doc_id"])
    return out.select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component."""
    prints = cut(fingerprints(docs, row_key(docs)))
    nodes = _grouped(prints, hot)
    several = cut(nodes.groupBy("group").agg(F.sum("n").alias("all")).where("all > 1"))
    nodes = look_up(nodes, several, several.select("group", F.col("all").alias("n")), "group", ["fp"]).where("all is not null")
    nodes = cut(nodes.select("fp", "n", "group"))
    tagged = look_up(prints, nodes.select("fp", "group"), nodes.select("fp", "n"), "fp", ["key"]).where("group is not null")
    return keep_one(docs, cut(tagged.select(F.col("doc_id").alias("id"), "key", "group")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
