"""Exact duplicates over an extendible-hash index on shared files (built-in functions only).

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became
one space.  The steps:

1. Key file: one narrow row (doc_id, 64-bit hash, SHA-256) per document, written
   to the shared folder without a shuffle.
2. Index keys: equal (hash, SHA-256) pairs are combined before the shuffle into
   one entry with its smallest doc_id and its number of rows, so a text that a
   third of all rows repeat is one entry.
3. Directory: starting from one bucket, a bucket over ``capacity`` splits on its
   next hash bit, and the directory doubles when the bucket's depth reaches the
   directory's.  The driver sees only the histogram over the first ``MAX_DEPTH``
   bits (at most 65,536 rows).  A bucket still over capacity at ``MAX_DEPTH``
   keeps its rows as overflow pages: its owner's aggregation spills.
4. Bucket files: index entries go to their bucket's owner, a task per range of
   (bucket, hash), which writes them to the shared folder.
5. Chains: owners read their bucket files and sum the rows of each hash.  Texts
   of hashes with several rows are routed through the directory to (bucket,
   hash) and chained there by their bytes: equal hashes with other bytes are
   further links of the chain, with groups of their own.
6. Look-up: every key is routed through the directory to its chain and takes the
   link with its digest.

The stage ``exact_dedup`` judges rows, not ids: of each group exactly one row
stays, the smallest doc_id's, also where ids are null or repeated.

Cases: null text counts as empty; rows without doc_id belong to their group,
count in its size and are not kept unless no row of the group has an id;
repeated rows (same doc_id and text) share keep_id and kept in the listing, and
one of them stays in the stage; an empty table gives an empty result; texts of
any length are compared whole.  The stage deletes its index; the listing's is read
when the listing is, so its folder stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, keep_one, look_up, read_table, row_key, shared_path, sized

MAX_DEPTH = 16
#: Index entries per bucket before it splits.
CAPACITY = 50_000


def normalised(text: Column) -> Column:
    """Each run of separators as one space; the pattern skips runs that already are one."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[tuple[int, int]]]:
    """Extendible hashing over ``histogram`` (first max_depth bits -> entries).

    Returns the directory's depth and its buckets as (prefix, local depth).
    """
    depth, done, todo = 0, [], [(0, 0, sorted(histogram.items()))]
    while todo:
        prefix, local, rows = todo.pop()
        if sum(n for _, n in rows) <= capacity or local == max_depth:
            done.append((prefix, local))
            continue
        depth = max(depth, local + 1)  # the directory doubles when a bucket outgrows it
        bit = max_depth - local - 1
        for half in (0, 1):
            todo.append((prefix * 2 + half, local + 1, [x for x in rows if (x[0] >> bit) & 1 == half]))
    return depth, sorted(done, key=lambda b: b[0] << (max_depth - b[1]))


def _slot(bits: int = MAX_DEPTH) -> Column:
    return F.shiftrightunsigned("h", 64 - bits).cast("int")


class Index:
    """Extendible-hash index of a table's texts, on shared files.

    ``keys(doc_id, h, sha, key)`` has a line per row, ``entries(bucket, h, sha, n)``
    are the bucket files, read back.
    """

    def __init__(self, docs: DataFrame, capacity: int = CAPACITY, key: Column | None = None):
        spark = docs.sparkSession
        self.path = path = shared_path(spark, "exact-index")
        key = F.lit(None).cast("struct<a: bigint, b: bigint>") if key is None else key
        norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), normalised(F.col("text")).alias("norm"))
        norm = norm.select("doc_id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "key")
        norm.write.parquet(f"{path}/keys")
        self.keys = spark.read.schema("doc_id long, h long, sha binary, key struct<a: bigint, b: bigint>").parquet(f"{path}/keys")
        entries = self.keys.groupBy("h", "sha").agg(F.count("*").alias("n"))
        entries.write.parquet(f"{path}/entries")
        entries = spark.read.schema("h long, sha binary, n long").parquet(f"{path}/entries")
        histogram = {r.slot: r.n for r in entries.groupBy(_slot().alias("slot")).agg(F.count("*").alias("n")).collect()}
        self.depth, buckets = directory(histogram, capacity)
        slots = [(s, i) for i, (prefix, local) in enumerate(buckets) for s in range(prefix << (self.depth - local), (prefix + 1) << (self.depth - local))]
        # the directory has 2**depth slots, at most 65,536
        self.slots = F.broadcast(spark.createDataFrame(slots, "slot int, bucket int"))
        # a bucket that cannot split further still spreads over several owners
        self.routed(entries).repartitionByRange("bucket", "h").write.parquet(f"{path}/buckets")
        discard(spark, f"{path}/entries")
        self.entries = spark.read.schema("h long, sha binary, n long, bucket int").parquet(f"{path}/buckets")

    def routed(self, rows: DataFrame) -> DataFrame:
        """``rows(h, ...)`` with the bucket that the directory names."""
        return rows.withColumn("slot", _slot(self.depth) if self.depth else F.lit(0)).join(self.slots, "slot").drop("slot")

    def chains(self, docs: DataFrame) -> DataFrame:
        """(bucket, h, sha, low, n): the links with several rows, by comparing bytes."""
        wanted, _ = sized(self.entries.groupBy("bucket", "h").agg(F.sum("n").alias("n")).where("n > 1").select("bucket", "h"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
        texts = self.routed(texts).join(wanted, ["bucket", "h"], "left_semi")
        # the text is part of the key, and copies combine before the shuffle
        links = texts.groupBy("bucket", "h", "norm").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
        return cut(links.select("bucket", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "low", "n"))

    def looked_up(self, chains: DataFrame) -> DataFrame:
        """``keys`` with their link's low and n, null where a row is alone."""
        place, keys = F.struct("bucket", "h", "sha").alias("place"), self.routed(self.keys)
        keys, chains = keys.select("doc_id", "sha", "key", place), chains.select(place, "low", "n")
        return look_up(keys, chains, chains.select("place", "n"), "place", ["doc_id", "key"])


def duplicate_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha): one row per row of ``docs``, sha binary."""
    index = Index(docs, capacity)
    out = index.looked_up(index.chains(docs))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "sha")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    index = Index(docs, capacity, row_key(docs))
    shared = index.looked_up(index.chains(docs)).where("n is not null")
    shared = cut(shared.select(F.col("doc_id").alias("id"), "key", F.col("place").alias("group")))
    discard(docs.sparkSession, index.path)
    return keep_one(docs, shared)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLE_SQL = {
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
}
