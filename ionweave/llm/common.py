"""Helpers shared by the training-data operators.

Rules that hold for all of them:

* Input columns are picked by name, so further columns never clash.
* Null text counts as the empty text.  Rows without an id take part where the
  operator needs no id; where it does, the docstring says what happens.
* Lineage is cut with ``checkpoint()`` in the folder ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir

#: Largest number of rows that is broadcast, always counted first.
BROADCAST_ROWS = 200_000
#: Largest size of rows with values of open length that are broadcast.
BROADCAST_BYTES = 1 << 25


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fits(df: DataFrame) -> bool:
    """Whether a materialised ``df`` may be broadcast: its rows and the bytes of its values are counted."""
    if df.count() > BROADCAST_ROWS:
        return False
    size = F.lit(0).cast("long")
    for f in df.schema:
        kind = f.dataType.simpleString()
        value = F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif any(x in kind for x in ("string", "binary", "array", "map")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Materialise a narrow ``df`` and hint a broadcast only if its row count allows."""
    kept = cut(df)
    rows = kept.count()
    return (F.broadcast(kept) if rows <= most else kept), rows


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fingerprint128(*values: Column) -> Column:
    """128 bits of ``values`` as a struct, nulls told apart from absent values."""
    told = [*values, *[v.isNull() for v in values]]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit(1), *told).alias("b"))


def row_key(docs: DataFrame) -> Column:
    """Key of a row's content: rows share it only when all their columns are equal."""
    plain = [F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema]
    return fingerprint128(*plain)


def without(docs: DataFrame, key: Column, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``gone(key)``; with only those for ``left_semi``."""
    name = free_name(docs, "_key")
    return docs.withColumn(name, key).join(gone.select(F.col("key").alias(name)), name, how).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, tagged: DataFrame) -> DataFrame:
    """``docs`` with exactly one row of every group of ``tagged(id, key, group)``.

    ``tagged`` has a line for each row that shares its group with others, with
    the row's ``row_key``.  The smallest id stays, rows without one last, then
    the smallest key; of rows equal in every column any one.  Keys are narrow:
    texts are read again only where a row's fate is applied.
    """
    best = tagged.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best"), F.count("*").alias("n"))
    best = cut(best)
    lines = look_up(tagged, best.select("group", "best"), best.select("group", "n"), "group", ["key"])
    fates = lines.groupBy("key").agg(F.max(F.col("key") == F.col("best.key")).alias("wins"), F.count("*").alias("n"))
    fates = cut(fates.where("not wins or n > 1"))
    gone, rows = sized(fates.select("key"))
    if not rows:
        return docs
    out = without(docs, row_key(docs), gone)
    again, rows = sized(fates.where("wins").select("key"))
    if rows:
        same = without(docs, row_key(docs), again, "left_semi")
        name = free_name(docs, "_key")
        out = out.union(same.withColumn(name, row_key(docs)).dropDuplicates([name]).drop(name))
    return out


#: A key is hot above one part in HOT_PART of all rows, so at most HOT_PART keys are; each gets SALTS parts.
HOT_PART = 1000
SALTS = 64


def hot_join(rows: DataFrame, facts: DataFrame, counts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one line per ``key``), hot keys dealt over SALTS parts.

    ``counts(key, n)`` names the hot keys: at most HOT_PART of them, hence the
    broadcast.  Their facts are repeated per part; ``by`` deals their rows.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT_PART > total).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(cut(hot))
    left = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    every = F.sequence(F.lit(0).cast("long"), F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long"))
    right = facts.join(hot, key, "left").withColumn("_part", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_part"], "left").drop("_part")


def look_up(rows: DataFrame, facts: DataFrame, counts: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``hot_join``, or a broadcast where the materialised ``facts`` are few and small."""
    if fits(facts):
        return rows.join(F.broadcast(facts), key, "left")
    return hot_join(rows, facts, counts, key, by)


def slices(batches, rows: int = 1024):
    """Arrow batches in smaller parts, so that Python objects exist for one part at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_training(doc_id: Column) -> Column:
    """True for the rows a model may learn from: crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


#: Hashes of ``sample_hash`` are at most this.
MOST_HASH = (1 << 63) - 1


def sample_hash(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 1)


def sample_limit(n: int, sample: int) -> int:
    """About ``sample`` of ``n`` rows have a ``sample_hash`` of at most this, all if they are no more; above 0 for every n."""
    return MOST_HASH if n <= sample else max(1, sample * MOST_HASH // n)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for the lambda ``body`` (a higher-order ``let``)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --------------------------------------------------------------------------
# connected components


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges: (node, smallest node of its component)."""
    if not len(left):
        return left, right
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node.

    Alternating large-star and small-star rounds, each cut by a checkpoint.
    Minima are combined before the shuffle, and the join back on a hub is a
    plain equi-join that adaptive execution splits, so a hub with a third of
    all edges does not end in one task.  Isolated nodes are not listed.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(both.where("a <> b").distinct())
    mark = None
    while True:
        sym = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = sym.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        now = cut(small)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = new


# --------------------------------------------------------------------------
# array expressions


def indices(n: Column) -> Column:
    """[0, 1, ... n-1], also for n of 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def prefix_sums(steps: Column) -> Column:
    """Inclusive running sums of an array of integers.

    Two levels of about sqrt(n) elements each: n^1.5 additions, without the
    n^2 copies that growing an array inside ``aggregate`` costs.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def body(s: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(s))).cast("int"))

        def within(w: Column) -> Column:
            heads = F.transform(indices(F.ceil(F.size(s) / w).cast("int")), lambda k: total(F.slice(s, 1, k * w)))
            return let(
                heads,
                lambda h: F.transform(
                    indices(F.size(s)),
                    lambda i: F.get(h, F.floor(i / w).cast("int")) + total(F.slice(s, F.floor(i / w).cast("int") * w + 1, i % w + 1)),
                ),
            )

        return let(width, within)

    return let(steps, body)
