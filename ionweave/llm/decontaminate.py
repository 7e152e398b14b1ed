"""Benchmark decontamination: short test items inside long documents (built-in functions only).

Words are runs of letters and digits, lower-cased; shingles are five words
(items of fewer words: the whole item).  An item is contained when at least 0.8
of its distinct shingles occur in the document.

Candidate search.  Shingles are ranked by one 64-bit minwise hash.  Items are
partitioned by size (their least number of shared shingles, in powers of two).
An item of q distinct shingles, of which ceil(0.8 q) must occur, has as MinHash
signature its bottom s hashes, s = q - ceil(0.8 q) + ``SURPLUS`` (all, if it has
fewer).  At most q - ceil(0.8 q) of them may be absent from a document that
contains the item, so the containment estimate, the number of signature hashes
found, is at least ``SURPLUS`` there: pairs below are dropped, and none is missed.
(Signatures of whole documents, as banded MinHash takes them, would have to be as
long as the documents for items of thirty words in 20,000.)  A document meets
only the partitions it is long enough for, and of its shingles only those under
the largest signature hash of these partitions leave the scan.

Verification counts each item's shingles in the document's text, word by word,
not by hash.  Texts that repeat are verified once.

Work grows with the words of the documents; the signatures are broadcast only
when their counted rows allow, else both sides are dealt by hash value.  A passage
that many documents share yields one row per (document, item), never pairs of
documents.

The stage ``decontaminate`` judges each row by its own text, whatever its id.

Cases: null or wordless texts and items contain nothing and are contained
nowhere; rows without doc_id are not listed, but dropped by the stage if they
contain an item; items without item_id are skipped; repeated documents or items
give one row per (doc_id, item_id), the best of the repeats; an empty table gives
an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fingerprint128, hot_join, indices, let, read_table, sized, without

WORDS = 5
#: Threshold as a fraction, so that comparisons are exact.
PART, OF = 4, 5
#: Signature hashes beyond those that a containing document may lack.
SURPLUS = 3
#: Shingles of all items that are broadcast, in characters with 32 a shingle added.
ITEM_CHARS = 1 << 25


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _hashes(h: Column, width: int) -> Column:
    """Hash of every run of ``width`` words, from the words' hashes."""
    return F.transform(indices(F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))


def _gram_hash(width: int):
    """The same value for a shingle given as an array of its words."""
    return lambda gram: F.xxhash64(*[F.xxhash64(F.get(gram, F.lit(k))) for k in range(width)])


def _need(q: Column) -> Column:
    """Shingles that must be found: ceil(q * PART / OF)."""
    return F.floor((q * PART + (OF - 1)) / OF)


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_id, width, shingles, q, sketch) per item with words; sketch holds the signature."""
    rows = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("ws")).where("size(ws) > 0")
    rows = rows.withColumn("width", F.least(F.lit(WORDS), F.size("ws")))
    grams = F.transform(indices(F.size("ws") - F.col("width") + 1), lambda i: F.slice("ws", i + 1, F.col("width")))
    rows = rows.select("item_id", "width", F.array_distinct(grams).alias("grams"))
    hashed = F.coalesce(*[F.when(F.col("width") == n, F.transform("grams", _gram_hash(n))) for n in range(1, WORDS + 1)])
    rows = rows.select("item_id", "width", F.transform("grams", lambda g: F.array_join(g, " ")).alias("shingles"), F.array_sort(hashed).alias("hs"))
    q = F.size("shingles")
    return rows.select("item_id", "width", "shingles", q.alias("q"), F.slice("hs", 1, (q - _need(q) + SURPLUS).cast("int")).alias("sketch"))


def _candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(doc_id, key, item_id): pairs whose estimate allows containment; ``key`` stands for the text."""
    # thresholds by width and size class of the item: at most WORDS x 31 rows
    size_class = F.floor(F.log2(_need(F.col("q")).cast("double"))).cast("int")
    tops = sketches.groupBy("width", size_class.alias("c")).agg(F.max(F.array_max("sketch")).alias("top")).collect()
    marks, _ = sized(sketches.select("width", "item_id", "q", F.explode(F.array_distinct("sketch")).alias("h")))

    def under(h: Column, width: int) -> Column:
        limit = F.lit(None).cast("long")
        for r in sorted((r for r in tops if r.width == width), key=lambda r: r.c):
            # long enough for the smallest item of this class: its threshold counts too
            limit = F.when(F.size(h) >= 2**r.c + width - 1, F.greatest(limit, F.lit(r.top))).otherwise(limit)
        kept = let(limit, lambda top: F.array_distinct(F.filter(_hashes(h, width), lambda g: g <= top)))
        return F.transform(F.when(limit.isNotNull(), kept).otherwise(F.array().cast("array<bigint>")), lambda g: F.struct(F.lit(width).alias("width"), g.alias("h"), F.size(h).alias("n")))

    widths = sorted({r.width for r in tops}) or [WORDS]
    hashed = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    found = docs.select("doc_id", "key", F.explode(let(hashed, lambda h: F.concat(*[under(h, w) for w in widths]))).alias("g"))
    found = found.select("doc_id", "key", "g.width", "g.h", "g.n")
    hits = found.join(marks, ["width", "h"]).where(F.col("n") - F.col("width") + 1 >= _need(F.col("q")))
    least = F.least(F.min(_need(F.col("q"))), F.lit(SURPLUS))
    return hits.groupBy("doc_id", "key", "item_id").agg(F.count("*").alias("found"), least.alias("least")).where("found >= least").select("doc_id", "key", "item_id")


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, item_id, n_shingles, n_found) of the pairs whose texts contain the items.

    Texts are dealt by key; the items go along with the pairs, broadcast if they are at
    most ``ITEM_CHARS`` long in all, else with items that many texts hold dealt over parts.
    """
    pairs = cut(pairs.select("key", "item_id").distinct())
    hit, _ = sized(pairs.select("key").distinct())
    texts = docs.select("key", "text").join(hit, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    plain = texts.select("key", F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("plain"))
    items = sketches.select("item_id", "shingles")
    chars = sketches.agg(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 32))).first()[0] or 0
    if chars <= ITEM_CHARS:
        wanted = pairs.join(F.broadcast(items), "item_id")
    else:
        wanted = hot_join(pairs, items, pairs.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", ["key"])
    n_found = F.size(F.filter("shingles", lambda s: F.contains("plain", F.concat(F.lit(" "), s, F.lit(" ")))))
    scored = plain.join(wanted, "key").select("key", "item_id", F.size("shingles").alias("n_shingles"), n_found.alias("n_found"))
    scored = scored.where(F.col("n_found") * OF >= F.col("n_shingles") * PART)
    best = scored.groupBy("key", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("b"))
    return best.select("key", "item_id", "b.n_shingles", "b.n_found")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint128(F.col("text")).alias("key"), "text")


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items contained in documents."""
    sketches, docs = cut(item_sketches(items)), _keyed(docs).where("doc_id is not null")
    pairs = cut(_candidates(docs, sketches))
    found, _ = sized(_verified(docs, pairs, sketches))
    listed = pairs.join(found, ["key", "item_id"])
    best = listed.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_found")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains an item."""
    sketches, rows = cut(item_sketches(items)), _keyed(docs).withColumn("doc_id", F.lit(None).cast("long"))
    found = _verified(rows, _candidates(rows, sketches), sketches)
    gone, n = sized(found.select("key").distinct())
    return without(docs, fingerprint128(F.col("text")), gone) if n else docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_benchmark_decontamination": op3_benchmark_decontamination}
ORACLE_SQL = {
    "op3_benchmark_decontamination": r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), ig AS (
  SELECT item_id, least(5, len(ws)) AS width,
    unnest(list_distinct([array_to_string(ws[i + 1:i + least(5, len(ws))], ' ') FOR i IN range(len(ws) - least(5, len(ws)) + 1)])) AS g
  FROM iw WHERE len(ws) > 0
), q AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id
), dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), dg AS (
  SELECT DISTINCT doc_id, width, g FROM (
    SELECT doc_id, w.width, unnest([array_to_string(ws[i + 1:i + w.width], ' ') FOR i IN range(greatest(0, len(ws) - w.width + 1))]) AS g
    FROM dw, (SELECT DISTINCT width FROM ig) w)
)
SELECT doc_id, ig.item_id, any_value(q.n)::INTEGER AS n_shingles, count(*)::INTEGER AS n_found
FROM ig JOIN dg ON ig.width = dg.width AND ig.g = dg.g JOIN q ON q.item_id = ig.item_id
GROUP BY doc_id, ig.item_id HAVING count(*) * 5 >= any_value(q.n) * 4
"""
}
