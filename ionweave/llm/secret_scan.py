"""Secret scans with multipart credential linking (built-in functions only).

Base kinds, always reported:

* ``assign``  a keyword, ``:`` or ``=``, and a value of 6 or more characters;
* ``access``  ``AKIA`` and upper-case letters or digits, 20 or more characters;
* ``hex``     24 or more lower-case hex digits.

Weak kinds, reported only when complementary parts lie within ``SCOPE``
code points of them in the same text, and no two of the parts overlap:

* ``ident``     a named login, account or client id - beside a secret
  (``assign``, ``hex`` or ``opaque``);
* ``opaque``    16 or more characters of mixed case and digits - beside an
  identifier (``access`` or ``ident``);
* ``endpoint``  a URL or host and port - beside an identifier and a secret.

Positions come from splitting the text at the pattern and summing the lengths
of what lies between and in the matches, all in code points.  Linking is an
interval join: parts of documents that have both sides are dealt into bins of
``SCOPE`` code points and semi-joined on (document, bin) with the exact distance
as condition, so no pairs leave the join.  An endpoint needs two parts that do not
overlap each other either; there the pairs (few, as parts of a kind near a span
stand side by side) are merged at once into first ends and last starts.

Cases: null text counts as empty and has no spans; documents are told apart by
(doc_id, text hash), so null and repeated ids are scanned like others;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, indices, let, prefix_sums, read_table

SCOPE = 200
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, group whose length counts, least length)
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: the same matches after the length test, as a faster pattern (a run of hex digits is found whole either way)
_SCAN = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
WEAK = {
    "ident": (r"""(?i)(?<![A-Za-z0-9])(?:client_?id|access_?key_?id|account(?:_?id)?|user_?(?:name|id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", 0, 0),
    "opaque": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])", 0, 0),
    "endpoint": (r"(?i)https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}(?![0-9])", 0, 0),
}
KINDS = [*BASE, *WEAK]
IDENTIFIER, SECRET = ("access", "ident"), ("assign", "hex", "opaque")
#: a quick test that every text with a match passes
_GATE = {
    "assign": lambda t: t.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike("[0-9a-f]{24}"),
    "ident": lambda t: t.rlike(r"""(?i)(?:id|account|user|name|login)["']?\x20*[:=]"""),
    "opaque": lambda t: t.rlike("[0-9]"),
    "endpoint": lambda t: F.contains(t, F.lit("://")) | t.rlike(r"[0-9]\.[0-9]{1,3}:[0-9]"),
}
_SPAN = "array<struct<start: bigint, rank: int, end: bigint>>"


def spans(text: Column, kind: str) -> Column:
    """Spans (start, rank, end) of one kind, in code points, end exclusive."""
    pattern, group, least = BASE.get(kind) or WEAK[kind]
    pattern = _SCAN.get(kind, pattern)
    rank = KINDS.index(kind)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m))

    def found(own: Column, gap: Column, size: Column) -> Column:
        steps = F.transform(indices(F.size(own)), lambda i: F.get(gap, i) + F.when(i > 0, F.get(own, F.greatest(i - 1, F.lit(0)))).otherwise(0))
        rows = let(
            prefix_sums(steps),
            lambda begin: F.transform(
                own,
                lambda n, i: F.struct(F.get(begin, i).alias("start"), F.lit(rank).alias("rank"), (F.get(begin, i) + n).alias("end"), F.get(size, i).alias("size")),
            ),
        )
        return F.transform(F.filter(rows, lambda r: r["size"] >= least), lambda r: F.struct(r["start"].alias("start"), r["rank"].alias("rank"), r["end"].alias("end")))

    rows = let(measured, lambda own: let(gaps, lambda gap: let(counted, lambda size: found(own, gap, size))))
    return F.when(_GATE[kind](text), rows).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _pairs(parts: DataFrame, kinds: tuple[str, ...], wanted: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """``wanted`` spans, parts of ``kinds`` and the condition that they are near but disjoint (interval join by bins).

    A span stands in every bin it touches and a part in every bin within SCOPE
    of it, so near pairs share a bin.
    """
    others = parts.where(F.col("rank").isin([KINDS.index(k) for k in kinds]))
    reach = F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))
    others = others.select(F.col("doc").alias("d"), F.explode(reach).alias("bin"), F.col("start").alias("s"), F.col("end").alias("e"))
    mine = wanted.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))))
    near = (mine.doc == others.d) & (mine.bin == others.bin) & (others.s - mine.end <= SCOPE) & (mine.start - others.e <= SCOPE)
    return mine, others, near & ((others.s >= mine.end) | (others.e <= mine.start))


def _near(parts: DataFrame, kinds: tuple[str, ...], wanted: DataFrame) -> DataFrame:
    """``wanted`` spans with a disjoint part of one of ``kinds`` within SCOPE; one found in several bins counts once."""
    mine, others, near = _pairs(parts, kinds, wanted)
    return mine.join(others, near, "left_semi").drop("bin").distinct()


def _near_both(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` spans with an identifier and a secret within SCOPE, all three disjoint."""

    def sides(kinds: tuple[str, ...], name: str) -> DataFrame:
        mine, others, near = _pairs(parts, kinds, wanted)
        return mine.join(others, near).groupBy("doc", "start", "rank", "end").agg(F.min("e").alias(f"{name}_end"), F.max("s").alias(f"{name}_start"))

    a, b = sides(IDENTIFIER, "i"), sides(SECRET, "s").withColumnsRenamed({"doc": "d", "start": "first", "rank": "r", "end": "last"})
    both = a.join(b, (F.col("doc") == F.col("d")) & (F.col("start") == F.col("first")) & (F.col("end") == F.col("last")))
    return both.where("i_end <= s_start or s_end <= i_start").select("doc", "start", "rank", "end")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): sorted span arrays (start, rank, end) of every document."""
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    per_kind = {k: spans(F.col("t"), k) for k in KINDS}
    doc = F.struct("doc_id", F.xxhash64("t").alias("h")).alias("doc")
    scanned = text.select("doc_id", doc, F.array_sort(F.flatten(F.array(*[per_kind[k] for k in BASE]))).alias("base"), F.flatten(F.array(*[per_kind[k] for k in WEAK])).alias("weak"))
    scanned = cut(scanned)
    parts = scanned.where(F.size("weak") > 0).select("doc", F.concat("base", "weak").alias("all"))

    def has(kinds: tuple[str, ...]) -> Column:
        ranks = [KINDS.index(k) for k in kinds]
        return F.exists("all", lambda s: s["rank"].isin(ranks))

    parts = parts.where(reduce(and_, [has(IDENTIFIER), has(SECRET)]))
    parts = parts.select("doc", F.explode("all").alias("s")).select("doc", "s.start", "s.rank", "s.end").distinct()
    parts = cut(parts)
    kind = {k: parts.where(F.col("rank") == KINDS.index(k)) for k in WEAK}
    added = (
        _near(parts, SECRET, kind["ident"])
        .union(_near(parts, IDENTIFIER, kind["opaque"]))
        .union(_near_both(parts, kind["endpoint"]))
    )
    added = added.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("added"))
    out = scanned.join(added.withColumnRenamed("doc", "d"), F.col("doc").eqNullSafe(F.col("d")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[n(k) for k in BASE], F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE_SQL: dict[str, str] = {}
