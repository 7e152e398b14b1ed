"""Marker terms of text collections, for naming clusters and groups of samples.

Study notes and reports that come with samples are a matrix like any other:
texts are observations, terms are features, counts are values.  The job builds
that matrix, drops rare terms, divides each text by its total and ranks the
terms that mark a collection by COSG, with the library's operators.

    python -m jobs.marker_terms --config jobs/marker_terms.json --documents IN.parquet --output OUT

``OUT`` holds rank, term, score and the number of the collection's texts with the
term, partitioned by collection.  Each run replaces the whole output, so a run
that was cut off is simply run again.

Texts without an identifier or collection take no part; texts of one identifier
in one collection count as one; null text has no terms; scores are rounded
before they are ranked, and equal scores go by term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionweave.errors import AnalysisError
from ionweave.model import number, require, whole
from ionweave.operators.analysis import cosg_scores
from ionweave.operators.preprocess import frequent_features, normalised
from ionweave.session import Scratch, cut

from .common import log, main

DEFAULTS = {
    "id": "doc_id", "text": "text", "collection": "lang",
    "pattern": "[A-Za-zÀ-ÖØ-öø-ÿ]{3,}",
    "min_occurrence": 0.01, "mu": 1.0, "expressed_pct": 0.02, "terms": 25,
}
DIGITS = 6
#: Terms that are joined by a broadcast at most.
BROADCAST_TERMS = 100_000
OUTPUT = "rank INT, term STRING, score DOUBLE, documents BIGINT, collection STRING"


def term_matrix(documents: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """(groups(obs_id, grp), x(obs_id, feature_id, value)): texts by terms, values being counts."""
    rows = documents.select(
        F.concat_ws("\n", F.col(config["collection"]).cast("string"), F.col(config["id"]).cast("string")).alias("obs_id"),
        F.col(config["collection"]).cast("string").alias("grp"),
        F.col(config["text"]).alias("text"),
    )
    found = F.explode(F.regexp_extract_all("text", F.lit(config["pattern"]), F.lit(0)))
    x = rows.select("obs_id", found.alias("term")).groupBy("obs_id", F.lower("term").alias("feature_id")).agg(F.count("*").cast("double").alias("value"))
    return rows.select("obs_id", "grp").distinct(), x


def marker_terms(spark: SparkSession, documents: str, output: str, config: dict = DEFAULTS) -> DataFrame:
    """Run the job; the output read back."""
    whole("terms", config["terms"], AnalysisError)
    number("mu", config["mu"], AnalysisError, low=0)
    number("expressed_pct", config["expressed_pct"], AnalysisError, low=0, high=1)
    table = spark.read.parquet(documents)
    require(table, [config[c] for c in ("id", "text", "collection")], AnalysisError, documents)
    usable = F.col(config["id"]).isNotNull() & F.col(config["collection"]).isNotNull()
    counts = table.agg(F.count("*").alias("rows"), F.count_if(~usable).alias("unusable")).first()
    groups, x = term_matrix(table.where(usable), config)
    scratch = Scratch(spark, "marker-terms")  # Parquet keeps repeated terms and identifiers once; rows of a checkpoint do not
    x = scratch.keep("x", x)  # used by several passes; texts are read and split once
    groups = scratch.keep("groups", groups)
    texts = groups.count()
    log.info("read %s: %d rows, %d without identifier or collection, %d texts", documents, counts["rows"], counts["unusable"], texts)

    kept = cut(frequent_features(x, texts, config["min_occurrence"]))
    # the terms kept are few, each being in a share of the texts
    frequent = scratch.keep("frequent", x.join(F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept, "feature_id", "left_semi"))
    scores = cosg_scores(normalised(frequent, "tic"), kept, groups, config["mu"], config["expressed_pct"], True)
    found = frequent.join(groups, "obs_id").groupBy("grp", "feature_id").agg(F.count("*").alias("documents"))
    best = scores.select("grp", "feature_id", F.round("score", DIGITS).alias("score"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "feature_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= config["terms"]).join(found, ["grp", "feature_id"])
    result = best.select("rank", F.col("feature_id").alias("term"), "score", "documents", F.col("grp").alias("collection"))
    result.repartition("collection").sortWithinPartitions("collection", "rank").write.mode("overwrite").partitionBy("collection").parquet(output)
    out = spark.read.schema(OUTPUT).parquet(output)
    log.info("wrote %s: %d terms kept of the texts, %d rows in %d collections", output, kept.count(), out.count(), out.select("collection").distinct().count())
    return out


#: The same rows in SQL over a view ``documents``, with the default settings.
SQL = """WITH d AS (SELECT DISTINCT doc_id, lang AS collection FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL),
w AS (SELECT doc_id, lang AS collection, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{3,}'))) AS term FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL),
x AS (SELECT doc_id, collection, term, count(*)::DOUBLE AS v FROM w GROUP BY ALL),
k AS (SELECT term FROM x GROUP BY term HAVING count(*) / (SELECT count(*) FROM d)::DOUBLE > 0.01::DOUBLE),
n AS (SELECT doc_id, collection, term, v / sum(v) OVER (PARTITION BY doc_id, collection) AS v FROM x SEMI JOIN k USING (term)),
g AS (SELECT collection, count(*) AS size FROM d GROUP BY 1),
c AS (SELECT collection, term, sum(v) AS s, sum(v * v) AS q, count(*) AS documents FROM n GROUP BY ALL),
e AS (SELECT c.*, size, s / (sqrt(sum(q) OVER (PARTITION BY term)) * sqrt(size)) AS cosine FROM c JOIN g USING (collection)),
f AS (SELECT *, CASE WHEN documents < size * 0.02::DOUBLE THEN -1.0 ELSE cosine * cosine * cosine / sum(cosine * cosine) OVER (PARTITION BY term) END AS raw FROM e),
r AS (SELECT row_number() OVER (PARTITION BY collection ORDER BY round(raw, 6) DESC, term) AS rank, term, round(raw, 6)::DOUBLE AS score, documents, collection FROM f)
SELECT rank::INTEGER AS rank, term, score, documents, collection FROM r WHERE rank <= 25"""


if __name__ == "__main__":
    main(marker_terms, DEFAULTS, {"documents": "Parquet table of texts", "output": "folder of the result"}, __doc__)
