"""Engine operators as queries over the sample tables, with the SQL that checks them.

The sample tables stand in for imaging data: suppliers are observations, parts
are features (retail price is the m/z), order lines are pixels whose mark is the
order and whose cell is derived from the supplier, users and event types form
the grid, embeddings are dense vectors with group labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.stats import benjamini_hochberg, spread, tied_rank
from ..session import cut
from ..model import MatrixBundle
from ..operators import analysis, annotate, imaging, peaks, plots, preprocess, qc, quantify, regions, registration, trajectory

PATH = [(0.0, 0.0), (100.0, 100.0), (250.0, 50.0), (500.0, 400.0)]
EXACT = 8  # decimals that survive another order of summation


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = EXACT) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------------------
# views


def sparse(spark: SparkSession, d: str, by_feature: bool = False) -> DataFrame:
    """x(obs_id, feature_id, value) from order lines; sums are exact decimals before they become doubles.

    ``by_feature``: partitioned by feature, for operators that group by it, so that lines are shuffled once.
    """
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("obs_id"), F.col("l_partkey").alias("feature_id"), "l_extendedprice")
    if by_feature:
        lines = lines.repartition("feature_id")
    return lines.groupBy("obs_id", "feature_id").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))


def sparse_bundle(spark: SparkSession, d: str, by_feature: bool = False) -> MatrixBundle:
    obs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_suppkey").alias("obs_ord"), F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("dataset"), F.pmod("s_suppkey", F.lit(10)).cast("double").alias("x"), F.floor(F.col("s_suppkey") / 10).cast("double").alias("y"))
    var = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_partkey").alias("feature_ord"), F.col("p_retailprice").alias("mz"))
    return MatrixBundle(obs, var, sparse(spark, d, by_feature))


_X = """x AS (SELECT l_suppkey AS obs_id, l_partkey AS feature_id, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY ALL)"""


def rasters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cell pixels, laser pixels, marks): one pixel per order and line."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), "l_suppkey")
    px = spread(lines, ["row", "col"], lines.count()).groupBy("row", "col").agg(F.min("l_suppkey").alias("s"))
    px = px.where("row > 0")
    cells = px.select("row", "col", (F.col("s") % 5 + 1).alias("label"))
    laser = px.select("row", "col", F.col("row").alias("label"))
    marks = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("obs_id"), F.col("o_orderkey").cast("string").alias("seg_label"), F.col("o_orderkey").cast("double").alias("centroid_row"), F.lit(3.0).alias("centroid_col"), F.lit(8.0).alias("area"))
    return cells, laser, marks.where("seg_label <> '0'")


def mark_spectra(spark: SparkSession, d: str) -> DataFrame:
    """x of marks: quantity by line status and return flag."""
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("obs_id"), F.concat("l_returnflag", "l_linestatus").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))


_RASTER = """
px AS (SELECT l_orderkey AS "row", l_linenumber AS col, min(l_suppkey) % 5 + 1 AS cell FROM lineitem WHERE l_orderkey > 0 GROUP BY ALL),
marks AS (SELECT 'o' || o_orderkey AS obs_id, o_orderkey AS label, o_orderkey::DOUBLE AS centroid_row, 3.0::DOUBLE AS centroid_col, 8.0::DOUBLE AS area FROM orders WHERE o_orderkey <> 0),
box AS (SELECT min(centroid_row) - 20 AS r0, max(centroid_row) + 20 AS r1, min(centroid_col) - 20 AS c0, max(centroid_col) + 20 AS c1 FROM marks),
cells AS (SELECT cell AS label, count(*) AS area, avg("row") AS centroid_row, avg(col) AS centroid_col, 'c' || cell AS cell_id FROM px GROUP BY cell
          HAVING avg("row") > (SELECT r0 FROM box) AND avg("row") < (SELECT r1 FROM box) AND avg(col) > (SELECT c0 FROM box) AND avg(col) < (SELECT c1 FROM box)),
areas AS (SELECT "row" AS label, count(*) AS laser_area FROM px GROUP BY 1),
o AS (SELECT c.cell_id, px.cell AS cell_label, px."row" AS laser_label, m.obs_id AS laser_obs_id, count(*) AS occupied_pixels, any_value(a.laser_area) AS laser_area,
             count(*) / any_value(a.laser_area)::DOUBLE AS occupied_ratio
      FROM px JOIN cells c ON c.label = px.cell JOIN marks m ON m.label = px."row" JOIN areas a ON a.label = px."row" GROUP BY ALL),
r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY occupied_ratio DESC, cell_id) AS k,
             max(occupied_ratio) OVER w AS top, nth_value(occupied_ratio, 2) OVER (w ORDER BY occupied_ratio DESC, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS snd
      FROM o WINDOW w AS (PARTITION BY laser_label)),
s AS (SELECT * EXCLUDE (n, k, top, snd), CASE
        WHEN n = 1 AND occupied_ratio > 0.1::DOUBLE THEN NULL WHEN n = 1 THEN 'unique_overlap_not_above_threshold'
        WHEN top > snd AND top > 0.6::DOUBLE AND snd < 0.15::DOUBLE AND k = 1 THEN NULL
        WHEN top > snd AND top > 0.6::DOUBLE AND snd < 0.15::DOUBLE THEN 'non_dominant_mapping'
        ELSE 'ambiguous_multi_mapping' END AS rejection_reason FROM r),
mx AS (SELECT 'o' || l_orderkey AS obs_id, l_returnflag || l_linestatus AS feature_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, x, groups) of the embeddings."""
    e = table(spark, d, "embeddings")
    vec = F.transform("embedding", lambda v: v.cast("double"))
    points = e.select(F.col("vec_id").alias("obs_id"), F.col("vec_id").alias("obs_ord"), vec.alias("vec"))
    x = points.select("obs_id", F.posexplode("vec").alias("feature_id", "value")).where("value <> 0")
    groups = e.select(F.col("vec_id").alias("obs_id"), F.col("vec_id").alias("obs_ord"), F.col("label").cast("string").alias("grp"))
    return points, x, groups


def dense_var(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return spark.range(n).select(F.col("id").cast("int").alias("feature_id"), F.col("id").alias("feature_ord"))


_DENSE = """e AS (SELECT vec_id AS obs_id, label::VARCHAR AS grp, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS feature_id FROM embeddings)"""


def region_view(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("label"), (F.col("s_nationkey") + 1).cast("double").alias("area"), F.col("s_acctbal").alias("centroid_row"), F.col("s_suppkey").cast("double").alias("centroid_col"))


_REGION = """g AS (SELECT s_suppkey AS label, (s_nationkey + 1)::DOUBLE AS area, s_acctbal AS centroid_row, s_suppkey::DOUBLE AS centroid_col FROM supplier)"""


def grid_view(spark: SparkSession, d: str, marks_per_row: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pixels, regions): users by event types; marks of the row are users, of the column event types."""
    cells = table(spark, d, "events").select("user_id", "event_type").distinct()
    x = F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type"))
    cells = cells.withColumn("k", x)
    pixels = cells.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("obs_id"), F.col("k").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"))
    marks = cells if marks_per_row is None else cells.where(F.col("k") <= marks_per_row)
    return pixels, marks.select((F.col("user_id") + 1).cast("int").alias("row_number"), F.col("k").cast("int").alias("column_number"), F.concat_ws("_", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("seg_label"), F.lit("intact").alias("morphology"), (F.col("user_id") * 10.0).alias("centroid_row"), (F.col("k") * 10.0).alias("centroid_col"))


_GRID = """cells AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS k FROM (SELECT DISTINCT user_id, event_type FROM events)),
pixels AS (SELECT user_id || '/' || event_type AS obs_id, k::DOUBLE AS x, user_id::DOUBLE AS y FROM cells),
pr AS (SELECT obs_id, x, y, dense_rank() OVER (ORDER BY y) AS kr, row_number() OVER (PARTITION BY y ORDER BY x) AS j, count(*) OVER (PARTITION BY y) AS n FROM pixels)"""


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --------------------------------------------------------------------------
# quantification


def _overlaps(spark, d):
    cells, laser, marks = rasters(spark, d)
    return quantify.overlap_table(cells, laser, marks, pixels=table(spark, d, "lineitem").count())[0]


@query("overlap_table", f"WITH {_RASTER} SELECT * FROM o")
def overlap_table(spark, d):
    return _overlaps(spark, d)


@query("overlap_cells", f"WITH {_RASTER} SELECT label, area, round(centroid_row, 8) AS centroid_row, round(centroid_col, 8) AS centroid_col, cell_id FROM cells")
def overlap_cells(spark, d):
    cells, laser, marks = rasters(spark, d)
    return rounded(quantify.overlap_table(cells, laser, marks)[1], "centroid_row", "centroid_col")


@query("specificity_select", f"WITH {_RASTER} SELECT * FROM s")
def specificity_select(spark, d):
    return quantify.select_specific(_overlaps(spark, d))


@query("specificity_select_strict", f"WITH {_RASTER} SELECT * EXCLUDE (rejection_reason), CASE WHEN rejection_reason IS NULL AND count(*) OVER (PARTITION BY laser_label) = 1 THEN 'unique_overlap_not_above_threshold' ELSE rejection_reason END AS rejection_reason FROM s")
def specificity_select_strict(spark, d):
    """With a threshold of 1 no unique overlap passes, as the test is strict."""
    return quantify.select_specific(_overlaps(spark, d), unique_min=1.0)


@query("legacy_quantify", f"WITH {_RASTER} SELECT cell_id, feature_id, round(sum(value * occupied_ratio), 6) AS value FROM o JOIN mx ON mx.obs_id = laser_obs_id GROUP BY ALL")
def legacy_quantify(spark, d):
    return rounded(quantify.legacy_abundance(_overlaps(spark, d), mark_spectra(spark, d)), "value", digits=6)


@query("specificity_quantify", f"""WITH {_RASTER}, t AS (SELECT laser_label, sum(occupied_pixels) AS total FROM o GROUP BY 1),
a AS (SELECT s.*, occupied_pixels / total::DOUBLE AS w FROM s JOIN t USING (laser_label) WHERE rejection_reason IS NULL),
ws AS (SELECT cell_id, sum(w) AS sw FROM a GROUP BY 1)
SELECT cell_id, feature_id, round(sum(value * w * occupied_ratio) / any_value(sw), 6) AS value FROM a JOIN mx ON mx.obs_id = laser_obs_id JOIN ws USING (cell_id) GROUP BY cell_id, feature_id""")
def specificity_quantify(spark, d):
    overlaps = _overlaps(spark, d)
    accepted = quantify.select_specific(overlaps).where("rejection_reason IS NULL")
    return rounded(quantify.specificity_abundance(overlaps, accepted, mark_spectra(spark, d)), "value", digits=6)


@query("mapping_text", f"""WITH {_RASTER}, m AS (SELECT cell_id, string_agg(laser_label::VARCHAR, '_' ORDER BY laser_label) AS l, string_agg(occupied_pixels::VARCHAR, '_' ORDER BY laser_label) AS p FROM s WHERE rejection_reason IS NULL GROUP BY 1)
SELECT label, cell_id, CASE WHEN l IS NULL THEN 'zero' ELSE 'quantified' END AS quantification_status, coalesce(l, '0') AS laser_labels, coalesce(p, '0') AS laser_coverage FROM cells LEFT JOIN m USING (cell_id)""")
def mapping_text(spark, d):
    cells, laser, marks = rasters(spark, d)
    overlaps, table_ = quantify.overlap_table(cells, laser, marks)
    accepted = quantify.select_specific(overlaps).where("rejection_reason IS NULL")
    return quantify.mapping_text(table_.select("label", "cell_id"), accepted)


@query("quantify_report", f"WITH {_RASTER} SELECT (SELECT count(*) FROM cells) AS included_cells, count(DISTINCT cell_id) FILTER (rejection_reason IS NULL) AS quantified_cells, count(*) FILTER (rejection_reason IS NULL) AS accepted_overlaps, count(*) FILTER (rejection_reason IS NOT NULL) AS rejected_overlaps FROM s")
def quantify_report(spark, d):
    cells, laser, marks = rasters(spark, d)
    return quantify.quantify_cells(MatrixBundle(marks, marks, mark_spectra(spark, d)), cells, laser).report


@query("mixed_residuals", f"""WITH {_RASTER}, occ AS (SELECT laser_obs_id AS obs_id, sum(occupied_pixels) AS p FROM o GROUP BY 1)
SELECT m.obs_id, round(least(1, greatest(0, 1 - coalesce(p, 0) / 8.0::DOUBLE)), 8) AS residual_fraction FROM marks m LEFT JOIN occ USING (obs_id) WHERE greatest(0, 8 - coalesce(p, 0)) * 10 >= 2 * 8""")
def mixed_residuals(spark, d):
    marks = rasters(spark, d)[2]
    return rounded(quantify.residual_marks(marks, _overlaps(spark, d)).select("obs_id", "residual_fraction"), "residual_fraction")


@query("mixed_spectra", f"""WITH {_RASTER}, occ AS (SELECT laser_obs_id AS obs_id, sum(occupied_pixels) AS p FROM o GROUP BY 1),
res AS (SELECT m.obs_id, least(1, greatest(0, 1 - coalesce(p, 0) / 8.0::DOUBLE)) AS f FROM marks m LEFT JOIN occ USING (obs_id) WHERE greatest(0, 8 - coalesce(p, 0)) * 10 >= 2 * 8)
SELECT cell_id AS obs_id, feature_id, round(sum(value * occupied_ratio), 6) AS value FROM o JOIN mx ON mx.obs_id = laser_obs_id GROUP BY ALL
UNION ALL SELECT 'laser_residual_' || obs_id, feature_id, round(value * f, 6) FROM res JOIN mx USING (obs_id) WHERE value * f <> 0""")
def mixed_spectra(spark, d):
    cells, laser, marks = rasters(spark, d)
    features = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("feature_id")).distinct()
    order = F.row_number().over(Window.orderBy("feature_id"))  # a handful
    var = features.withColumn("feature_ord", order).withColumn("mz", 100.0 + F.col("feature_ord"))
    bundle = MatrixBundle(marks, cut(var), mark_spectra(spark, d))
    found = quantify.quantify_cells(bundle, cells, laser, method="legacy_proportional")
    return rounded(quantify.mixed_bundle(found.bundle, bundle, found.accepted).x, "value", digits=6)


@query("partition_check", f"WITH {_RASTER} SELECT cell_id, laser_label FROM o WHERE FALSE")
def partition_check(spark, d):
    overlaps = cut(_overlaps(spark, d))  # read by both sides
    judged = quantify.select_specific(overlaps)
    accepted, rejected = judged.where("rejection_reason IS NULL"), judged.where("rejection_reason IS NOT NULL")
    return quantify.partition_difference(overlaps, accepted, rejected).select("cell_id", "laser_label")


# --------------------------------------------------------------------------
# preprocessing


@query("feature_occurrence", f"WITH {_X} SELECT feature_id, count(*) AS n FROM x WHERE value <> 0 GROUP BY 1")
def feature_occurrence(spark, d):
    return preprocess.occurrence(sparse(spark, d))


@query("filter_features", f"WITH {_X} SELECT feature_id FROM x WHERE value <> 0 GROUP BY 1 HAVING count(*)::DOUBLE / (SELECT count(*) FROM supplier) > 0.25::DOUBLE")
def filter_features(spark, d):
    return preprocess.frequent_features(sparse(spark, d), table(spark, d, "supplier").count(), 0.25)


@query("normalize_rms", f"WITH {_X}, f AS (SELECT obs_id, sqrt(sum(value * value) / (SELECT count(*) FROM part)) AS f FROM x GROUP BY 1) SELECT obs_id, feature_id, round(value / CASE WHEN f = 0 THEN 1 ELSE f END, 8) AS value FROM x JOIN f USING (obs_id)")
def normalize_rms(spark, d):
    return rounded(preprocess.normalised(sparse(spark, d), "rms", table(spark, d, "part").count()), "value")


@query("normalize_tic", f"WITH {_X}, f AS (SELECT obs_id, sum(abs(value)) AS f FROM x GROUP BY 1) SELECT obs_id, feature_id, round(value / CASE WHEN f = 0 THEN 1 ELSE f END, 8) AS value FROM x JOIN f USING (obs_id)")
def normalize_tic(spark, d):
    return rounded(preprocess.normalised(sparse(spark, d), "tic"), "value")


@query("matrix_removal_reference", "SELECT p_partkey AS feature_id, p_retailprice AS mz, 'reference_match' AS reason FROM part p WHERE EXISTS (SELECT 1 FROM customer r WHERE r.c_acctbal > 0 AND abs(r.c_acctbal - p.p_retailprice) <= p.p_retailprice * 50.0::DOUBLE / 1e6::DOUBLE)")
def matrix_removal_reference(spark, d):
    b = sparse_bundle(spark, d)
    reference = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_acctbal").alias("mz"))  # masses are positive
    return preprocess.remove_matrix_peaks(b, "reference", reference=reference, tolerance=50)[1]


@query("matrix_removal_blank", f"WITH {_X}, b AS (SELECT s_suppkey AS obs_id FROM supplier WHERE s_nationkey IN (0, 1, 2)), n AS (SELECT feature_id, count(*) AS n FROM x SEMI JOIN b USING (obs_id) WHERE value <> 0 GROUP BY 1) SELECT feature_id, p_retailprice AS mz, 'blank_frequency' AS reason FROM n JOIN part ON p_partkey = feature_id WHERE n / (SELECT count(*) FROM b)::DOUBLE > 0.3::DOUBLE")
def matrix_removal_blank(spark, d):
    return preprocess.remove_matrix_peaks(sparse_bundle(spark, d), "blank", blanks=["d0", "d1", "d2"], matrix_frequency=0.3)[1]


@query("matrix_removal_denovo", f"WITH {_X}, o AS (SELECT s_suppkey AS obs_id, s_suppkey % 10 AS px, s_suppkey // 10 AS py FROM supplier), b AS (SELECT obs_id FROM o WHERE px IN (SELECT min(px) FROM o UNION ALL SELECT max(px) FROM o) OR py IN (SELECT min(py) FROM o UNION ALL SELECT max(py) FROM o)), n AS (SELECT feature_id, count(*) AS n FROM x SEMI JOIN b USING (obs_id) WHERE value <> 0 GROUP BY 1) SELECT feature_id, p_retailprice AS mz, 'edge_frequency' AS reason FROM n JOIN part ON p_partkey = feature_id WHERE n / (SELECT count(*) FROM b)::DOUBLE > 0.3::DOUBLE")
def matrix_removal_denovo(spark, d):
    return preprocess.remove_matrix_peaks(sparse_bundle(spark, d), "denovo", matrix_frequency=0.3)[1]


# --------------------------------------------------------------------------
# peak axes


def _peaks(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 50).cast("int").alias("pixel_ord"), F.col("p_partkey").alias("peak_ord"), F.col("p_retailprice").alias("mz"), F.col("p_size").cast("double").alias("intensity"))


@query("profile_bins", "WITH m AS (SELECT floor(min(p_retailprice) / 2.5::DOUBLE) * 2.5::DOUBLE AS start FROM part) SELECT (p_partkey % 50)::INTEGER AS pixel_ord, floor((p_retailprice - start) / 2.5::DOUBLE)::INTEGER AS col_ord, sum(p_size)::DOUBLE AS value FROM part, m GROUP BY ALL")
def profile_bins(spark, d):
    return peaks.bin_profiles(_peaks(spark, d), 2.5)[1]


@query("profile_axis", "WITH m AS (SELECT floor(min(p_retailprice) / 2.5::DOUBLE) * 2.5::DOUBLE AS start, max(p_retailprice) AS high FROM part) SELECT i::INTEGER AS col_ord, start + (i + 0.5::DOUBLE) * 2.5::DOUBLE AS mz FROM (SELECT start, unnest(range(0, floor((high - start) / 2.5::DOUBLE)::BIGINT + 1)) AS i FROM m)")
def profile_axis(spark, d):
    return peaks.bin_profiles(_peaks(spark, d), 2.5)[0]


@query("nearest_projection", """WITH axis AS (SELECT row_number() OVER (ORDER BY mz) - 1 AS col_ord, mz FROM (SELECT DISTINCT floor(p_retailprice) AS mz FROM part)),
c AS (SELECT p_partkey, p_size, col_ord, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(mz - p_retailprice), col_ord) AS k FROM part JOIN axis ON abs(mz - p_retailprice) <= p_retailprice * 300.0::DOUBLE / 1e6::DOUBLE)
SELECT (p_partkey % 50)::INTEGER AS pixel_ord, col_ord::INTEGER AS col_ord, sum(p_size)::DOUBLE AS value FROM c WHERE k = 1 GROUP BY ALL""")
def nearest_projection(spark, d):
    axis = table(spark, d, "part").select(F.floor("p_retailprice").cast("double").alias("mz")).distinct()
    axis = axis.withColumn("col_ord", (F.row_number().over(Window.orderBy("mz")) - 1).cast("int"))  # the axis is the query's small side
    return peaks.project(_peaks(spark, d), axis, 300)


_FOLD = """v AS (SELECT list(mz ORDER BY mz) AS ms FROM (SELECT p_retailprice AS mz FROM part)),
f AS (
  WITH RECURSIVE w(i, g, first_mz, total, n) AS (
    SELECT 1, 0, ms[1], ms[1], 1 FROM v
    UNION ALL
    SELECT i + 1, CASE WHEN ok THEN g ELSE g + 1 END, CASE WHEN ok THEN first_mz ELSE m END, CASE WHEN ok THEN total + m ELSE m END, CASE WHEN ok THEN n + 1 ELSE 1 END
    FROM (SELECT w.*, ms[i + 1] AS m, abs(first_mz - (total + ms[i + 1]) / (n + 1)) <= first_mz * 20.0::DOUBLE / 1e6::DOUBLE AND abs(ms[i + 1] - (total + ms[i + 1]) / (n + 1)) <= ms[i + 1] * 20.0::DOUBLE / 1e6::DOUBLE AS ok FROM w, v WHERE i < len(ms))
  ) SELECT g, max(i) AS i FROM w GROUP BY g
), c AS (SELECT g, ms[coalesce(lag(i) OVER (ORDER BY g), 0) + 1 : i] AS members FROM f, v)"""


@query("consensus_axis", f"WITH {_FOLD} SELECT g::INTEGER AS col_ord, round(list_sum(members) / len(members), 6) AS mz FROM c")
def consensus_axis(spark, d):
    return rounded(peaks.consensus_axis(_peaks(spark, d).select("mz"), 20), "mz", digits=6)


@query("align_peaks", f"WITH {_X}, {_FOLD}, g2 AS (SELECT g, unnest(list_distinct(members)) AS mz FROM c) SELECT obs_id, 'm' || (g + 1) AS feature_id, round(sum(value), 4) AS value FROM x JOIN part ON p_partkey = feature_id JOIN g2 ON g2.mz = p_retailprice GROUP BY ALL")
def align_peaks(spark, d):
    return rounded(peaks.align_features(sparse_bundle(spark, d), 20).x, "value", digits=4)


# --------------------------------------------------------------------------
# annotation


def _reference(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("ref_ord"), F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("accession"), F.col("p_retailprice").alias("ref_mz"))


_ANNOTATE = """SELECT p.p_partkey AS feature_id, coalesce('[' || string_agg('"H' || r.p_partkey || '"', ',' ORDER BY r.p_partkey) || ']', '[]') AS hits
FROM part p LEFT JOIN part r ON {on} GROUP BY 1"""


@query("annotate_ppm", _ANNOTATE.format(on="abs(r.p_retailprice - p.p_retailprice) <= p.p_retailprice * 75.0::DOUBLE / 1e6::DOUBLE + 1e-12::DOUBLE"))
def annotate_ppm(spark, d):
    var = sparse_bundle(spark, d).var
    return annotate.annotate(var, _reference(spark, d), {"hits": F.col("accession")}, 75).select("feature_id", "hits")


@query("annotate_exact", _ANNOTATE.format(on="r.p_retailprice = p.p_retailprice"))
def annotate_exact(spark, d):
    var = sparse_bundle(spark, d).var
    return annotate.annotate(var, _reference(spark, d), {"hits": F.col("accession")}, 0).select("feature_id", "hits")


# --------------------------------------------------------------------------
# regions and registration

_NUMBERED = """, h AS (SELECT *, sum(b) OVER (ORDER BY centroid_row, centroid_col, label) + 1 AS rn FROM cut)
SELECT label, rn::INTEGER AS row_number, (row_number() OVER (PARTITION BY rn ORDER BY centroid_col, centroid_row, label::VARCHAR))::INTEGER AS column_number,
  (row_number() OVER (PARTITION BY rn ORDER BY centroid_col, centroid_row, label::VARCHAR) - count(*) OVER (PARTITION BY rn) - 1)::INTEGER AS right_to_left FROM h"""
_NUMBERS = ["label", "row_number", "column_number", "right_to_left"]


@query("row_breaks_gap", f"""WITH {_REGION}, q AS (SELECT *, centroid_row - lag(centroid_row) OVER (ORDER BY centroid_row, centroid_col, label) AS gap FROM g),
m AS (SELECT median(gap) AS med FROM q), n AS (SELECT median(abs(gap - med)) AS mad FROM q, m),
cut AS (SELECT q.*, CASE WHEN gap > med + greatest(5 * mad, 2.220446049250313e-16::DOUBLE) THEN 1 ELSE 0 END AS b FROM q, m, n) {_NUMBERED}""")
def row_breaks_gap(spark, d):
    return regions.detect_rows(region_view(spark, d)).select(_NUMBERS)


@query("row_breaks_expected", f"""WITH {_REGION}, q AS (SELECT *, row_number() OVER (ORDER BY centroid_row, centroid_col, label) AS pos, centroid_row - lag(centroid_row) OVER (ORDER BY centroid_row, centroid_col, label) AS gap FROM g),
cut AS (SELECT *, CASE WHEN gap IS NOT NULL AND row_number() OVER (ORDER BY gap DESC NULLS LAST, pos) <= 4 THEN 1 ELSE 0 END AS b FROM q) {_NUMBERED}""")
def row_breaks_expected(spark, d):
    return regions.detect_rows(region_view(spark, d), expected_rows=5).select(_NUMBERS)


@query("row_breaks_variance", f"""WITH {_REGION}, q AS (SELECT *, row_number() OVER w AS pos, count(*) OVER () AS n, var_pop(centroid_row) OVER (ORDER BY centroid_row, centroid_col, label ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM g WINDOW w AS (ORDER BY centroid_row, centroid_col, label)),
c AS (SELECT *, CASE WHEN pos >= 5 AND pos < n AND v > 20000 THEN 1 ELSE 0 END AS cand FROM q),
cut AS (SELECT *, CASE WHEN cand = 1 AND (sum(cand) OVER (ORDER BY pos) - 1) % 4 = 0 THEN 1 ELSE 0 END AS b FROM c) {_NUMBERED}""")
def row_breaks_variance(spark, d):
    return regions.detect_rows(region_view(spark, d), method="rolling_variance", variance_threshold=20000).select(_NUMBERS)


@query("exclude_regions", f"WITH {_REGION} SELECT * FROM g WHERE centroid_row BETWEEN 0 AND 5000 AND centroid_col >= 10")
def exclude_regions(spark, d):
    return regions.exclude_regions(region_view(spark, d), min_row=0, max_row=5000, min_column=10)


def _nation_rows(spark, d):
    s = table(spark, d, "supplier")
    base = s.select(F.col("s_suppkey").alias("label"), F.lit(1.0).alias("area"), F.col("s_nationkey").cast("double").alias("centroid_row"), F.col("s_suppkey").cast("double").alias("centroid_col"), (F.col("s_nationkey") + 1).cast("int").alias("row_number"), F.col("s_suppkey").cast("string").alias("seg_label"), F.lit("intact").alias("morphology"))
    base = base.withColumn("column_number", F.row_number().over(Window.partitionBy("row_number").orderBy("label")))
    rules = s.groupBy((F.col("s_nationkey") + 1).cast("int").alias("row_number")).agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b")).where("a < b")
    return base, rules.select("row_number", F.concat_ws(",", F.col("a").cast("string"), F.col("b").cast("string")).alias("source_labels"))


@query("merge_regions", """WITH e AS (SELECT min(s_suppkey) AS a, max(s_suppkey) AS b, s_nationkey AS k FROM supplier GROUP BY s_nationkey HAVING min(s_suppkey) < max(s_suppkey)),
act AS (SELECT s_suppkey::VARCHAR AS seg_label, 'intact' AS morphology, s_nationkey + 1 AS rn, s_suppkey::DOUBLE AS c, 1.0::DOUBLE AS area FROM supplier WHERE s_suppkey NOT IN (SELECT a FROM e UNION ALL SELECT b FROM e)
  UNION ALL SELECT a || '_' || b, 'combined', k + 1, (a + b) / 2.0::DOUBLE, 2.0::DOUBLE FROM e)
SELECT seg_label, morphology, rn::INTEGER AS row_number, row_number() OVER (PARTITION BY rn ORDER BY c, seg_label)::INTEGER AS column_number, area FROM act
UNION ALL SELECT s_suppkey::VARCHAR, 'spoilt', (s_nationkey + 1)::INTEGER, old, 1.0::DOUBLE
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INTEGER AS old FROM supplier) WHERE s_suppkey IN (SELECT a FROM e UNION ALL SELECT b FROM e)""")
def merge_regions(spark, d):
    return regions.merge_regions(*_nation_rows(spark, d)).select("seg_label", "morphology", "row_number", "column_number", "area")


@query("register_rank_zip", f"WITH {_GRID} SELECT obs_id AS pixel_id, kr::INTEGER AS row_number, j::INTEGER AS column_number FROM pr")
def register_rank_zip(spark, d):
    mapping = registration.rank_zip(*grid_view(spark, d))
    return _ranked_rows(mapping)


def _ranked_rows(mapping):
    rank = F.dense_rank().over(Window.orderBy("row_number"))  # a report over grid rows
    return mapping.select("pixel_id", rank.cast("int").alias("row_number"), "column_number")


@query("register_truncate_left", f"WITH {_GRID} SELECT obs_id AS pixel_id, kr::INTEGER AS row_number, (j - (n - least(n, 3)))::INTEGER AS column_number FROM pr WHERE j > n - least(n, 3)")
def register_truncate_left(spark, d):
    return _ranked_rows(registration.rank_zip(*grid_view(spark, d, 3), edge_policy="truncate_left"))


@query("register_truncate_right", f"WITH {_GRID} SELECT obs_id AS pixel_id, kr::INTEGER AS row_number, j::INTEGER AS column_number FROM pr WHERE j <= 3")
def register_truncate_right(spark, d):
    return _ranked_rows(registration.rank_zip(*grid_view(spark, d, 3), edge_policy="truncate_right"))


for _name in registration.ORIENTATIONS:
    _sx, _sy = ("y", "x") if _name.startswith("swap") else ("x", "y")
    _ox = f"min({_sx}) OVER () + max({_sx}) OVER () - {_sx}" if _name.endswith(("flip_x", "flip_xy")) else _sx
    _oy = f"min({_sy}) OVER () + max({_sy}) OVER () - {_sy}" if _name.endswith(("flip_y", "flip_xy")) else _sy

    @query(f"orient_{_name}", f"WITH {_GRID} SELECT obs_id, ({_ox})::DOUBLE AS x, ({_oy})::DOUBLE AS y FROM pixels")
    def _orient(spark, d, name=_name):
        return registration.orient(grid_view(spark, d)[0], name)


# --------------------------------------------------------------------------
# quality control


@query("spectral_qc", f"WITH {_X} SELECT s_suppkey AS obs_id, round(coalesce(sum(value), 0), 4) AS total_intensity, count(value) FILTER (value <> 0) AS detected_features FROM supplier LEFT JOIN x ON obs_id = s_suppkey GROUP BY 1")
def spectral_qc(spark, d):
    b = sparse_bundle(spark, d)
    return rounded(qc.spectral_qc(b.obs, b.x), "total_intensity", digits=4)


@query("coverage_report", f"""WITH {_RASTER}, q AS (SELECT count(*)::DOUBLE AS inc, (SELECT count(DISTINCT cell_id) FROM s WHERE rejection_reason IS NULL)::DOUBLE AS quant FROM cells)
SELECT 'included_cells' AS metric, inc AS value FROM q UNION ALL SELECT 'quantified_cells', quant FROM q UNION ALL SELECT 'coverage_fraction', CASE WHEN inc = 0 THEN 0 ELSE quant / inc END FROM q""")
def coverage_report(spark, d):
    return qc.coverage_report(mapping_text(spark, d))


@query("registration_report", f"WITH {_GRID}, t AS (SELECT kr, least(max(n), 3) AS r, max(n) - least(max(n), 3) AS c FROM pr GROUP BY kr) SELECT 'registered_pixels' AS metric, sum(r)::DOUBLE AS value FROM t UNION ALL SELECT 'truncated_pixels', sum(c)::DOUBLE FROM t")
def registration_report(spark, d):
    mapping = registration.rank_zip(*grid_view(spark, d, 3), edge_policy="truncate_left")
    report = mapping.groupBy("row_number").agg(F.count("*").alias("registered_pixels"), F.max("truncated").alias("truncated_pixels"))
    return qc.registration_report(report)


@query("braycurtis_pairs", f"WITH {_X}, t AS (SELECT obs_id, sum(value) AS s FROM x GROUP BY 1), m AS (SELECT a.obs_id AS i, b.obs_id AS j, sum(least(a.value, b.value)) AS m FROM x a JOIN x b USING (feature_id) WHERE a.obs_id < b.obs_id GROUP BY ALL) SELECT i, j, round(1 - 2 * m / (p.s + q.s), 8) AS distance FROM m JOIN t p ON p.obs_id = i JOIN t q ON q.obs_id = j")
def braycurtis_pairs(spark, d):
    return rounded(qc.bray_curtis(sparse(spark, d, by_feature=True)), "distance")


_PAIR_SQL = {
    "euclidean": "sqrt(sum((a.value - b.value) ** 2))", "sqeuclidean": "sum((a.value - b.value) ** 2)", "manhattan": "sum(abs(a.value - b.value))", "chebyshev": "max(abs(a.value - b.value))",
    "cosine": "greatest(0, 1 - sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)))", "canberra": "sum(abs(a.value - b.value) / (abs(a.value) + abs(b.value)))", "correlation": "greatest(0, 1 - corr(a.value, b.value))",
}
for _name, _sql in _PAIR_SQL.items():

    @query(f"distance_{_name}", f"WITH {_DENSE} SELECT a.obs_id AS i, b.obs_id AS j, round({_sql}, 6) AS distance FROM e a JOIN e b USING (feature_id) WHERE a.obs_id <> b.obs_id GROUP BY ALL")
    def _distance(spark, d, name=_name):
        """The distance matrix: all pairs are the result."""
        return blocks.pairwise(dense(spark, d)[0], name, digits=6)


@query("silhouette_summary", f"""WITH {_DENSE}, p AS (SELECT a.obs_id, any_value(a.grp) AS g, b.grp AS o, b.obs_id AS other, sqrt(sum((a.value - b.value) ** 2)) AS dist FROM e a JOIN e b USING (feature_id) WHERE a.obs_id <> b.obs_id GROUP BY a.obs_id, b.obs_id, b.grp),
m AS (SELECT obs_id, any_value(g) AS g, o, avg(dist) AS dist FROM p GROUP BY obs_id, o),
ab AS (SELECT obs_id, any_value(g) AS g, max(dist) FILTER (o = g) AS a, min(dist) FILTER (o <> g) AS b FROM m GROUP BY obs_id)
SELECT g AS cluster, count(*) AS n_cells, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS mean_silhouette, min(obs_id) AS first_ord FROM ab GROUP BY g""")
def silhouette_summary(spark, d):
    points, _, groups = dense(spark, d)
    return rounded(qc.silhouette_summary(points, groups.select("obs_id", F.col("grp").alias("cluster"))), "mean_silhouette", digits=6)


@query("detect_outliers")
def detect_outliers(spark, d):
    b = sparse_bundle(spark, d)
    return qc.detect_outliers(qc.spectral_qc(b.obs, b.x), 0.05, 7)


@query("pcoa")
def pcoa(spark, d):
    return qc.leading_coordinates(sparse_bundle(spark, d, by_feature=True), 2)[0]


# --------------------------------------------------------------------------
# analysis

_MOMENTS = f"""{_DENSE}, z AS (SELECT grp, count(DISTINCT obs_id) AS n FROM e GROUP BY 1), gm AS (SELECT feature_id, e.grp, any_value(z.n) AS n, sum(value) AS s, sum(value * value) AS q FROM e JOIN z USING (grp) GROUP BY feature_id, e.grp),
mo AS (SELECT *, sum(s) OVER f - s AS sr, sum(q) OVER f - q AS qr, sum(n) OVER f - n AS nr FROM gm WINDOW f AS (PARTITION BY feature_id)),
vv AS (SELECT *, s / n AS m, sr / nr AS mr, (q - s * s / n) / (n - 1) AS v, (qr - sr * sr / nr) / (nr - 1) AS vr FROM mo)"""


@query("feature_variance_topk", f"WITH {_DENSE}, n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT feature_id, sum(value * value) / any_value(n) - (sum(value) / any_value(n)) ** 2 AS v FROM e, n GROUP BY 1) SELECT feature_id::INTEGER AS feature_id, round(v, 8) AS variance FROM v ORDER BY v.v DESC, feature_id LIMIT 10")
def feature_variance_topk(spark, d):
    points, x, _ = dense(spark, d)
    return rounded(analysis.top_features(x, dense_var(spark, d), points.count(), 10).select("feature_id", "variance"), "variance")


@query("rank_ttest", f"WITH {_MOMENTS} SELECT feature_id::INTEGER AS feature_id, grp, round((m - mr) / sqrt(v / n + vr / nr), 6) AS scores FROM vv")
def rank_ttest(spark, d):
    _, x, groups = dense(spark, d)
    return rounded(analysis.rank_scores(x, dense_var(spark, d), groups, "t-test").select("feature_id", "grp", "scores"), "scores", digits=6)


@query("rank_ttest_overestim", f"WITH {_MOMENTS} SELECT feature_id::INTEGER AS feature_id, grp, round((m - mr) / sqrt(v / n + vr / n), 6) AS scores FROM vv")
def rank_ttest_overestim(spark, d):
    _, x, groups = dense(spark, d)
    return rounded(analysis.rank_scores(x, dense_var(spark, d), groups, "t-test_overestim_var").select("feature_id", "grp", "scores"), "scores", digits=6)


@query("rank_wilcoxon", f"WITH {_DENSE}, r AS (SELECT feature_id, grp, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY feature_id) AS n FROM e) SELECT feature_id::INTEGER AS feature_id, grp, round((sum(rk) - count(*) * (any_value(n) + 1) / 2.0::DOUBLE) / sqrt(count(*) * (any_value(n) - count(*)) * (any_value(n) + 1) / 12.0::DOUBLE), 6) AS scores FROM r GROUP BY feature_id, grp")
def rank_wilcoxon(spark, d):
    _, x, groups = dense(spark, d)
    return rounded(analysis.rank_scores(x, dense_var(spark, d), groups, "wilcoxon").select("feature_id", "grp", "scores"), "scores", digits=6)


@query("rank_metabolites", f"""WITH {_MOMENTS}, sc AS (SELECT grp, feature_id, (m - mr) / sqrt(v / n + vr / nr) AS t, (exp(m) - 1 + 1e-9) / (exp(mr) - 1 + 1e-9) AS f FROM vv),
o AS (SELECT grp, row_number() OVER (ORDER BY min(obs_id)) - 1 AS group_ord FROM e GROUP BY grp)
SELECT grp, group_ord::INTEGER AS group_ord, row_number() OVER (PARTITION BY grp ORDER BY t DESC, feature_id)::INTEGER AS rank, feature_id::INTEGER AS names, round(t, 6) AS scores, CASE WHEN f > 0 THEN round(log2(f), 4) END AS logfoldchanges FROM sc JOIN o USING (grp)""")
def rank_metabolites(spark, d):
    """Without the p-values, whose distribution SQL does not have; tests compare those with quadrature."""
    _, x, groups = dense(spark, d)
    ranked = analysis.rank_metabolites(x, dense_var(spark, d), groups, "t-test").select("grp", "group_ord", "rank", "names", "scores", "logfoldchanges")
    return rounded(rounded(ranked, "scores", digits=6), "logfoldchanges", digits=4)


@query("cosg_scores", f"WITH {_X}, gg AS (SELECT s_suppkey AS obs_id, s_nationkey % 4 AS grp FROM supplier), z AS (SELECT grp, count(*) AS n FROM gg GROUP BY 1), c AS (SELECT feature_id, grp, sum(value) AS s, sum(value * value) AS q FROM x JOIN gg USING (obs_id) GROUP BY ALL), c1 AS (SELECT feature_id, c.grp, s / (sqrt(sum(q) OVER (PARTITION BY feature_id)) * sqrt(n)) AS c FROM c JOIN z ON z.grp = c.grp) SELECT grp::VARCHAR AS grp, feature_id, round(c * (c * c / sum(c * c) OVER (PARTITION BY feature_id)), 8) AS score FROM c1")
def cosg_scores(spark, d):
    b = sparse_bundle(spark, d)
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs_id"), (F.col("s_nationkey") % 4).cast("string").alias("grp"))
    return rounded(analysis.cosg_scores(b.x, b.var, groups), "score")


@query("cosg_table", f"""WITH {_X}, gg AS (SELECT s_suppkey AS obs_id, s_suppkey % 2 AS grp FROM supplier), z AS (SELECT grp, count(*) AS n FROM gg GROUP BY 1),
c AS (SELECT feature_id, grp, sum(value) AS s, sum(value * value) AS q FROM x JOIN gg USING (obs_id) GROUP BY ALL),
c1 AS (SELECT feature_id, c.grp, s / (sqrt(sum(q) OVER (PARTITION BY feature_id)) * sqrt(n)) AS c FROM c JOIN z ON z.grp = c.grp),
r AS (SELECT grp, feature_id, row_number() OVER (PARTITION BY grp ORDER BY c * (c * c / total) DESC, feature_id) AS rank FROM (SELECT *, sum(c * c) OVER (PARTITION BY feature_id) AS total FROM c1))
SELECT rank::INTEGER AS rank, max(feature_id) FILTER (grp = 0) AS "0", max(feature_id) FILTER (grp = 1) AS "1" FROM r WHERE rank <= 20 GROUP BY rank""")
def cosg_table(spark, d):
    b = sparse_bundle(spark, d)
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("obs_id"), F.col("s_suppkey").alias("obs_ord"), (F.col("s_suppkey") % 2).cast("string").alias("grp"))
    return analysis.run_cosg(b.x, b.var, groups)


@query("knn_graph", f"WITH {_DENSE}, p AS (SELECT a.obs_id, b.obs_id AS neighbor, sqrt(sum((a.value - b.value) ** 2)) AS distance FROM e a JOIN e b USING (feature_id) WHERE a.obs_id <> b.obs_id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY distance, neighbor) AS rank FROM p) SELECT obs_id, rank::INTEGER AS rank, neighbor, round(distance, 6) AS distance FROM k WHERE rank <= 5")
def knn_graph(spark, d):
    return rounded(analysis.knn(dense(spark, d)[0], 5), "distance", digits=6)


@query("tied_ranks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem")
def tied_ranks(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = spread(lines, ["l_suppkey"], lines.count())
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tied_rank(["l_suppkey"], "l_quantity").alias("r"))


@query("benjamini_hochberg", "WITH p AS (SELECT event_id, event_type, (event_id % 1009 + 1) / 1010.0::DOUBLE AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM p) SELECT event_id, round(least(1, min(p * n / max_k) OVER (PARTITION BY event_type ORDER BY p DESC)), 8) AS q FROM (SELECT *, max(k) OVER (PARTITION BY event_type, p) AS max_k FROM k)")
def benjamini_hochberg_query(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", ((F.col("event_id") % 1009 + 1) / F.lit(1010.0)).alias("p"))
    out = benjamini_hochberg(e, ["event_type"], "p", "q")
    # ties share the largest rank's value
    return out.select("event_id", F.round(F.min("q").over(Window.partitionBy("event_type", "p")), 8).alias("q"))


@query("clusters")
def clusters(spark, d):
    points, x, groups = dense(spark, d)
    b = MatrixBundle(points.select("obs_id", "obs_ord"), dense_var(spark, d), x)
    return analysis.cluster_cells(b, 10).obs


@query("cnmf_spectra")
def cnmf_spectra(spark, d):
    return analysis.factorize(sparse_bundle(spark, d), [3], n_iter=3, n_features=50)


# --------------------------------------------------------------------------
# trajectory and reports

_SEG = "SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 100.0::DOUBLE, 100.0::DOUBLE), (1, 100.0, 100.0, 250.0, 50.0), (2, 250.0, 50.0, 500.0, 400.0)) t(k, x0, y0, x1, y1)"


_PROJECTED = f"""WITH g0 AS ({_SEG}), g AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM g0), g1 AS (SELECT *, sum(len) OVER (ORDER BY k) - len AS start, sum(len) OVER () AS total FROM g),
c AS (SELECT event_id, k, dx, dy, len, start, total, x0, y0, value AS x, user_id::DOUBLE AS y, greatest(0, least(1, ((value - x0) * dx + (user_id - y0) * dy) / (len * len))) AS t FROM events, g1),
m AS (SELECT *, sqrt((x - (x0 + t * dx)) ** 2 + (y - (y0 + t * dy)) ** 2) AS dist FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, k) AS n FROM m)
SELECT event_id, round((start + t * len) / total, 6) AS trajectory_position, round(dist, 6) AS trajectory_distance FROM r WHERE n = 1"""


@query("polyline_projection", _PROJECTED)
def polyline_projection(spark, d):
    points = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return rounded(trajectory.project_points(points, PATH).drop("x", "y"), "trajectory_position", "trajectory_distance", digits=6)


@query("polyline_projection_exact", _PROJECTED)
def polyline_projection_exact(spark, d):
    points = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return rounded(trajectory.project_points_exact(points, PATH).drop("x", "y"), "trajectory_position", "trajectory_distance", digits=6)


@query("feature_trends")
def feature_trends(spark, d):
    b = sparse_bundle(spark, d)
    last = b.obs.agg(F.max("obs_ord").alias("_last"))
    obs = b.obs.crossJoin(F.broadcast(last)).withColumn("trajectory_position", F.col("obs_ord") / (F.col("_last") + 1)).drop("_last")  # one row
    return trajectory.feature_trends(MatrixBundle(obs, b.var, b.x), points=20)


@query("feature_percentiles", f"WITH {_X} SELECT feature_id, round(quantile_cont(value, 0.01), 8) AS p01, round(quantile_cont(value, 0.99), 8) AS p99, round(avg(value), 8) AS mean FROM x GROUP BY 1")
def feature_percentiles(spark, d):
    out = sparse(spark, d).groupBy("feature_id").agg(F.percentile("value", F.lit(0.01)).alias("p01"), F.percentile("value", F.lit(0.99)).alias("p99"), F.avg("value").alias("mean"))
    return rounded(out, "p01", "p99", "mean")


@query("gallery_summary", f"WITH {_X}, d AS (SELECT p_partkey AS feature_id, coalesce(value, 0) AS v FROM part CROSS JOIN supplier LEFT JOIN x ON feature_id = p_partkey AND obs_id = s_suppkey), q AS (SELECT feature_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, min(v) AS mn, max(v) AS mx, avg(v) AS mean FROM d GROUP BY 1) SELECT feature_id, feature_id AS feature_ord, round(CASE WHEN hi <= lo THEN mn ELSE lo END, 6) AS low, round(CASE WHEN hi <= lo THEN mx + 1 ELSE hi END, 6) AS high, round(mean, 6) AS mean FROM q")
def gallery_summary(spark, d):
    return rounded(plots.gallery_summary(sparse_bundle(spark, d)), "low", "high", "mean", digits=6)


@query("category_codes", "SELECT c_custkey AS obs_id, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer")
def category_codes(spark, d):
    return plots.category_codes(table(spark, d, "customer").select(F.col("c_custkey").alias("obs_id"), "c_mktsegment"), "c_mktsegment")


@query("contours", """WITH px AS (SELECT l_orderkey AS r, l_linenumber AS c, min(l_suppkey) % 5 AS label FROM lineitem GROUP BY ALL HAVING min(l_suppkey) % 5 <> 0),
s AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)), a AS (SELECT r + dy AS r, c + dx AS c, label AS f FROM px, s WHERE r + dy BETWEEN 0 AND 999999999 AND c + dx BETWEEN 0 AND 7)
SELECT DISTINCT a.r AS "row", a.c AS col FROM a LEFT JOIN px USING (r, c) WHERE px.label IS NULL OR px.label <> a.f""")
def contours(spark, d):
    px = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg((F.min("l_suppkey") % 5).alias("label"))
    return plots.contour_plot(px, 1_000_000_000, 8)


@query("spatial_feature", f"WITH {_X} SELECT s_suppkey AS obs_id, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10)::DOUBLE AS y, coalesce(value, 0)::DOUBLE AS value FROM supplier LEFT JOIN x ON obs_id = s_suppkey AND feature_id = 7")
def spatial_feature(spark, d):
    b = sparse_bundle(spark, d)
    return plots.spatial_plot(MatrixBundle(b.obs, b.var.withColumn("feature_id", F.col("feature_id").cast("string")), b.x.withColumn("feature_id", F.col("feature_id").cast("string"))), "7")


@query("region_table", f"WITH {_RASTER} SELECT cell AS label, count(*)::DOUBLE AS area, round(avg(\"row\"), 8) AS centroid_row, round(avg(col), 8) AS centroid_col FROM px GROUP BY 1")
def region_table(spark, d):
    return rounded(regions.region_table(rasters(spark, d)[0]), "centroid_row", "centroid_col")


@query("simulate_marks", """WITH px AS (SELECT unnest(range(-6, 7)) AS dr), pc AS (SELECT unnest(range(-6, 7)) AS dc)
SELECT (20 * (n_nationkey // 5 + 1) + dr)::INTEGER AS "row", (10 + 30 * (n_nationkey % 5) + dc)::INTEGER AS col, (n_nationkey + 1)::BIGINT AS label FROM nation, px, pc WHERE dr * dr + dc * dc < 36""")
def simulate_marks(spark, d):
    """A grid of nations, five a row, between anchors at the regions."""
    msi = table(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))
    anchors = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("int").alias("row_number"), (20.0 * (F.col("r_regionkey") + 1)).alias("centroid_row"), F.explode(F.array(F.lit(10.0), F.lit(130.0))).alias("centroid_col"))
    return regions.simulate_marks(msi, anchors, (130, 150), 6).labels


@query("segment_images")
def segment_images(spark, d):
    """Two images with a mark per supplier nation, in one task each."""
    spots = table(spark, d, "supplier").select((F.col("s_suppkey") % 2).cast("int").alias("image_id"), (15 + 30 * (F.col("s_nationkey") % 5)).alias("r"), (15 + 30 * F.floor(F.col("s_nationkey") / 5)).alias("c")).distinct()
    grid = spark.range(165 * 165).select((F.col("id") % 165).cast("int").alias("row"), F.floor(F.col("id") / 165).cast("int").alias("col"))
    near = spots.select("image_id", F.explode(regions.disk(F.col("r"), F.col("c"), 9, 165, 165)).alias("p")).select("image_id", F.col("p.row").cast("int").alias("row"), F.col("p.col").cast("int").alias("col"), F.lit(1.0).alias("value"))
    images = spark.createDataFrame([(0,), (1,)], "image_id int")
    full = grid.crossJoin(F.broadcast(images))  # two images
    return imaging.segment_images(full.join(near, ["image_id", "row", "col"], "left").fillna(0.0, ["value"]), top_hat_radius=0, min_peak_distance=8)


@query("select_k")
def select_k(spark, d):
    return analysis.select_k(analysis.factorize(sparse_bundle(spark, d), [2, 3], n_iter=3, n_features=50))


@query("preprocess_bundle", f"WITH {_X}, k AS (SELECT feature_id FROM x WHERE value <> 0 GROUP BY 1 HAVING count(*)::DOUBLE / (SELECT count(*) FROM supplier) > 0.05::DOUBLE), y AS (SELECT x.* FROM x SEMI JOIN k USING (feature_id)), f AS (SELECT obs_id, sqrt(sum(value * value) / (SELECT count(*) FROM k JOIN part ON p_partkey = feature_id)) AS f FROM y GROUP BY 1) SELECT obs_id, feature_id, round(value / CASE WHEN f = 0 THEN 1 ELSE f END, 8) AS value FROM y JOIN f USING (obs_id)")
def preprocess_bundle(spark, d):
    return rounded(preprocess.preprocess(sparse_bundle(spark, d)).layers["normalized"], "value")
