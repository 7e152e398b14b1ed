"""Peak lists as they are acquired: features by month, kept up to date.

An instrument drops files of peaks into a folder while a study runs.  Each run
takes the files that came since the last one, puts every peak on the feature
nearest to its channel's mass, and brings the monthly summary of each feature up
to date.

    python -m jobs.acquisition_ingest --config jobs/acquisition_ingest.json \\
        --peaks PEAKS --channels CHANNELS.parquet --output OUT --checkpoint CHECKPOINT

``OUT/axis`` is the consensus axis of the channels' masses, made by the first run
and kept, so that features mean the same ever after.  ``OUT/values`` holds the
summed intensity and number of peaks per pixel and feature of each batch, a folder per batch and month.
``OUT/summary``, partitioned by month, holds per feature its peaks, the pixels it was
found in, the month's pixels, and the total and largest intensity of a pixel.

The file stream's checkpoint is the mark of what was taken.  A batch that is run
again after a failure overwrites its own folders and writes its months anew from
all values, so nothing is counted twice; a run without new files changes nothing.
Other months are neither read nor written.  Output and checkpoint belong together:
a new checkpoint needs a new output.

Every row is a peak; those without pixel, known channel, time or finite intensity
are dropped and counted in the log.  A channel listed twice counts once, with its
smallest mass.  Masses meet the axis once per channel, not once per peak.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.errors import PreprocessError
from ionweave.functions.joins import UNITS, nearest
from ionweave.model import choice, not_finite, number, require, whole
from ionweave.operators.peaks import consensus_axis
from ionweave.session import cut

from .common import log, main

DEFAULTS = {
    "pixel": "l_orderkey", "channel": "l_partkey", "intensity": "l_extendedprice", "time": "l_shipdate",
    "channel_id": "p_partkey", "channel_mz": "p_retailprice",
    "tolerance": 300, "unit": "ppm", "max_files": 1000,
}
DIGITS = 2
AXIS = "col_ord INT, mz DOUBLE"
VALUES = "pixel BIGINT, col_ord INT, value DOUBLE, peaks BIGINT, batch BIGINT, month STRING"
SUMMARY = "col_ord INT, mz DOUBLE, peaks BIGINT, pixels BIGINT, month_pixels BIGINT, total DOUBLE, largest DOUBLE, month STRING"


def fixed_axis(spark: SparkSession, channels: DataFrame, path: str, tolerance: float, unit: str) -> DataFrame:
    """(col_ord, mz) as written by the first run; one file, so it is there whole or not at all."""
    try:
        axis = spark.read.schema(AXIS).parquet(path)
        if axis.head(1):
            return axis
    except AnalysisException:
        pass
    consensus_axis(channels.select("mz"), tolerance, unit).selectExpr("col_ord", "mz").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(AXIS).parquet(path)


def monthly(values: DataFrame, axis: DataFrame) -> DataFrame:
    """Summary of ``values(month, pixel, col_ord, value)``; a pixel's values of several batches add up."""
    cells = values.groupBy("month", "col_ord", "pixel").agg(F.sum("value").alias("value"), F.sum("peaks").alias("peaks"))
    features = cells.groupBy("month", "col_ord").agg(F.sum("peaks").alias("peaks"), F.count("*").alias("pixels"), F.round(F.sum("value"), DIGITS).alias("total"), F.round(F.max("value"), DIGITS).alias("largest"))
    months = values.select("month", "pixel").distinct().groupBy("month").agg(F.count("*").alias("month_pixels"))
    return features.join(months, "month").join(axis, "col_ord").select("col_ord", F.round("mz", 6).alias("mz"), "peaks", "pixels", "month_pixels", "total", "largest", "month")


def acquisition_ingest(spark: SparkSession, peaks: str, channels: str, output: str, checkpoint: str, config: dict = DEFAULTS) -> DataFrame:
    """Take the new files of ``peaks``; the summary read back."""
    tolerance, unit = number("tolerance", config["tolerance"], PreprocessError, above=0), choice("unit", config["unit"], UNITS, PreprocessError)
    whole("max_files", config["max_files"], PreprocessError)
    schema = spark.read.parquet(peaks).schema
    known = spark.read.parquet(channels)
    require(known, [config["channel_id"], config["channel_mz"]], PreprocessError, channels)
    if missing := [config[c] for c in ("pixel", "channel", "intensity", "time") if config[c] not in schema.names]:
        raise PreprocessError(f"{peaks} is missing columns: {missing}")
    known = known.groupBy(F.col(config["channel_id"]).alias("channel")).agg(F.min(F.col(config["channel_mz"]).cast("double")).alias("mz"))
    known = cut(known.where(F.col("channel").isNotNull() & ~not_finite(F.col("mz")) & (F.col("mz") > 0)))
    axis = fixed_axis(spark, known, f"{output}/axis", tolerance, unit)
    features = cut(nearest(known, axis.select("col_ord", F.col("mz").alias("axis_mz")), "mz", "axis_mz", "col_ord", ["channel"], tolerance, unit).select("channel", "col_ord"))
    taken = []

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col(config["pixel"]).cast("long").alias("pixel"), F.col(config["channel"]).alias("channel"),
            F.col(config["intensity"]).cast("double").alias("intensity"), F.date_format(config["time"], "yyyy-MM").alias("month"),
        ).join(features, "channel", "left")
        usable = F.col("pixel").isNotNull() & F.col("month").isNotNull() & F.col("col_ord").isNotNull() & ~not_finite(F.col("intensity"))
        values = rows.where(usable).groupBy("month", "pixel", "col_ord").agg(F.sum("intensity").alias("value"), F.count("*").alias("peaks"))
        values.write.mode("overwrite").partitionBy("month").parquet(f"{output}/values/batch={batch_id}")
        stored = spark.read.schema(VALUES).option("basePath", f"{output}/values").parquet(f"{output}/values/batch=*")
        found = stored.where(F.col("batch") == batch_id).groupBy("month").agg(F.sum("peaks").alias("peaks")).collect()  # one line per month of the batch
        months, read = [r.month for r in found], batch.count()
        log.info("batch %d of %s: read %d peaks, dropped %d", batch_id, peaks, read, read - sum(r.peaks for r in found))
        taken.append(read)
        if months:
            summary = monthly(stored.where(F.col("month").isin(months)), axis)
            summary.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{output}/summary")
            log.info("wrote %d months of %s/summary, %s to %s", len(months), output, min(months), max(months))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files"]).parquet(peaks)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not taken:
        log.info("no new files in %s", peaks)
    try:
        out = spark.read.schema(SUMMARY).parquet(f"{output}/summary")
    except AnalysisException:  # nothing was ever written
        return spark.createDataFrame([], SUMMARY)
    log.info("%s/summary holds %d rows", output, out.count())
    return out


_LIMIT = "{0} * 300.0::DOUBLE / 1e6::DOUBLE"
#: The same rows in SQL over views ``lineitem`` and ``part``, with the default settings; the axis is folded as the library does.
SQL = f"""WITH RECURSIVE
v AS (SELECT list(mz ORDER BY mz) AS ms FROM (SELECT p_retailprice AS mz FROM part)),
w(i, g, first_mz, total, n) AS (
  SELECT 1, 0, ms[1], ms[1], 1 FROM v
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN g ELSE g + 1 END, CASE WHEN ok THEN first_mz ELSE m END, CASE WHEN ok THEN total + m ELSE m END, CASE WHEN ok THEN n + 1 ELSE 1 END
  FROM (SELECT w.*, ms[i + 1] AS m, abs(first_mz - (total + ms[i + 1]) / (n + 1)) <= {_LIMIT.format("first_mz")} AND abs(ms[i + 1] - (total + ms[i + 1]) / (n + 1)) <= {_LIMIT.format("ms[i + 1]")} AS ok FROM w, v WHERE i < len(ms))
),
f AS (SELECT g, max(i) AS i FROM w GROUP BY g),
members AS (SELECT g, ms[coalesce(lag(i) OVER (ORDER BY g), 0) + 1 : i] AS m FROM f, v),
axis AS (SELECT g::INTEGER AS col_ord, list_sum(m) / len(m) AS mz FROM members),
masses AS (SELECT p_partkey AS channel, p_retailprice AS mz FROM part),
hit AS (SELECT channel, col_ord FROM (SELECT channel, col_ord, row_number() OVER (PARTITION BY channel ORDER BY abs(a.mz - p.mz), col_ord) AS k FROM masses p JOIN axis a ON abs(a.mz - p.mz) <= {_LIMIT.format("p.mz")}) WHERE k = 1),
cells AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_orderkey AS pixel, col_ord, sum(l_extendedprice) AS value, count(*) AS peaks
          FROM lineitem JOIN hit ON channel = l_partkey GROUP BY ALL),
months AS (SELECT month, count(DISTINCT pixel) AS month_pixels FROM cells GROUP BY 1)
SELECT col_ord, round(any_value(a.mz), 6) AS mz, sum(peaks)::BIGINT AS peaks, count(*) AS pixels, any_value(month_pixels) AS month_pixels, round(sum(value), 2) AS total, round(max(value), 2) AS largest, month
FROM cells JOIN months USING (month) JOIN axis a USING (col_ord) GROUP BY month, col_ord"""


if __name__ == "__main__":
    main(
        acquisition_ingest, DEFAULTS,
        {"peaks": "folder of Parquet files of peaks, or a pattern of files", "channels": "Parquet table of channels and their masses", "output": "folder of the results", "checkpoint": "folder of the stream's checkpoint"},
        __doc__,
    )
