"""Streaming: spectra arriving as files are projected onto a fixed axis.

Projection needs no state: each micro-batch is joined with the static axis and
summed within its pixels.  Totals per pixel use event time with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.peaks import explode_spectra, project


def project_stream(spectra: DataFrame, axis: DataFrame, sink: str, checkpoint: str, tolerance: float = 10, unit: str = "ppm"):
    """Start a query that appends (pixel_ord, col_ord, value, batch) Parquet under ``sink``.

    A batch that is repeated after a failure overwrites its own folder, so results stay exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        values = project(explode_spectra(batch), axis, tolerance, unit)
        values.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spectra.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, time: str, key: str, value: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sum and count per key and tumbling window, dropping rows later than ``late``."""
    w = F.window(time, window).alias("w")
    out = events.withWatermark(time, late).groupBy(w, key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "total", "n")
