"""The jobs as queries: each runs twice into one new folder of the shared directory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ionweave.session import shared_dir

from . import acquisition_ingest, marker_terms


def job1_marker_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    marker_terms.marker_terms(spark, f"{sf_dir}/documents.parquet", output)
    return marker_terms.marker_terms(spark, f"{sf_dir}/documents.parquet", output)


def job2_acquisition_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    # a pattern, as the table may be one file and a stream's plain path must be a folder
    paths = f"{sf_dir}/lineitem.parque[t]", f"{sf_dir}/part.parquet", f"{place}/output", f"{place}/checkpoint"
    acquisition_ingest.acquisition_ingest(spark, *paths)
    return acquisition_ingest.acquisition_ingest(spark, *paths)


QUERIES = {"job1_marker_terms": job1_marker_terms, "job2_acquisition_ingest": job2_acquisition_ingest}
ORACLE_SQL = {"job1_marker_terms": marker_terms.SQL, "job2_acquisition_ingest": acquisition_ingest.SQL}
