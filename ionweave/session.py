"""Session builder and the folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import IonweaveError

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "ionweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map={**DEFAULTS, **conf})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, shared by all executors; a temporary folder only where it is unset and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise IonweaveError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ionweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of an iterative job in a folder of the shared directory; a new version of a table replaces the last.

    Unlike a checkpoint, a table read back carries no size estimate of the plan that
    made it; over many rounds of joins these estimates, each a product of the ones
    before, grow until planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written as the table ``name`` and read back; the version before is deleted then."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes the table ``name``, if there is one; nothing may read it any more."""
        if before := self.paths.pop(name, None):
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
