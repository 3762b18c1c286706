"""Tables written to the cluster's shared folder, to cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this machine only where master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='panelwright-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark reads it by, for readers with other defaults."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


class Staging:
    """Parquet tables of one run of one operator, below the shared folder.

    ``put`` writes a frame and returns it read back; ``drop`` removes a table that nothing
    reads any more. What a returned lazy frame still reads has to stay; it goes when the
    driver's JVM ends in good order, which is as long as the frame can be read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = qualified(spark, f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        schema = df.schema
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
