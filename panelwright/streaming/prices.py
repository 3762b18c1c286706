"""Arriving price files as a stream, by the same rules as the batch reader.

Files are picked up once each (the checkpoint remembers them); every micro-batch replaces the
partitions of its years after merging with what is there, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import store
from ..sources.prices import TEXT_COLUMNS, _parsed, canonicalize

_FILES = "path string, modificationTime timestamp, length long, content binary"


def price_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Rows of new files, as text."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder).where(F.lower("path").rlike(r"\.(csv|zip)$"))
    schema = ", ".join(f"`{c}` string" for c in TEXT_COLUMNS) + ", file_date date"
    return files.select("path", "content").mapInArrow(_parsed, schema)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the year-partitioned price table up to date."""

    def merge(batch: DataFrame, _number: int) -> None:
        new = canonicalize(batch).withColumns({"year": F.year("trade_date"), "_age": F.lit(0)})
        if store.exists(spark, out):
            years = [r[0] for r in new.select("year").distinct().limit(1000).collect()]  # one row per calendar year
            old = spark.read.parquet(out).where(F.col("year").isin(*years)).withColumn("_age", F.lit(1))
            new = new.unionByName(old, allowMissingColumns=True)
        order = Window.partitionBy("trade_date", "symbol").orderBy("_age", F.desc("series"))
        rows = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_age", "year")
        store.write_partitioned(rows, out)

    writer = price_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
