"""Sinks and the SQL surface: partitioned Parquet, upserts, views over the lake."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The lake's tables and whether their files are partitioned by year.
STANDARD = {"bhavcopy": True, "returns": True, "fundamentals": False, "universe": False, "risk_free": False}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def write_partitioned(df: DataFrame, path: str, by: str = "year", date_col: str = "trade_date", compression: str = "snappy") -> None:
    """Replaces the partitions that ``df`` has rows of, and no others; ``by`` is year or a column.

    Rows are rebalanced by partition key: Spark splits a large year into as many tasks as its size
    asks for and puts small ones together. A dataset may be read and overwritten in place.
    """
    rows = df.withColumn("year", F.year(date_col)) if by == "year" else df
    rows.hint("rebalance", F.col(by)).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).parquet(path)


def write_flat(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("compression", "snappy").parquet(path)


def upsert(new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None) -> None:
    """Rows of ``new`` win over those of the table by key; the whole is written aside, then swapped in.

    The old table is renamed before the new one takes its place and goes last; one that a lost
    driver left under its other name is put back first.
    """
    spark = new.sparkSession
    fs, place = _fs(spark, path)
    _, old = _fs(spark, f"{path.rstrip('/')}-before")
    if fs.exists(old):
        if fs.exists(place):
            fs.delete(old, True)
        else:
            fs.rename(old, place)
    rows = new.withColumn("_age", F.lit(0))
    if exists(spark, path):
        rows = rows.unionByName(spark.read.parquet(path).withColumn("_age", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*keys).orderBy("_age", *(order or [F.col(c).desc_nulls_last() for c in new.columns if c not in keys]))
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    write_flat(rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_age"), aside)
    _, staged = _fs(spark, aside)
    if fs.exists(place):
        fs.rename(place, old)
    if not fs.rename(staged, place):
        raise OSError(f"{aside} could not be renamed to {path}")
    fs.delete(old, True)


def read_partitioned(spark: SparkSession, path: str, years: list[int] | None = None, symbols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame | None:
    """A partitioned table without its partition column; years win over symbols. None where there is no table."""
    if not exists(spark, path):
        return None
    df = spark.read.option("mergeSchema", True).parquet(path)
    if years and "year" in df.columns:
        df = df.where(F.col("year").isin(*years))
    elif symbols and "symbol" in df.columns:
        df = df.where(F.col("symbol").isin(*symbols))
    return df.select(*columns) if columns else df.drop("year")


def partitions(spark: SparkSession, path: str, by: str = "year") -> list[str]:
    """The partition keys there are, in order."""
    if not exists(spark, path):
        return []
    fs, place = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(n.removeprefix(f"{by}=") for n in names if n.startswith(f"{by}="))


def register_view(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A view over a Parquet table, columns by name, the partition column included."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    df.createOrReplaceTempView(name)
    return df


def register_standard_views(spark: SparkSession, root: str) -> list[str]:
    """Views of the lake's tables that exist, their names."""
    there = [name for name in STANDARD if exists(spark, f"{root}/{name}")]
    for name in there:
        register_view(spark, name, f"{root}/{name}")
    return there


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; below this machine's temporary folder only where master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/panelwright"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file, by Spark's own file systems."""
    fs, place = _fs(spark, path)
    out = fs.create(place)
    out.write(bytearray(body), 0, len(body))
    out.close()


def discover(spark: SparkSession, *folders: str) -> list[str]:
    """Candidate files of some folders: CSV before Parquet, each in order of name."""
    found = []
    for folder in folders:
        if exists(spark, folder):
            fs, place = _fs(spark, folder)
            found += [s.getPath().toString() for s in fs.listStatus(place)]
    return [p for ending in (".csv", ".parquet") for p in sorted(found) if p.lower().endswith(ending)]


def snappy_files(spark: SparkSession, path: str) -> list[str]:
    """The table's data files; raises where there is none, or one that isn't Snappy Parquet by name."""
    files = sorted(spark.read.option("recursiveFileLookup", "true").format("parquet").load(path).inputFiles())
    if not files or not all(f.endswith(".snappy.parquet") for f in files):
        raise AssertionError(f"not Snappy Parquet: {files[:3]}")
    return files
