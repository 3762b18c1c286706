"""End-of-day price files: two CSV dialects, plain or zipped, to the canonical price table.

Plain files are read line by line by Spark, each in one task, and zips as a distributed
``binaryFile`` scan; rows are parsed as text in the executors, BATCH of them at a time whatever a
file's size (zips are held as they are, their members aren't), and typed by ``canonicalize`` in
the JVM.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import first_date, number
from ..functions.symbols import SymbolMap
from ..operators.clean import SERIES_KEPT
from ..schemas import PRICE_MEASURES, PRICES

# The header names of both dialects.
LEGACY = {
    "SYMBOL": "symbol",
    "SERIES": "series",
    "OPEN": "open",
    "HIGH": "high",
    "LOW": "low",
    "CLOSE": "close",
    "LAST": "last",
    "PREVCLOSE": "prev_close",
    "TOTTRDQTY": "tottrdqty",
    "TOTTRDVAL": "tottrdval",
    "TIMESTAMP": "timestamp",
}
UDIFF = {
    "TradDt": "trade_date",
    "TckrSymb": "symbol",
    "SctySrs": "series",
    "OpnPric": "open",
    "HghPric": "high",
    "LwPric": "low",
    "ClsPric": "close",
    "LastPric": "last",
    "PrvsClsgPric": "prev_close",
    "TtlTradgVol": "tottrdqty",
    "TtlTrfVal": "tottrdval",
}
DATE_FORMATS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MM-yyyy")
TEXT_COLUMNS = PRICES.fieldNames()
PARSED = ", ".join(f"`{c}` string" for c in TEXT_COLUMNS) + ", file_date date"
#: Rows that a Python worker holds parsed at a time.
BATCH = 10_000


def detect_dialect(columns: list[str]) -> str:
    """old, udiff or auto, by the header's names, in any case."""
    names = {c.strip().upper() for c in columns}
    if {"TCKRSYMB", "CLSPRIC"} <= names:
        return "udiff"
    return "old" if {"SYMBOL", "CLOSE"} <= names else "auto"


def date_of_name(name: str) -> dt.date | None:
    """The date in a file's name: cmDDMMMYYYYbhav, ..._YYYYMMDD_..., PRDDMMYY."""
    for pattern, form in ((r"cm(\d{2}[A-Za-z]{3}\d{4})bhav", "%d%b%Y"), (r"_CM_.*?_(\d{8})_", "%Y%m%d"), (r"^PR(\d{6})", "%d%m%y")):
        if found := re.search(pattern, name, re.IGNORECASE):
            try:
                return dt.datetime.strptime(found[1], form).date()
            except ValueError:
                return None
    return None


def members(body: bytes) -> Iterator[io.TextIOBase]:
    """The texts of a file, opened: itself, or a zip's CSV and text members, larger ones first."""
    opened = lambda raw: io.TextIOWrapper(raw, "utf-8-sig", "replace", newline="\n")
    if not body.startswith(b"PK"):
        yield opened(io.BytesIO(body))
        return
    with zipfile.ZipFile(io.BytesIO(body)) as held:
        for one in sorted(held.infolist(), key=lambda i: (-i.file_size, i.filename)):
            if one.filename.lower().endswith((".csv", ".txt")):
                yield opened(held.open(one))


def _table(lines: Iterable[str], dialect: str = "auto") -> tuple[dict[str, int], Iterator[list[str]]]:
    """Where each canonical name stands in a row, and the rows, parsed as they are read."""
    rows = csv.reader(iter(lines))
    header = [h.strip() for h in next(rows, [])]
    kind = detect_dialect(header) if dialect == "auto" else dialect
    lookup = {k.upper(): v for k, v in (UDIFF if kind == "udiff" else LEGACY).items()}
    places = {lookup[h.upper()]: i for i, h in enumerate(header) if h.upper() in lookup}
    if not {"symbol", "close"} <= set(places):
        raise ValueError(f"neither dialect has the header {header[:20]}")
    return places, (row for row in rows if row)


def _named(places: dict[str, int], rows: Iterable[list[str]]) -> list[dict[str, str]]:
    return [{name: row[i].strip() for name, i in places.items() if i < len(row)} for row in rows]


def parse_text(text: str, dialect: str = "auto") -> list[dict[str, str]]:
    """Rows with canonical names, all values as text. ``auto`` takes the older dialect for a header
    it doesn't know; a header without symbol and close raises."""
    return _named(*_table(io.StringIO(text), dialect))


def _file_table(path: str, body: bytes) -> tuple[dict[str, int], Iterator[list[str]]]:
    """The table of the first member that can be parsed to its end; raises where none can."""
    why: list[str] = []
    for text in members(body):
        try:
            for _ in _table(text)[1]:
                pass
        except (ValueError, csv.Error) as failed:
            why.append(str(failed))
            continue
        text.seek(0)
        return _table(text)
    raise ValueError(f"{path} has no price table: {'; '.join(why) or 'no CSV or text member'}")


def parse_file(path: str, body: bytes) -> list[dict[str, str]]:
    """The rows of the first member that can be parsed; raises where none can."""
    return _named(*_file_table(path, body))


def _batched(path: str, places: dict[str, int], rows: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
    day = date_of_name(path.rsplit("/", 1)[-1])
    while some := list(islice(rows, BATCH)):
        cells = lambda i: [row[i].strip() if i < len(row) else None for row in some]  # noqa: B023, E731
        columns = [pa.array(cells(places[c]), pa.string()) if c in places else pa.nulls(len(some), pa.string()) for c in TEXT_COLUMNS]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([day] * len(some), pa.date32())], [*TEXT_COLUMNS, "file_date"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of whole files (path, content)."""
    for batch in batches:
        for path, body in zip(batch.column("path"), batch.column("content"), strict=True):
            yield from _batched(path.as_py(), *_file_table(path.as_py(), body.as_py()))


def _parsed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of files that come as lines (path, line) in their order, a file after the other."""

    def runs() -> Iterator[tuple[str, Iterator[str]]]:
        for batch in batches:
            same, at = pc.run_end_encode(batch.column("path")), 0
            for path, end in zip(same.values.to_pylist(), same.run_ends.to_pylist(), strict=True):
                yield path, (f"{line}\n" for line in batch.column("line").slice(at, end - at).to_pylist())
                at = end

    for path, parts in groupby(runs(), itemgetter(0)):
        lines = chain.from_iterable(part for _, part in parts)
        first = next(lines).removeprefix("\ufeff")
        if first.startswith("PK\x03\x04"):
            raise ValueError(f"{path} is a zip; its name has to end in .zip")
        try:
            yield from _batched(path, *_table(chain([first], lines)))
        except (ValueError, csv.Error) as failed:
            raise ValueError(f"{path} has no price table: {failed}") from failed


def canonicalize(raw: DataFrame, trade_date: dt.date | None = None, symbol_map: SymbolMap | None = None) -> DataFrame:
    """The price table from text columns: dates, numbers, symbols; EQ and BE rows, EQ first per (date, symbol)."""
    have = set(raw.columns)
    if "trade_date" not in have and "file_date" not in have and trade_date is None:
        raise ValueError("these files carry no date; pass trade_date")
    dates = [first_date(F.col("trade_date"), *DATE_FORMATS)] if "trade_date" in have else []
    dates += [F.col("file_date")] if "file_date" in have else []
    dates += [F.lit(trade_date)] if trade_date else []
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = raw.select(
        F.coalesce(*dates).alias("trade_date"),
        (symbol_map or SymbolMap()).column(text("symbol")).alias("symbol"),
        F.upper(F.trim(text("series"))).alias("series"),
        *[number(text(c)).alias(c) for c in PRICE_MEASURES],
        text("timestamp").alias("timestamp"),
    ).where(F.col("series").isin(*SERIES_KEPT) & F.col("symbol").isNotNull())
    order = Window.partitionBy("trade_date", "symbol").orderBy(F.col("series").desc(), F.col("tottrdval").desc_nulls_last(), F.col("close").desc_nulls_last())  # EQ sorts after BE
    return out.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n").select(*TEXT_COLUMNS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of all plain files, none of them split: as rows of one column without quotes, multi-line
    reading hands out a file's lines in order as it is read; an empty line is none."""
    reader = spark.read.schema("line string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]")
    raw = reader.option("multiLine", True).option("lineSep", "\n").option("sep", "\x01\x02\x03\x04").option("quote", "")
    return raw.csv(path).select(F.col("_metadata.file_path").alias("path"), "line")


def read_price_files(spark: SparkSession, path: str, trade_date: dt.date | None = None, symbol_map: SymbolMap | None = None) -> DataFrame:
    """All price files of a path or glob, both dialects, plain (.csv) and zipped (.zip)."""
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("path", "content")
    rows = _lines(spark, path).mapInArrow(_parsed_lines, PARSED).union(zips.mapInArrow(_parsed, PARSED))
    return canonicalize(rows, trade_date, symbol_map)


def read_price_csv(spark: SparkSession, path: str, dialect: str = "auto", trade_date: dt.date | None = None, symbol_map: SymbolMap | None = None) -> DataFrame:
    """Plain CSV files of one dialect, by Spark's own reader; the date may come from the file names."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    kind = detect_dialect(raw.columns) if dialect == "auto" else dialect
    lookup = {k.upper(): v for k, v in (UDIFF if kind == "udiff" else LEGACY).items()}
    kept = [F.col(f"`{c}`").alias(lookup[c.strip().upper()]) for c in raw.columns if c.strip().upper() in lookup]
    name = F.col("_metadata.file_name")
    legacy = F.to_date(F.try_to_timestamp(F.initcap(F.regexp_extract(name, r"(?i)cm(\d{2}[a-z]{3}\d{4})bhav", 1)), F.lit("ddMMMyyyy")))
    modern = F.to_date(F.try_to_timestamp(F.regexp_extract(name, r"_CM_.*?_(\d{8})_", 1), F.lit("yyyyMMdd")))
    return canonicalize(raw.select(*kept, F.coalesce(legacy, modern).alias("file_date")), trade_date, symbol_map)


def closes(prices: DataFrame, price: str = "close", symbols: list[str] | None = None, years: list[int] | None = None) -> DataFrame:
    """(trade_date, symbol, close) of positive closes, one per key."""
    rows = prices.where(F.year("trade_date").isin(*years)) if years else prices
    out = SymbolMap().normalize(rows.select("trade_date", "symbol", F.col(price).cast("double").alias("close")).where("close > 0"))
    if symbols:
        out = out.where(F.col("symbol").isin(*symbols))
    return out.groupBy("trade_date", "symbol").agg(F.max("close").alias("close"))
