"""Balance sheets from company pages: the first data table of the balance-sheet section."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fundamentals import reporting_lag

CRORE = 1e7
EQUITY_LABELS = ("Equity Capital", "Reserves")
SKIPPED_LABELS = ("raw pdf",)
_VOID = {"br", "img", "input", "hr", "meta", "link"}


class _Sheet(HTMLParser):
    """Collects the cells of the wanted table, row by row."""

    def __init__(self) -> None:
        super().__init__()
        self.depth = 0  # of open tags inside the section
        self.table = 0  # of open tags inside the table
        self.done = False
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in _VOID or self.done:
            return
        if self.depth or (tag == "section" and found.get("id") == "balance-sheet"):
            self.depth += 1
            if self.table or (tag == "table" and "data-table" in (found.get("class") or "").split()):
                self.table += 1
        if self.table:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cell = []

    def handle_endtag(self, tag):
        if tag in _VOID or self.done or not self.depth:
            return
        if self.cell is not None and tag in ("td", "th"):
            self.rows[-1].append("".join(self.cell))
            self.cell = None
        self.depth -= 1
        if self.table:
            self.table -= 1
            self.done = not self.table

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def clean_label(text: str) -> str:
    return re.sub(r"\s+", " ", html.unescape(text).replace(" ", " ")).strip().rstrip("+").strip()


def sheet_cells(page: str | None) -> list[tuple[str, str, str]]:
    """(label, period, value) texts of the balance sheet; none without one."""
    parser = _Sheet()
    parser.feed(page or "")
    rows = [r for r in parser.rows if r]
    if not rows:
        return []
    periods = [clean_label(c) for c in rows[0]]
    periods = periods[1:] if periods and not periods[0] else periods
    out = []
    for row in rows[1:]:
        label = clean_label(row[0])
        if label and label.lower() not in SKIPPED_LABELS:
            out += [(label, p, v.strip()) for p, v in zip(periods, row[1:], strict=False) if v.strip()]
    return out


def period_end(c: Column) -> Column:
    """The month's end of ``MMM yyyy``; null for anything else."""
    return F.last_day(F.to_date(F.try_to_timestamp(F.trim(c), F.lit("MMM yyyy"))))


def sheet_number(c: Column) -> Column:
    """A number with thousands commas; null for dashes, NA and percentages."""
    text = F.trim(F.regexp_replace(c, "[, ]", ""))
    return F.when(text.contains("%") | F.upper(text).isin("", "-", "—", "–", "NA", "N/A"), None).otherwise(text).try_cast("double")


def balance_sheets(pages: DataFrame, key: str = "symbol", html_col: str = "html") -> DataFrame:
    """(key, label, as_of_date, value_crore) of all pages' balance sheets."""
    kind = pages.schema[key].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels, periods, values = [], [], [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                for label, period, value in sheet_cells(page):
                    keys.append(i)
                    labels.append(label)
                    periods.append(period)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(x, pa.string()) for x in (labels, periods, values))], [key, "label", "period", "value"])

    raw = pages.select(key, html_col).mapInArrow(cells, f"`{key}` {kind}, label string, period string, value string")
    return raw.select(key, "label", period_end(F.col("period")).alias("as_of_date"), sheet_number(F.col("value")).alias("value_crore")).where("as_of_date is not null and value_crore is not null")


def book_equity(sheets: DataFrame, key: str = "symbol", lag_months: int = 3, years: list[int] | None = None) -> DataFrame:
    """Equity capital plus reserves in units, a missing side as 0, in the fundamentals' columns."""
    rows = sheets.where(F.col("label").isin(*EQUITY_LABELS))
    if years:
        rows = rows.where(F.year("as_of_date").isin(*years))
    one = rows.groupBy(key, "as_of_date", "label").agg(F.max("value_crore").alias("v"))
    out = one.groupBy(F.col(key).alias("symbol"), "as_of_date").agg((F.sum("v") * CRORE).alias("book_value"))
    none = F.lit(None).cast("double")
    return reporting_lag(out, lag_months).select("as_of_date", "available_date", "symbol", none.alias("market_cap"), "book_value", none.alias("book_to_market"))
