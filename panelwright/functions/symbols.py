"""Normal forms of exchange symbols."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exchange suffixes and names that a merger replaced.
SUFFIX = r"\.(NS|BO|NSE|BSE)$"
ALIASES = {"HDFC": "HDFCBANK"}


@dataclass(frozen=True)
class SymbolMap:
    """Old symbol to current symbol."""

    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))

    def extend(self, more: dict[str, str]) -> SymbolMap:
        return SymbolMap(self.aliases | {self.bare(k): self.bare(v) for k, v in more.items()})

    @staticmethod
    def bare(symbol: str) -> str:
        return re.sub(SUFFIX, "", symbol.strip().upper())

    def normal(self, symbol: str) -> str:
        return self.aliases.get(self.bare(symbol), self.bare(symbol))

    def column(self, c: Column) -> Column:
        plain = F.regexp_replace(F.upper(F.trim(c)), SUFFIX, "")
        if not self.aliases:
            return plain
        known = F.create_map(*[F.lit(x) for pair in self.aliases.items() for x in pair])
        return F.coalesce(F.element_at(known, plain), plain)

    def normalize(self, df: DataFrame, column: str = "symbol") -> DataFrame:
        return df.withColumn(column, self.column(F.col(column))) if column in df.columns else df


def quote_symbol(symbol: str, suffix: str = ".NS") -> str:
    """The symbol with one exchange suffix."""
    return SymbolMap.bare(symbol) + suffix


def quote_symbols(symbols: list[str], suffix: str = ".NS") -> list[str]:
    return [quote_symbol(s, suffix) for s in symbols]


def bare_symbols(symbols: list[str]) -> list[str]:
    return [SymbolMap.bare(s) for s in symbols]
