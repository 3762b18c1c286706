"""Reports: small results as Markdown and Parquet."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame

from .operators.regress import Premia
from .store import write_flat


def markdown_table(df: DataFrame, digits: int = 4, most: int = 10_000) -> str:
    """A table of a small frame; null and NaN are blank. A frame of over ``most`` rows ends with a line that says so."""
    rows = df.limit(most + 1).collect()
    if not rows:
        return "_empty_"
    more = [f"\n_the first {most} rows; the Parquet file has all_"] if len(rows) > most else []
    rows = rows[:most]
    show = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join(["| " + " | ".join(line) + " |" for line in lines] + more)


def write_report(folder: str, title: str, parts: dict[str, DataFrame], name: str = "report") -> Path:
    """Each part as Parquet, all of them in one Markdown file."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    text = [f"# {title}"]
    for part, df in parts.items():
        write_flat(df, f"{folder}/{part}.parquet", single=True)
        text += [f"## {part}", markdown_table(df)]
    place = out / f"{name}.md"
    place.write_text("\n\n".join(text) + "\n", encoding="utf-8")
    return place


def premia_report(folder: str, premia: Premia) -> Path:
    return write_report(folder, "Risk premia", {"fm_lambdas": premia.lambdas, "fm_gamma_path": premia.path}, "fama_macbeth")


def backtest_report(folder: str, result, name: str) -> Path:
    return write_report(folder, f"Backtest {name}", {f"{name}_metrics": result.metrics, f"{name}_turnover": result.turnover, f"{name}_pnl": result.pnl}, name)


def master(folder: str, title: str, sections: dict[str, str | Path]) -> Path:
    """One Markdown file of texts and of other reports' files."""
    text = [f"# {title}"]
    for name, body in sections.items():
        body = body.read_text(encoding="utf-8") if isinstance(body, Path) and body.exists() else "_missing_" if isinstance(body, Path) else body
        text += [f"## {name}", body]
    place = Path(folder, "tearsheet.md")
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text("\n\n".join(text) + "\n", encoding="utf-8")
    return place
