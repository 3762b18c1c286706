"""Fetching of raw files into the lake: plans of what to fetch, and a fetcher that can be replaced.

Certificates are always verified. Nothing here runs inside a query.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

Fetch = Callable[[str], bytes]
#: Fixed value: the first day of the newer file format.
UDIFF_START = dt.date(2024, 7, 8)


@dataclass(frozen=True)
class LakePaths:
    """Places of raw and processed tables below one root."""

    root: str

    def raw(self, name: str) -> str:
        return f"{self.root}/raw/{name}"

    def processed(self, name: str) -> str:
        return f"{self.root}/processed/{name}"


def http_fetch(url: str, timeout: float = 30.0, tries: int = 3, pause: float = 1.0) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    for k in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as got:
                return got.read()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


def fetch_json(url: str, fetch: Fetch = http_fetch):
    return json.loads(fetch(url))


def legacy_name(day: dt.date) -> str:
    return f"cm{day:%d%b%Y}bhav.csv.zip".replace(f"{day:%b}", f"{day:%b}".upper())


def udiff_name(day: dt.date) -> str:
    return f"BhavCopy_NSE_CM_0_0_0_{day:%Y%m%d}_F_0000.csv.zip"


def report_name(day: dt.date) -> str:
    return f"PR{day:%d%m%y}.zip"


def candidates(day: dt.date) -> list[str]:
    """File names to try for a day, the likelier first."""
    both = [udiff_name(day), legacy_name(day)]
    return both if day >= UDIFF_START else both[::-1]


def weekdays(start: dt.date, end: dt.date) -> list[dt.date]:
    return [d for k in range((end - start).days + 1) if (d := start + dt.timedelta(k)).weekday() < 5]


def fetch_day(day: dt.date, url_of: Callable[[str, dt.date], str], folder: str, fetch: Fetch = http_fetch, force: bool = False) -> Path | None:
    """The first candidate that comes back as a zip, kept in the folder; none if all fail."""
    for name in candidates(day):
        target = Path(folder, name)
        if target.exists() and not force:
            return target
        try:
            body = fetch(url_of(name, day))
        except OSError:
            continue
        if body.startswith(b"PK"):
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(body)
            return target
    return None


def fetch_range(days: Iterable[dt.date], url_of, folder: str, fetch: Fetch = http_fetch, force: bool = False) -> dict[dt.date, Path | None]:
    """Best effort over days."""
    return {day: fetch_day(day, url_of, folder, fetch, force) for day in days}


def cached_text(url: str, path: str, fetch: Fetch = http_fetch, force: bool = False) -> str:
    """A page through a file cache."""
    place = Path(path)
    if force or not place.exists():
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(fetch(url))
    return place.read_text(encoding="utf-8", errors="replace")
