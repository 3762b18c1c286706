"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines.

Words are runs of bytes other than space and the controls 9 to 13. For several n, rolling hashes
of all n-word windows of a text are sorted, and the windows that occur twice or more are marked;
a word is covered if a marked window holds it, and the coverage is the share of the words' code
points that are covered. Lines (split at newline, with a word) are compared by a hash of all
their bytes. Hashes have 64 bits and are compared within one text only.

Base rule: fewer than 20 words, or over 30 % of the words inside 8-word windows that occur twice
or more. The method's verdict, on texts that pass the base rule: some n-gram coverage or the share
of code points in duplicated lines is over its limit.

Defined results: null and empty texts have no words and fail the base rule. A null id is returned
as it is; repeated rows are each returned; other columns are ignored. Whole texts are measured,
however long; memory is some tens of bytes per byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textgrid as tg
from .arrows import mapped
from .columns import own

#: Highest share of a text's word characters inside duplicated n-grams, by n.
COVERAGE_LIMITS = {5: 0.40, 8: 0.35, 10: 0.30}
#: Highest share of word characters in duplicated lines.
LINE_LIMIT = 0.30
MIN_WORDS = 20
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, coverage_5 double, coverage_8 double, coverage_10 double"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = 0x0A


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``values``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _covered(words: np.ndarray, first: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that their text has twice or more."""
    h, at = tg.windows(words, first, n)
    if not len(h):
        return np.zeros(len(words), bool)
    keys = tg.salted(h, text[at])
    hits = at[tg.among(keys, tg.repeated(keys))]
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    n_texts = len(offs) - 1
    mask = ~_BLANK[data]
    starts, ends = tg.runs(mask, offs)
    first = tg.owners(starts, offs)
    text = tg.text_of(first)
    head = (data & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    word_points = points[ends] - points[starts]
    words = tg.run_hashes(data, mask, starts, ends)
    out = {
        "n_words": np.diff(first),
        "word_chars": _sums(word_points, first),
        "n_symbols": _sums(_SYMBOL[data], offs),
    }
    for n in COVERAGE_LIMITS:
        cover = _covered(words, first, text, n)
        if n == 8:
            out["n_repeat_words"] = _sums(cover, first)
        out[f"coverage_{n}"] = _sums(np.where(cover, word_points, 0), first) / np.maximum(out["word_chars"], 1)

    line_starts, line_ends = tg.runs(data != _NEWLINE, offs)
    lead = np.searchsorted(starts, line_starts)  # words before the line
    tail = np.searchsorted(starts, line_ends)
    held = tail > lead
    line_starts, line_ends, lead, tail = line_starts[held], line_ends[held], lead[held], tail[held]
    line_text = np.searchsorted(offs, line_starts, side="right") - 1
    keys = tg.salted(tg.run_hashes(data, None, line_starts, line_ends), line_text)
    again = tg.occurrence(keys) > 0
    chars = np.concatenate([[0], np.cumsum(word_points)])
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n_texts)
    in_lines = np.bincount(line_text[again], (chars[tail] - chars[lead])[again], minlength=n_texts)
    out["line_coverage"] = in_lines / np.maximum(out["word_chars"], 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    bad = out["base_failed"] | (out["line_coverage"] > LINE_LIMIT)
    for n, limit in COVERAGE_LIMITS.items():
        bad = bad | (out[f"coverage_{n}"] > limit)
    out["kept"] = ~bad
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]]
    for batch in batches:
        for a, b, data, offs in tg.chunks(batch.column("text")):
            found = measure(data, offs)
            columns = [batch.column("doc_id").slice(a, b - a), *[pa.array(found[c]) for c in names[1:]]]
            yield pa.RecordBatch.from_arrays(columns, names)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, coverages and verdicts of each row."""
    rows = docs.select(own(docs, id_col).alias("doc_id"), F.coalesce(own(docs, text_col).cast("string"), F.lit("")).alias("text"))
    measured = T.StructType.fromDDL(SCHEMA)
    return mapped(rows, _measured, T.StructType([rows.schema["doc_id"], *measured.fields]))
