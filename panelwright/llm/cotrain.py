"""Quality classification by co-training of a text-content view and a page-metadata view.

The text view sees words: hashed words, word pairs and character trigrams, each with a log-odds of
occurring in good texts over bad ones (counted once a training text, smoothed), and averaged over
all of a text; with these, shares of character classes and of repeated words and lines. The
metadata view sees the source, the language and the length (hashed one-hots). No feature is in
both. Both are logistic regressions; a training text's own counts are left out of the log-odds that
it is fitted with.

In each round either view scores all unlabelled documents and hands the most confident ones,
different texts each, with its labels to the other view's training rows; both are then fitted
again. Each view is calibrated on labelled rows it was not fitted on (Platt scaling), and the
calibrated log-odds are added (the prior counts once) to score all documents.

What is fitted is bounded: at most ``Settings.labelled`` labelled documents, drawn by a hash of
their ids, and the ``Settings.handed`` most confident documents of each view, label and round reach
the driver as counts of hashed features. They are chosen from all documents: a round is one pass
over the table in which a task keeps its own most confident ones. Scoring runs over all documents
and whole texts.

Defined results: null text counts as empty; null source, language or length are values of their
own. Labels without a document, with null or of another value than 0 and 1, and documents with
both labels are left out. Of rows with one id, the one with the least hash of its values is
fitted; rows without an id are scored, but never handed over. Without labels of both kinds all
documents get a null score and are kept. Repeated rows get equal scores. Ids may be of any type
that labels share with documents. Other columns pass through ``with_scores`` unchanged, whatever
they are called; its own ``quality_score`` and ``quality_kept`` replace columns of these names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textgrid as tg
from .arrows import mapped
from .columns import extended, own
from .staging import Staging


@dataclass(frozen=True)
class Settings:
    labelled: int = 4000
    rounds: int = 2
    #: Documents of each label that a view hands over in a round, and how sure it has to be.
    handed: int = 200
    sure: float = 0.95
    #: Documents whose combined probability of being good is lower are rejected.
    threshold: float = 0.2
    ridge: float = 1.0
    #: Texts that each hashed feature is held to have occurred in besides those seen, shared out by how common it is.
    smooth: float = 1.0


#: Buckets of hashed words, word pairs and character trigrams.
SIZES = (4096, 4096, 2048)
_FROM = np.concatenate([[0], np.cumsum(SIZES)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CLASSES = {
    "symbol": b"#*$%&|<>=@^~_{}[]\\/",
    "bang": b"!",
    "pipe": b"|",
    "digit": b"0123456789",
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "stop": b".?",
    "comma": b",;:",
}
_TABLES = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}
SHARES = len(_CLASSES) + 7
SOURCES, LANGS, LENGTHS = 64, 16, 24
META_FEATURES = SOURCES + LANGS + LENGTHS


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``values``; each depends on nothing but its own values."""
    if values.dtype.kind in "bui":
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (total[first[1:]] - total[first[:-1]]).astype(float)
    out, held = np.zeros(len(first) - 1), np.diff(first) > 0
    if held.any():
        out[held] = np.add.reduceat(values[: first[-1]], first[:-1][held])
    return out


def shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each text of a chunk: what share of it is of a class, or said before."""
    mask = ~_BLANK[data]
    begin, ends = tg.runs(mask, offs)
    first = tg.owners(begin, offs)
    text = tg.text_of(first)
    n = np.maximum(np.diff(first), 1)
    body = np.maximum(_sums(mask, offs), 1)
    out = [_sums(table[data], offs) / body for table in _TABLES.values()]
    words = tg.salted(tg.run_hashes(data, mask, begin, ends), text)
    again = tg.occurrence(words)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    symbol = _TABLES["symbol"] | _TABLES["bang"]
    lens = ends - begin
    lines, line_ends = tg.runs(data != 0x0A, offs)
    line_first = tg.owners(lines, offs)
    line_keys = tg.salted(tg.run_hashes(data, None, lines, line_ends), tg.text_of(line_first))
    out += [
        _sums(again > 0, first) / n,
        _sums(same, first) / n,
        _sums(symbol[data[ends - 1]], first) / n,
        _sums(lens, first) / n / 10,
        _sums(lens > 20, first) / n,
        _sums(lens == 1, first) / n,
        _sums(tg.occurrence(line_keys) > 0, line_first) / np.maximum(np.diff(line_first), 1),
    ]
    return np.stack(out, axis=1)


def grams(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, word pairs and character trigrams: the bucket of each, and where each text's begin."""
    low = _LOWER[data]
    mask = _LETTER[low]
    begin, ends = tg.runs(mask, offs)
    first = tg.owners(begin, offs)
    words = tg.run_hashes(low, mask, begin, ends)
    pairs, at = tg.windows(words, first, 2)
    out = [((words % np.uint64(SIZES[0])).astype(np.int64), first), ((pairs % np.uint64(SIZES[1])).astype(np.int64) + _FROM[1], np.searchsorted(at, first))]
    wide = low.astype(np.uint32)
    code = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) if len(wide) > 2 else np.zeros(0, np.uint32)
    inside = np.ones(len(code), bool)
    for k in (1, 2):  # a trigram must not begin in the last two bytes of a text
        cut = offs[1:] - k
        inside[cut[(cut >= offs[:-1]) & (cut < len(code))]] = False
    spots = np.flatnonzero(inside)
    out.append((((code[spots] >> np.uint32(16)) % np.uint32(SIZES[2])).astype(np.int64) + _FROM[2], np.searchsorted(spots, offs)))
    return out


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return _sums(values, first) / np.maximum(np.diff(first), 1)


def sparse(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each text in order, how often each occurs, and where each text's begin."""
    n = len(offs) - 1
    keys = np.concatenate([tg.text_of(first) * _FROM[-1] + bucket for bucket, first in grams(data, offs)])
    keys, counts = np.unique(keys, return_counts=True)
    return keys % _FROM[-1], counts, np.searchsorted(keys, np.arange(n + 1) * _FROM[-1])


def meta_features(source: list, lang: list, length: list) -> np.ndarray:
    """One-hots of hashed source and language and of the length's half octave."""
    out = np.zeros((len(source), META_FEATURES))
    rows = np.arange(len(source))
    bucket = lambda values, n: [zlib.crc32(repr(v).encode()) % n for v in values]
    out[rows, bucket(source, SOURCES)] = 1
    out[rows, [SOURCES + k for k in bucket(lang, LANGS)]] = 1
    octave = [LENGTHS - 1 if v is None or v < 0 else min(LENGTHS - 2, int(2 * np.log10(v + 1) * 2)) for v in length]
    out[rows, [SOURCES + LANGS + k for k in octave]] = 1
    return out


@dataclass
class Logit:
    """A ridge logistic regression on standardised features, with a Platt scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40) -> Logit:
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):  # Newton steps
            p = _sigmoid(z @ w)
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
            w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        return Logit(mean, scale, w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.weights[:-1] + self.weights[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x) and 0 < y.sum() < len(y):
            platt = Logit.fit(self.raw(x)[:, None], y, 0.01)
            self.slope = max(float(platt.weights[0] / platt.scale[0]), 0.0)
            self.shift = float(platt.weights[1] - platt.weights[0] * platt.mean[0] / platt.scale[0])
            if self.slope == 0.0:  # an uninformative view says the prior
                self.shift = float(np.log(y.mean() / (1 - y.mean())))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Sample:
    """Documents to fit with: shares, hashed features as (buckets, counts, where each document's begin), and metadata."""

    shares: np.ndarray
    buckets: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    meta: np.ndarray

    def __len__(self) -> int:
        return len(self.shares)

    def take(self, rows: np.ndarray) -> Sample:
        rows = np.flatnonzero(rows) if rows.dtype == bool else rows
        begin = np.concatenate([[0], np.cumsum(np.diff(self.first)[rows])])
        taken = lambda values: np.concatenate([values[:0], *[values[self.first[i] : self.first[i + 1]] for i in rows]])
        return Sample(self.shares[rows], taken(self.buckets), taken(self.counts), begin, self.meta[rows])

    def held_by(self) -> np.ndarray:
        """How many documents have each bucket; some documents at a time, as counting widens them."""
        out = np.zeros(_FROM[-1], np.int64)
        for a in range(0, len(self), 256):
            end = self.first[min(a + 256, len(self))]
            out += np.bincount(self.buckets[self.first[a] : end], minlength=_FROM[-1])
        return out

    def plus(self, other: Sample) -> Sample:
        return Sample(
            np.concatenate([self.shares, other.shares]),
            np.concatenate([self.buckets, other.buckets]),
            np.concatenate([self.counts, other.counts]),
            np.concatenate([self.first, other.first[1:] + self.first[-1]]),
            np.concatenate([self.meta, other.meta]),
        )


def _averaged(odds: np.ndarray, sample: Sample) -> np.ndarray:
    """Each document's mean log-odds over its words, pairs and trigrams; some documents at a time, for the sake of memory."""
    out = np.zeros((len(sample), len(SIZES)))
    for a in range(0, len(sample), 256):
        first = sample.first[a : a + 257]
        buckets, counts = sample.buckets[first[0] : first[-1]], sample.counts[first[0] : first[-1]]
        for k in range(len(SIZES)):
            held = np.where((buckets >= _FROM[k]) & (buckets < _FROM[k + 1]), counts, 0)
            out[a : a + 256, k] = _sums(held * odds[buckets], first - first[0]) / np.maximum(_sums(held, first - first[0]), 1)
    return out


@dataclass
class TextView:
    """Log-odds of hashed features, and a regression on their means and on shares."""

    odds: np.ndarray
    model: Logit

    @staticmethod
    def fit(sample: Sample, y: np.ndarray, settings: Settings) -> TextView:
        good, bad = sample.take(y == 1).held_by(), sample.take(y == 0).held_by()
        extra = settings.smooth * (good + bad + 1) / (good + bad + 1).mean()
        n_good, n_bad = (y == 1).sum() + settings.smooth, (y == 0).sum() + settings.smooth
        odds = lambda g, b: np.log((good - g + extra) / (n_good - g)) - np.log((bad - b + extra) / (n_bad - b))
        rows = np.empty((len(sample), len(SIZES)))
        for label, own_ in ((0, (0, 1)), (1, (1, 0))):  # a document itself doesn't count
            seen = (good >= own_[0]) & (bad >= own_[1])
            with np.errstate(invalid="ignore", divide="ignore"):
                rows[y == label] = _averaged(np.where(seen, odds(*own_), 0.0), sample.take(y == label))
        return TextView(odds(0, 0), Logit.fit(np.column_stack([rows, sample.shares]), y, settings.ridge))

    def rows(self, sample: Sample) -> np.ndarray:
        return np.column_stack([_averaged(self.odds, sample), sample.shares])

    def rows_of(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The same for the whole texts of a chunk, without counting."""
        return np.column_stack([*[_means(self.odds[bucket], first) for bucket, first in grams(data, offs)], shares(data, offs)])


@dataclass
class CoTrained:
    text: TextView
    meta: Logit
    prior: float

    def logits(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views for rows (text, source, lang, n_chars)."""
        found = [self.text.model.logit(self.text.rows_of(data, offs)) for _, _, data, offs in tg.chunks(rows.column("text"))]
        return np.concatenate(found) if found else np.zeros(0), self.meta.logit(_metadata(rows))

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The probability of being good."""
        return _sigmoid(text + meta - self.prior)


class Trainer:
    """Both views' training rows: the labelled ones, of which every fourth is held out to calibrate, and those handed over."""

    def __init__(self, sample: Sample, y: np.ndarray, settings: Settings):
        held = np.arange(len(y)) % 4 == 3
        if not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
            held = np.zeros(len(y), bool)
        self.settings = settings
        self.held, self.held_y = (sample.take(held), y[held]) if held.any() else (sample, y)
        self.text, self.text_y = (sample.take(~held), y[~held]) if held.any() else (sample, y)
        self.meta, self.meta_y = self.text.meta, self.text_y

    def hand(self, taker: int, sample: Sample, y: np.ndarray) -> None:
        """More training rows for the text view (0) or the metadata view (1)."""
        if taker:
            self.meta, self.meta_y = np.concatenate([self.meta, sample.meta]), np.concatenate([self.meta_y, y])
        else:
            self.text, self.text_y = self.text.plus(sample), np.concatenate([self.text_y, y])

    def fit(self) -> CoTrained:
        text = TextView.fit(self.text, self.text_y, self.settings)
        text.model.calibrate(text.rows(self.held), self.held_y)
        meta = Logit.fit(self.meta, self.meta_y, self.settings.ridge)
        meta.calibrate(self.held.meta, self.held_y)
        return CoTrained(text, meta, float(np.log(self.held_y.mean() / (1 - self.held_y.mean()))))


def _metadata(rows: pa.RecordBatch) -> np.ndarray:
    return meta_features(*(rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _fields(df: DataFrame, text_col: str) -> list[Column]:
    return [own(df, text_col).cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, shares, buckets, counts, meta) of rows (doc_id, y, text, source, lang, n_chars)."""
    listed = lambda values, first, kind: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
    for batch in batches:
        for a, b, data, offs in tg.chunks(batch.column("text")):
            part = batch.slice(a, b - a)
            buckets, counts, first = sparse(data, offs)
            dense, meta = shares(data, offs), _metadata(part)
            rows = np.arange(b - a + 1)
            columns = [listed(dense.ravel(), rows * SHARES, pa.float64()), listed(buckets, first, pa.int16()), listed(counts, first, pa.int32()), listed(np.flatnonzero(meta) % META_FEATURES, rows * 3, pa.int16())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), *columns], ["doc_id", "y", "shares", "buckets", "counts", "meta"])


def _sampled(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> tuple[Sample, np.ndarray] | None:
    """The documents of ``wanted`` (doc_id, y; each id once, a bounded number) as a sample in order of a hash of the id, and their labels."""
    rows = docs.select(own(docs, id_col).alias("doc_id"), *_fields(docs, text_col)).join(F.broadcast(wanted), "doc_id")
    values = F.struct("text", "source", "lang", "n_chars")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(values).alias("h"), values.alias("v"))).alias("x")).select("doc_id", "y", "x.v.*")
    schema = T.StructType([one.schema["doc_id"], one.schema["y"], *T.StructType.fromDDL("shares array<double>, buckets array<short>, counts array<int>, meta array<short>").fields])
    return _gathered(mapped(one, _counted, schema).toArrow())


def _gathered(table: pa.Table) -> tuple[Sample, np.ndarray] | None:
    """The rows that ``_counted`` made in order of a hash of their ids; the table is copied once and can go before they are ordered."""
    if not table.num_rows:
        return None
    ids, y = table["doc_id"].to_pylist(), table["y"].to_numpy()
    order = np.array(sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), str(ids[i]))))
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in table["buckets"].chunks])
    shares_, buckets, counts, places = (np.concatenate([x.flatten().to_numpy() for x in table[c].chunks]) for c in ("shares", "buckets", "counts", "meta"))
    del table
    pa.default_memory_pool().release_unused()
    meta = np.zeros((len(ids), META_FEATURES))
    meta[np.repeat(np.arange(len(ids)), 3), places.astype(np.int64)] = 1
    sample = Sample(shares_.reshape(len(ids), SHARES), buckets, counts, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), meta)
    return sample.take(order), y[order]


def _confident(docs: DataFrame, model: CoTrained, settings: Settings, id_col: str, text_col: str, used: DataFrame) -> DataFrame:
    """(giver, label, key, doc_id, logit): each task's most confident documents, without those of ``used``."""
    rows = docs.select(own(docs, id_col).alias("doc_id"), *_fields(docs, text_col)).where("doc_id is not null").join(F.broadcast(used), "doc_id", "left_anti")
    rows = rows.withColumn("key", F.xxhash64("text", "source", "lang", "n_chars"))
    least = float(np.log(settings.sure / (1 - settings.sure)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            for giver, logit in enumerate(model.logits(batch)):
                for label, sign in ((1, 1.0), (0, -1.0)):
                    sure = np.flatnonzero(sign * logit >= least)
                    fresh = pa.table({"logit": pa.array(sign * logit[sure]), "key": batch.column("key").take(pa.array(sure)), "doc_id": batch.column("doc_id").take(pa.array(sure))})
                    table = pa.concat_tables([held[giver, label], fresh]) if (giver, label) in held else fresh
                    table = table.sort_by([("logit", "descending"), ("key", "ascending"), ("doc_id", "ascending")])
                    keys = table["key"].to_numpy()
                    _, places = np.unique(keys, return_index=True)  # equal documents count once
                    held[giver, label] = table.take(pa.array(np.sort(places)[: settings.handed]))
        for (giver, label), table in held.items():
            for batch in table.combine_chunks().to_batches():
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([giver] * n, pa.int32()), pa.array([label] * n, pa.int32()), batch.column("key"), batch.column("doc_id"), batch.column("logit")], ["giver", "label", "key", "doc_id", "logit"])

    id_field = rows.schema["doc_id"]
    schema = T.StructType([T.StructField("giver", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("key", T.LongType()), id_field, T.StructField("logit", T.DoubleType())])
    return mapped(rows, best, schema)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> CoTrained | None:
    """The classifier, or none where the labels aren't of both kinds."""
    spark, stage = docs.sparkSession, Staging(docs.sparkSession, "cotrain")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("doc_id", "y")
    ids = docs.select(own(docs, id_col).alias("doc_id"))
    chosen = stage.put(known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled), "chosen")
    got = _sampled(docs, chosen, id_col, text_col)
    if got is None or not 0 < got[1].sum() < len(got[1]):
        return None
    trainer = Trainer(*got, settings)
    del got  # the trainer has its own copy
    model = trainer.fit()
    kind = chosen.schema["doc_id"]
    taken = chosen.select("doc_id")  # bounded: the labelled sample and what was handed over
    for k in range(settings.rounds):
        screened = stage.put(_confident(docs, model, settings, id_col, text_col, taken), f"confident{k}")
        different = screened.groupBy("giver", "label", "key").agg(F.min("doc_id").alias("doc_id"), F.max("logit").alias("logit"))
        picks = [
            (giver, float(label), [r["doc_id"] for r in different.where(f"giver = {giver} and label = {label}").orderBy(F.desc("logit"), "key").limit(settings.handed).select("doc_id").collect()])
            for giver in (0, 1)
            for label in (1, 0)
        ]
        for giver in (0, 1):
            handed = {i: label for g, label, found in picks if g == giver for i in found}
            if handed:
                wanted = spark.createDataFrame(list(handed.items()), T.StructType([kind, T.StructField("y", T.DoubleType())]))
                more = _sampled(docs, wanted, id_col, text_col)
                if more:
                    trainer.hand(1 - giver, *more)
                taken = taken.union(wanted.select("doc_id"))
        model = trainer.fit()
    return model


def with_scores(docs: DataFrame, model: CoTrained | None, settings: Settings = Settings(), text_col: str = "text", *, only_kept: bool = False) -> DataFrame:
    """``docs`` with quality_score and quality_kept; ``only_kept`` leaves rejected documents out."""
    mine = docs.drop("quality_score", "quality_kept")
    if model is None:
        return mine.withColumns({"quality_score": F.lit(None).cast("double"), "quality_kept": F.lit(True)})
    names = mine.columns
    places = [names.index(c) for c in (text_col, "source", "lang", "n_chars")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch.column(i).cast(kind) for i, kind in zip(places, kinds, strict=True)], ["text", "source", "lang", "n_chars"])
            score = model.combined(*model.logits(rows))
            kept = pa.array(score >= settings.threshold)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), kept], [*names, "quality_score", "quality_kept"])
            yield out.filter(kept) if only_kept else out

    plain = mine.toDF(*[f"c{i}" for i in range(len(names))])  # mapInArrow resolves its input columns by unquoted names
    return mapped(plain, scored, extended(mine.schema, quality_score=T.DoubleType(), quality_kept=T.BooleanType()))
