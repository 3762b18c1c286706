"""Byte-pair encoding by speculation: greedy longest match, then checks of all adjacent pairs.

A word's tokens under byte-pair merging are exactly those token sequences of which every adjacent
pair is itself what merging makes of the pair's own symbols. So the words of a chunk that are not
known yet are cut greedily into the longest vocabulary pieces, all adjacent pairs of all these
words are checked at once against a sorted table of known verdicts, pairs not met before are
merged exactly (once each), and only words with a failing pair are merged exactly as a whole.

The vocabulary file's text is read by the driver and broadcast (its size is that of the file).
Words' results are remembered per Python worker, at most ``REMEMBERED`` words and ``PAIRS`` pairs.

The text rules are those of the word-end vocabulary: special tokens are cut out of the raw text
first; then NFC, white space to one space, lower case; then contractions, runs of letters, single
digits and runs of other symbols are words, as UTF-8 bytes in the printable byte alphabet, the
last symbol of a word carrying the word-end mark. Decoding joins the tokens' strings by spaces.

Defined results: null counts as empty; empty and blank texts have no tokens and decode to the
empty string. Null ids and repeated rows are kept. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrows import mapped
from .columns import own

REMEMBERED = 250_000
PAIRS = 1_000_000
#: About so many characters of texts are encoded together.
CHUNK = 1 << 20
#: Words of more symbols are merged with a heap instead of by scans.
SCANNED = 48

_SPACE = r"\t-\r\x20\x85\xA0  -     　"


def _alphabet() -> list[str]:
    """The printable character of each byte: itself where it is printable Latin-1, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary file's text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for name, i in (self.vocab | self.special).items():
            self.names[i] = name
        self.arrow_names = pa.array(self.names)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.table = str.maketrans({chr(b): c for b, c in enumerate(_alphabet())})
        self.longest = max(map(len, self.vocab))
        self.reach: dict[str, int] = {}  # the longest piece that begins with three symbols
        for name in self.vocab:
            if len(name) > 2:
                self.reach[name[:3]] = max(self.reach.get(name[:3], 2), len(name))
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+")
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pair_keys = np.zeros(0, np.int64)
        self.pair_ok = np.zeros(0, bool)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        for name, i in self.special.items():
            self._remember([name], [[i]])

    def _remember(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        for w in words:
            self.slot[w] = len(self.slot)
        self.at = np.concatenate([self.at, len(self.tokens) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.tokens = np.concatenate([self.tokens, np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))])

    def symbols(self, word: str) -> list[str]:
        """The word's bytes in the printable alphabet, the last with the word-end mark."""
        out = list(word.encode().decode("latin-1").translate(self.table))
        out[-1] += self.end
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        if len(ids) > SCANNED:
            return self._merged_long(ids)
        ids, none = list(ids), (1 << 60, -1)
        found = [ranks.get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k] = best[1]
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = ranks.get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = ranks.get((ids[k], ids[k + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        ids, n = list(ids), len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.ranks[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            j = after[k] if ids[k] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = self.ranks[a, b][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (found := self.ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, (ids[left], ids[right])))
        return [i for i in ids if i >= 0]

    def greedy(self, word: str) -> list[int]:
        """The word's bytes cut from the left into the longest pieces of the vocabulary."""
        s = word.encode().decode("latin-1").translate(self.table)
        n, at, out, vocab, reach = len(s), 0, [], self.vocab, self.reach
        while at < n:
            if (i := vocab.get(s[at:] + self.end) if n - at <= self.longest else None) is not None:
                out.append(i)
                break
            for to in range(min(n - 1, at + reach.get(s[at : at + 3], 2)), at, -1):
                if (i := vocab.get(s[at:to])) is not None:
                    out.append(i)
                    at = to
                    break
            else:  # a word's last symbol alone always has its word-end form, so this is not reached
                raise ValueError(f"no piece for {s[at:]!r}")
        return out

    def _pieces(self, token: int) -> list[int]:
        name = self.names[token]
        ended = name.endswith(self.end) and len(name) > len(self.end)
        body = list(name[: -len(self.end)] if ended else name)
        if ended:
            body[-1] += self.end
        return [self.vocab[c] for c in body]

    def _judge(self, keys: np.ndarray) -> np.ndarray:
        """Verdicts on distinct pair keys; a key with second part 0xFFFFFF is a word of one token."""
        at = np.searchsorted(self.pair_keys, keys)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == keys[known]
        out = np.zeros(len(keys), bool)
        out[known] = self.pair_ok[at[known]]
        fresh = keys[~known]
        if len(fresh):
            got = np.zeros(len(fresh), bool)
            for k, key in enumerate(fresh.tolist()):
                a, b = key >> 24, key & 0xFFFFFF
                whole = [a] if b == 0xFFFFFF else [a, b]
                got[k] = self.merged([i for t in whole for i in self._pieces(t)]) == whole
            out[~known] = got
            if len(self.pair_keys) + len(fresh) > PAIRS:
                self.pair_keys, self.pair_ok = fresh, got
            else:
                keys_, oks = np.concatenate([self.pair_keys, fresh]), np.concatenate([self.pair_ok, got])
                order = np.argsort(keys_)
                self.pair_keys, self.pair_ok = keys_[order], oks[order]
        return out

    def learn(self, words: list[str]) -> int:
        """Encodes new words and remembers them; how many needed exact merging."""
        ids = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        tokens = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes) - 1
        after = np.append(tokens[1:], 0)
        after[ends] = 0xFFFFFF
        of = np.repeat(np.arange(len(ids)), sizes)
        use = np.ones(len(tokens), bool)
        use[ends[sizes > 1]] = False
        keys, where = np.unique((tokens << 24 | after)[use], return_inverse=True)
        failing = np.unique(of[use][~self._judge(keys)[where]])
        for k in failing.tolist():
            ids[k] = self.merged([self.vocab[c] for c in self.symbols(words[k])])
        self._remember(words, ids)
        return len(failing)

    def split(self, text: str) -> list[str]:
        """A text's words, and its special tokens whole."""
        out: list[str] = []
        for k, part in enumerate(self.cuts.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                # white space is in no word, so making it one space changes nothing
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += (self.plain if part.isascii() else self.words).findall(part.lower())
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids of the texts, and the offsets of each text's."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        split = [self.split(t) for t in texts]
        places = [list(map(self.slot.get, words)) for words in split]
        lacking = [k for k, found in enumerate(places) if None in found]
        if lacking:
            self.learn(list(dict.fromkeys(w for k in lacking for w in split[k] if w not in self.slot)))
            for k in lacking:
                places[k] = list(map(self.slot.get, split[k]))
        counts = np.fromiter(map(len, places), np.int64, len(places))
        slots = np.fromiter(itertools.chain.from_iterable(places), np.int64, int(counts.sum()))
        sizes = self.size[slots]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.tokens[np.repeat(self.at[slots] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The tokens' strings joined by spaces."""
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.arrow_names.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


_codecs: dict[int, Codec] = {}


def codec_of(text: str) -> Codec:
    """One codec a process and vocabulary."""
    key = zlib.crc32(text.encode())
    if key not in _codecs:
        _codecs[key] = Codec(text)
    return _codecs[key]


def _stretches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows that are encoded together: about CHUNK characters, or one longer text."""
    a = size = 0
    for b, n in enumerate(sizes):
        if size and size + n > CHUNK:
            yield a, b
            a, size = b, 0
        size += n + 1
    if a < len(sizes):
        yield a, len(sizes)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (token ids) and decoded (the ids decoded again) for each row."""
    with open(vocabulary, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            texts = batch.column("text")
            for a, b in _stretches(pc.utf8_length(texts).to_pylist()):
                ids, offsets = codec.encode_batch(texts.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                decoded = codec.decode_batch(ids, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, decoded], ["doc_id", "ids", "decoded"])

    rows = docs.select(own(docs, id_col).alias("doc_id"), F.coalesce(own(docs, text_col).cast("string"), F.lit("")).alias("text"))
    return mapped(rows, encoded, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
