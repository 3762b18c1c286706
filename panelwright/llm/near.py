"""Near-duplicate classes by order MinHash, verified by a banded alignment.

A text is its words in lower case (runs of ASCII letters, digits and underscores, and of all other
non-ASCII characters). Its k-mers are five-word shingles, each labelled with its occurrence, so a
text's labelled k-mers are all different. Each of ``SKETCHES`` hash functions samples the
``SAMPLED`` least labelled k-mers; a sketch is those k-mers in text order. Two texts are compared
if they share a sketch: at similarity 0.8 all but about one pair in 80,000 do.

Texts that share a sketch aren't all paired. A bucket's hub is its member whose sketches are
shared most, and each member is compared with its hubs. Where a hub's members end up in different
components, the hub's most similar member takes its place (in a group of edited copies that is the
original, or as good as it) and is compared with the members outside its component. While the
other members are in several components, pairs of them are left to find, exactly, by a prefix
filter: each member orders its k-mers, those that the hub lacks first and the least first, and
draws as many as a partner of similarity 0.8 can't all miss. Two members meet in the first k-mer
that both draw; what comes before its places is matched by neither, so they are compared only if
what is left is enough for similarity 0.8 (and they aren't in one component). Nor can they match
more than the lesser of their numbers of k-mers of each class, a class being some bits of the
k-mer and whether the hub has it; where that is too few, they aren't compared either. What a family has in
common stands last in its members' orders, and a member that the hub is unlike has more of its own
before it than a partner may miss, so members meet in what they alone share. A pair that draws
several common k-mers counts where it meets first. No bucket, round or partner is capped.

Verification aligns the two sequences of labelled k-mers: equal k-mers whose places differ by at
most the band (the k-mers that a pair of similarity 0.8 can have unmatched) are chained in order;
with M in the longest chain, similarity is M / (a + b - M). At 0.8 or more, texts are linked, and
linked texts are one class.

Defined results: texts with equal words are one class whatever their number; texts without words
(null counts as empty) are one class where they are equal. Texts with fewer than five words have
one k-mer. Ids may be of any type with an order. Null ids sort first; of repeated rows one is kept. An empty table gives an empty table.
Other columns are not read by ``near_classes`` and pass through ``drop_near_copies``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textgrid as tg
from .arrows import mapped
from .columns import extended, own, whole_row
from .components import component_links
from .staging import Staging

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
SAMPLED = 3

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SEEDS = tg.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_MULT = np.uint64(0x9FB21C651E98DF25)
_S29 = np.uint64(29)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: How many of a member's keys before a place are looked through for one where a pair has met already; a pair that meets in more is only compared once, too.
LOOK_BACK = 64
#: Classes of k-mers by their first bits.
CLASS_BITS = 6
CLASSES = 1 << CLASS_BITS


def kmers(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled k-mers of a chunk's texts in text order, where each text's begin, word hashes, and where their texts' begin."""
    mask = _WORD[data]
    starts, ends = tg.runs(mask, offs)
    first = tg.owners(starts, offs)
    words = tg.run_hashes(data, mask, starts, ends)
    h, at = tg.windows(words, first, SHINGLE)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        whole = np.array([np.bitwise_xor.reduce(tg.mix(words[first[t] : first[t + 1]] + np.arange(1, n_words[t] + 1, dtype=np.uint64))) for t in short], np.uint64)
        h, at = np.concatenate([h, whole]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    begin = np.searchsorted(at, first)
    text = tg.text_of(begin)
    label = tg.occurrence(tg.salted(h, text))
    return tg.mix(h + label * np.uint64(0xC2B2AE3D27D4EB4F)), begin, words, first


def sketches(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SKETCHES hashes for each text that has a k-mer, a column each."""
    held = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros((len(held), SKETCHES), np.uint64)
    if not len(held):
        return out
    seg, lens = begin[held], np.diff(begin)[held]
    place = np.arange(len(h))
    for j in range(SKETCHES):
        v = (h ^ _SEEDS[j]) * _MULT
        v ^= v >> _S29
        v *= _SEEDS[j] | np.uint64(1)
        picks = np.empty((SAMPLED, len(held)), np.int64)
        for s in range(SAMPLED):
            low = np.repeat(np.minimum.reduceat(v, seg), lens)
            picks[s] = np.minimum.reduceat(np.where(v == low, place, len(h)), seg)
            v[picks[s]] = _MAX
        picks.sort(axis=0)
        key = np.full(len(held), _SEEDS[j])
        for s in range(SAMPLED):
            key = tg.mix(key * _MULT + h[picks[s]])
        out[:, j] = key
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the two words-keys and the sketches (empty without words) to (doc_id, text, ...)."""
    for batch in batches:
        low = pc.utf8_lower(batch.column("text"))
        for a, b, data, offs in tg.chunks(low):
            h, begin, words, first = kmers(data, offs)
            n = b - a
            held, worded = np.diff(begin) > 0, np.diff(first) > 0
            keys = np.zeros((2, n), np.uint64)
            text = tg.text_of(first)
            at = (np.arange(len(words)) - first[text]).astype(np.uint64)
            for i, odd in enumerate((np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xAEF17502108EF2D9))):
                if len(words):
                    keys[i][worded] = np.add.reduceat(tg.mix(tg.mix(words + odd) + at * odd), first[:-1][worded])
                raw = tg.run_hashes(data, None, offs[:-1][~worded & (np.diff(offs) > 0)], offs[1:][~worded & (np.diff(offs) > 0)])
                keys[i][~worded & (np.diff(offs) > 0)] = tg.mix(raw ^ odd)
            found = sketches(h, begin)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held * SKETCHES)]), pa.int32()), pa.array(found.ravel().view(np.int64)))
            part = batch.slice(a, n)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], [*part.schema.names, "ka", "kb", "sketch"])


def chained(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest in-order chain of equal k-mers whose places differ by at most ``band``."""
    _, pa_, pb = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(pa_ - pb) <= band
    pa_, pb = pa_[near], pb[near]
    line = pb[np.argsort(pa_)]
    if len(line) < 2 or (line[1:] > line[:-1]).all():
        return len(line)
    tops: list[int] = []
    for x in line.tolist():
        at = bisect_left(tops, x)
        if at == len(tops):
            tops.append(x)
        else:
            tops[at] = x
    return len(tops)


def alignment(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sequences of labelled k-mers; 0 where their lengths alone rule out the limit."""
    na, nb = len(a), len(b)
    least = SIMILARITY / (1 + SIMILARITY) * (na + nb)  # matches at the limit
    if not na or min(na, nb) < least - 1e-9:
        return 0.0
    m = chained(a, b, int(max(na, nb) - least) + 1)
    return m / (na + nb - m)


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sequences of labelled k-mers are similar enough."""
    return alignment(a, b) >= SIMILARITY - 1e-9


def _kmer_lists(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, offs in tg.chunks(pc.utf8_lower(texts)):
        h, begin, _, _ = kmers(data, offs)
        for i in range(len(begin) - 1):
            yield h[begin[i] : begin[i + 1]]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, sim, ok) of the rows (u, v, a, b): how similar the texts a and b are, and whether enough."""
    for batch in batches:
        sim = [alignment(x, y) for x, y in zip(_kmer_lists(batch.column("a")), _kmer_lists(batch.column("b")), strict=True)]
        ok = [x >= SIMILARITY - 1e-9 for x in sim]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sim, pa.float64()), pa.array(ok, pa.bool_())], ["u", "v", "sim", "ok"])


def drawn(member: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """The member's first k-mers, one more than a partner at the limit can miss: those that the hub lacks before the others, the least first."""
    member = np.sort(member)
    held = np.isin(member, hub)
    return np.concatenate([member[~held], member[held]])[: int((1 - SIMILARITY) * len(member) + 1e-9) + 1]


def class_counts(member: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """How many of the member's k-mers are of each class: their first bits, and whether the hub has them."""
    first = (member >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    return np.bincount(first + CLASSES * np.isin(member, hub), minlength=2 * CLASSES)


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, v, size, keys, held) for the rows (u, v, a, b): how many k-mers u has, those that it draws in the family of v in order, and how many it has of each class."""
    for batch in batches:
        families = tg.mix(batch.column("v").to_numpy().view(np.uint64))
        keys, sizes, held = [], [], []
        for family, x, y in zip(families, _kmer_lists(batch.column("a")), _kmer_lists(batch.column("b")), strict=True):
            keys.append(tg.mix(drawn(x, y) ^ family).view(np.int64))
            sizes.append(len(x))
            held.append(class_counts(x, y))
        if keys:
            ends = np.cumsum([0, *[len(x) for x in keys]])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * 2 * CLASSES, pa.int32()), pa.array(np.concatenate(held).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(sizes, pa.int64()), lists, counts], ["node", "v", "size", "keys", "held"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) with the texts a and b of both."""
    left = pairs.join(texts.select(F.col("rid").alias("u"), F.col("text").alias("a")), "u")
    return left.join(texts.select(F.col("rid").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")


def _placed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components cu and cv of both."""
    of = labels.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    to = labels.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    return pairs.join(of, "u", "left").join(to, "v", "left").withColumns({"cu": F.coalesce("cu", "u"), "cv": F.coalesce("cv", "v")})


class _Links:
    """Compares pairs, and keeps the components of what was linked so far."""

    def __init__(self, texts: DataFrame, stage: Staging):
        self.texts, self.stage, self.n = texts, stage, 0
        self.tried: DataFrame | None = None
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> DataFrame:
        """(u, v, sim, ok) of the pairs that are in different components and not compared yet."""
        stage, n = self.stage, self.n
        if self.labels is not None:
            pairs = _placed(pairs, self.labels).where("cu != cv").select("u", "v")
            pairs = pairs.join(self.tried, ["u", "v"], "left_anti")
        pairs = stage.put(pairs, f"pairs{n}")
        if self.tried is None:  # all later pairs are of nodes of these
            needed = pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()
            self.texts = stage.put(self.texts.join(stage.put(needed, "needed"), "rid"), "texts")
        found = stage.put(mapped(_with_texts(pairs, self.texts), _verified, "u long, v long, sim double, ok boolean"), f"found{n}")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        new = found.where("ok").select("u", "v")
        if self.labels is None or not new.isEmpty():
            old = [] if self.labels is None else [self.labels.select(F.col("node").alias("u"), F.col("comp").alias("v"))]
            for more in old:
                new = new.union(more)
            self.labels = component_links(new, stage, f"parts{n}").select(F.col("u").alias("node"), F.col("v").alias("comp"))
        self.n += 1
        return found


def near_links(texts: DataFrame, sketched: DataFrame, stage: Staging) -> DataFrame:
    """(node, comp) for all nodes that are linked and don't stand for their component themselves.

    ``texts`` has (rid, text), ``sketched`` (rid, sketch), each node once.
    """
    links = _Links(texts, stage)
    keys = stage.put(sketched.select(F.col("rid").alias("node"), F.posexplode("sketch").alias("j", "key")).select("key", "node"), "keys0")
    buckets = stage.put(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets0")
    shared = stage.put(keys.join(buckets, "key"), "shared0")
    fame = stage.put(shared.groupBy("node").agg(F.sum("n").alias("fame")), "fame")
    famed = stage.put(shared.join(fame, "node").select("key", "node", "fame"), "famed")
    hubs = stage.put(famed.groupBy("key").agg(F.max_by("node", F.struct("fame", -F.col("node"))).alias("hub")), "hubs")
    family = stage.put(famed.join(hubs, "key").where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), "family")
    found = links.compare(family)
    stage.drop("keys0", "buckets0", "shared0", "fame", "famed", "hubs")
    # a family that fell apart goes to its hub's most similar member
    placed = stage.put(_placed(family, links.labels).join(found.select("u", "v", "sim"), ["u", "v"], "left"), "placed0")
    best = F.max_by("u", F.struct("sim", -F.col("u"))).alias("w")
    torn = placed.groupBy("v").agg(F.count("*").alias("n"), F.count_if(F.col("cu") != F.col("cv")).alias("apart"), best).where("apart > 0 and n > 1").select("v", "w")
    torn = stage.put(torn, "torn")
    moved = stage.put(placed.select("u", "v").join(torn, "v").where("u != w").select("u", F.col("w").alias("v")).distinct(), "moved")
    links.compare(moved)
    # what is left are pairs of two other members
    left = stage.put(_placed(moved, links.labels), "left")
    apart = left.groupBy("v").agg(F.min("cu").alias("least"), F.max("cu").alias("most")).where("least != most").select("v")
    again = stage.put(left.select("u", "v").join(stage.put(apart, "apart"), "v").select("u", "v"), "again")
    if not again.isEmpty():
        links.compare(_meeting(again, links, stage))
    return links.labels


def _meetings(several: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``_meeting``, again where they meet anew after more than LOOK_BACK other keys or in another family."""
    # members of a family order their k-mers alike, so where two meet anew, they have met at a key before both places, and it is among these but for far ones
    back = Window.partitionBy("node", "v").orderBy("place").rowsBetween(-LOOK_BACK, -1)
    # the counts by class are wide, so only what meets another component carries them
    every = several.withColumn("before", F.collect_list("key").over(back)).join(members.select("node", "v", "held"), ["node", "v"])
    # in a bucket only what is outside its main component looks for partners
    u = every.where("comp != main").select("key", F.col("node").alias("u"), F.col("size").alias("a"), F.col("place").alias("i"), F.col("held").alias("p"), F.col("before").alias("s"), F.col("comp").alias("cu"))
    v = every.select("key", "main", F.col("node").alias("v"), F.col("size").alias("b"), F.col("place").alias("j"), F.col("held").alias("q"), F.col("before").alias("t"), F.col("comp").alias("cv"))
    needed = F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("a") + F.col("b")) - 1e-6
    once = (F.col("cv") == F.col("main")) | (F.col("u") > F.col("v"))
    enough = F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) >= needed
    first = ~F.arrays_overlap("s", "t")
    # one lambda; as 2 * CLASSES terms it took ten times as long
    alike = F.aggregate(F.zip_with("p", "q", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x) >= needed
    return u.join(v, [u["key"] == v["key"], F.col("cu") != F.col("cv"), once, enough, first, alike]).select("u", "v")


def _meeting(family: DataFrame, links: _Links, stage: Staging) -> DataFrame:
    """The pairs (u, v) of two members of one family (u, v: the hub) that are in different components and may be similar."""
    members = stage.put(mapped(_with_texts(family, links.texts), _drawn, "node long, v long, size long, keys array<long>, held array<int>"), "drawn")
    comps = links.labels.select("node", "comp")
    keys = members.drop("held").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    keys = stage.put(keys.select("node", "v", "size", "comp", F.posexplode("keys").alias("place", "key")), "drawn-parts")
    parts = keys.groupBy("key", "comp").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0").select("key", "main")
    several = stage.put(keys.join(stage.put(buckets, "mains"), "key"), "several")
    pairs = _meetings(several, members).distinct()
    pairs = stage.put(pairs, "meeting")
    stage.drop("drawn", "drawn-parts", "several")
    return pairs


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: bool = False) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size and kept (one row a class) for each row; with ``carry`` also ``row``."""
    stage = Staging(docs.sparkSession, "near")
    others = [whole_row(docs, text_col).alias("others")] if carry else []
    rows = docs.select(own(docs, id_col).alias("doc_id"), own(docs, text_col).cast("string").alias("text"), *others)
    schema = extended(rows.schema, ka=T.LongType(), kb=T.LongType(), sketch=T.ArrayType(T.LongType()))
    every = stage.put(mapped(rows, _sketched, schema).withColumn("rid", F.monotonically_increasing_id()), "rows")
    node = F.min_by("rid", F.struct("doc_id", "rid")).alias("node")
    nodes = stage.put(every.groupBy("ka", "kb").agg(node, F.min(F.struct("doc_id", "rid")).alias("least"), F.count("*").alias("n")), "nodes")
    firsts = stage.put(every.select("rid", "sketch").join(nodes.select(F.col("node").alias("rid")), "rid"), "firsts")
    labels = near_links(every.select("rid", "text"), firsts, stage)
    placed = stage.put(nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    classes = stage.put(placed.groupBy("comp").agg(F.min("least").alias("least"), F.sum("n").alias("class_size")), "classes")
    known = stage.put(placed.select("ka", "kb", "comp").join(classes, "comp"), "known")
    stage.drop("firsts", "texts", "placed", "classes")
    kept = (F.col("least.rid") == F.col("rid")).alias("kept")
    row = [F.struct(*[F.col("text").alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in docs.columns]).alias("row")] if carry else []
    return (
        every.select("rid", "doc_id", "ka", "kb", *(["text", "others"] if carry else []))
        .join(known, ["ka", "kb"])
        .select("doc_id", F.col("least.doc_id").alias("class_id"), "class_size", kept, *row)
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the one with the least id."""
    return near_classes(docs, id_col, text_col, carry=True).where("kept").select("row.*")
