"""Columns of any name, ids of any type, and the registered queries against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwright.llm import bpe, cotrain, exact, mixing, near, pii, queries, repetition, sharding

from .test_near import classes
from .test_text_operators import rules

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def odd(edges):
    """Edge rows with columns that need quoting, and ids that are strings."""
    df = edges.withColumns({"my col": F.lit(1), "a.b": F.lit("mine"), "back`tick": F.lit(2.5), "nested": F.struct(F.lit(1).alias("x y"))})
    return df.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))


def test_rows_keep_columns_of_any_name(spark, odd):
    assert exact.drop_exact_copies(odd).columns == odd.columns
    out = near.drop_near_copies(odd)
    assert out.columns == odd.columns and out.schema["nested"].dataType.simpleString() == "struct<x y:int>"
    assert {r["a.b"] for r in out.collect()} == {"mine"}
    mixed = mixing.replicate(odd, {"a": 1.0, "b": 1.0}, marks=False)
    assert mixed.columns == odd.columns and mixed.count() > 0
    labels = spark.createDataFrame([("d-1", 1), ("d-9", 0), ("d-6", 0), ("d-10", 1)], "doc_id string, quality int")
    scored = cotrain.with_scores(odd, cotrain.fit(odd, labels))
    assert scored.columns == [*odd.columns, "quality_score", "quality_kept"] and scored.where("quality_score is null").count() == 0


def test_ids_of_another_type(odd):
    n = odd.count()
    ids = Counter(r.doc_id for r in odd.collect())
    frames = [exact.radix_groups(odd), near.near_classes(odd), repetition.repetition_rules(odd), pii.private_spans(odd), sharding.shard_rows(odd, sharding.tree(8)), bpe.encode_documents(odd, public_tokenizers.path("word_bpe_49k.json"))]
    for df in frames:
        assert df.count() == n and Counter(r.doc_id for r in df.select("doc_id").collect()) == ids


def test_very_long_texts(spark):
    """Texts of a megabyte, equal but for their ends, two of them equal."""
    body = "lorem ipsum dolor sit amet " * 40_000
    rows = [(1, body + "a"), (2, body + "b"), (3, body + "a"), (4, body[:-1]), (5, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.radix_groups(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1)}
    assert {r.doc_id: r.class_id for r in near.near_classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert {r.doc_id: r.n_words for r in repetition.repetition_rules(df).collect()}[1] == 200_001
    assert pii.private_spans(df).where("size(spans) > 0").count() == 0


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_registered_shards(spark, sf):
    """Sizes, checksums and slots, and the draws of the tree in plain arithmetic."""
    def clock(key, level, name, weight):
        u = (int(hashlib.md5(f"{level}|{name}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) / weight, name

    def descend(key, shards):
        for level in ("region", "rack", "shard"):
            weights = defaultdict(float)
            for s in shards:
                weights[getattr(s, level)] += s.weight
            child = min(clock(key, level, c, w) for c, w in weights.items())[1]
            shards = [s for s in shards if getattr(s, level) == child]
        return shards[0].shard

    docs = dict(texts_of(spark, sf))
    got = queries.op2_hash_tree_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        body = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert (r.shard, r.grown_shard) == (descend(r.doc_id, sharding.tree(8)), descend(r.doc_id, sharding.tree(9)))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_registered_near_classes(spark, sf):
    want = classes([(i, t) for i, t in texts_of(spark, sf)])
    got = {r.doc_id: r.class_id for r in queries.op5_order_minhash(spark, sf).collect()}
    plain = lambda m: {frozenset(j for j in m if m[j] == c) for c in set(m.values())}
    assert plain(got) == plain(want)


def test_registered_tokens(spark, sf):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_speculative_bpe(spark, sf).collect()}
    for i, text in texts_of(spark, sf):
        ids = want.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(want.decode(ids, skip_special_tokens=False)))


def test_registered_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_cotrained_quality(spark, sf)
    assert got.columns == ["doc_id", "score", "kept"] and got.count() == docs.count()
    good = got.join(labels, "doc_id").where("quality = 1")
    assert good.where("kept").count() / good.count() > 0.98
    assert got.where("kept != (score >= 0.2)").count() == 0


def coverage(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    seen = Counter(grams)
    inside = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside) / max(sum(map(len, words)), 1)


def line_coverage(text):
    words, seen, again = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set(), 0
    for line in (text or "").split("\n"):
        held = re.findall(r"[^\x20\x09-\x0D]+", line)
        if held:
            again += sum(map(len, held)) if line in seen else 0
            seen.add(line)
    return again / max(sum(map(len, words)), 1)


def test_registered_repetition(spark, sf):
    """The verdict too: coverages by counting, and the limits."""
    got = {r.doc_id: r for r in queries.op10_repetition_rules(spark, sf).collect()}
    for i, text in texts_of(spark, sf):
        r, base = got[i], rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        shares = {n: coverage(text, n) for n in repetition.COVERAGE_LIMITS}
        assert all(abs(r[f"coverage_{n}"] - s) < 1e-12 for n, s in shares.items()) and abs(r.line_coverage - line_coverage(text)) < 1e-12
        over = any(shares[n] > limit for n, limit in repetition.COVERAGE_LIMITS.items()) or line_coverage(text) > repetition.LINE_LIMIT
        assert r.kept == (not base[5] and not over)
