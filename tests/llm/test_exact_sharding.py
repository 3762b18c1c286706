import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwright.llm import exact, sharding

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    return groups


def check(df, rows, **how):
    got = exact.radix_groups(df, **how).collect()
    groups = brute(rows)
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()) for i, t in rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): ids for k, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(by_sha, 1))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_edges(edges):
    check(edges, [(r.doc_id, r.text) for r in edges.collect()])


def test_nothing(nothing):
    assert exact.radix_groups(nothing).count() == 0 and exact.drop_exact_copies(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_prefixes_and_lengths(spark, seed):
    rng = random.Random(seed)
    stem = "".join(rng.choice("ab") for _ in range(300))
    texts = [stem[: rng.randint(0, 300)] + rng.choice(["", "x", "X", "é", "É"]) for _ in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, head=3, factor=2, widest=40)


def test_kept_rows_keep_their_columns(edges):
    out = exact.drop_exact_copies(edges)
    assert out.columns == edges.columns and {r.doc_id for r in out.collect() if r.text and r.text.startswith("lorem")} == {7, 8}
    assert out.where("rid != 'mine' or row != 'mine'").count() == 0


def test_shards_edges(edges):
    got = sharding.shard_rows(edges, sharding.tree(8), sharding.tree(9)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in edges.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 2}) == 1


def test_slots_are_gapless_and_growth_only_takes_in(spark, nothing):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shard_rows(df, sharding.tree(8), sharding.tree(9)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(abs(len(s) / 2500 - 1) < 0.1 for s in by.values())
    assert abs(sum(r.grown_shard == 8 for r in got) / 20000 - 1 / 9) < 0.01
    assert sharding.shard_rows(nothing, sharding.tree(8)).count() == 0


def test_movement_stays_in_changed_subtrees(spark):
    before = sharding.tree(8)
    after = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in before]  # heavier: only towards its subtrees
    df = spark.range(20000).select(sharding.tree_shard(F.col("id"), before).alias("a"), sharding.tree_shard(F.col("id"), after).alias("b"))
    moved = df.where("a != b").groupBy("a", "b").count().collect()
    region, rack = {s.shard: s.region for s in before}, {s.shard: s.rack for s in before}
    for r in moved:
        assert region[r.b] == region[5]
        if region[r.a] == region[5]:
            assert rack[r.b] == rack[5]
            if rack[r.a] == rack[5]:
                assert r.b == 5
    share = df.groupBy("b").count().where("b = 5").first()["count"] / 20000
    assert abs(share - 0.3) < 0.02
    with pytest.raises(ValueError):
        sharding.tree_shard(F.lit(1), [sharding.Shard(0, 0, 0, 0.0)])
