import base64
import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelwright.llm import chat, mixing, queries, warc


def inverse(mean, u):
    pieces = math.ceil(mean / mixing.SPLIT)
    total = 0
    for x in u:
        p = c = math.exp(-mean / pieces)
        k = 0
        while c <= x:
            k += 1
            p *= mean / pieces / k
            c += p
        total += k
    return total


def test_counts_invert_poisson(spark):
    rows = [(i, "x" * (1 + i % 7), "a" if i % 50 else "b") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.replicate(df, {"a": 1.0, "b": 1.0}, seed=3).collect())
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    for i, _, s in rows:
        rate = 0.5 * sum(size.values()) / size[s]
        u = [int(hashlib.md5(f"3|count|{i}|{j}".encode()).hexdigest()[:13], 16) / 16**13 for j in range(1, math.ceil(rate / 32) + 1)]
        assert got.get(i, 0) == inverse(rate, u)
    mixed = Counter()
    for i, t, s in rows:
        mixed[s] += len(t) * got.get(i, 0)
    assert abs(mixed["a"] / sum(mixed.values()) - 0.5) < 0.05


def test_mixing_edges(edges, nothing):
    out = mixing.replicate(edges, {"a": 3.0, "b": 1.0}, rest=0.5, seed=1)
    assert out.columns == [c for c in edges.columns if c != "copy"] + ["copy", "n_copies"]
    for r in out.collect():
        assert 1 <= r.copy <= r.n_copies
    assert mixing.replicate(edges, {"a": 1.0}, marks=False).columns == edges.columns
    assert mixing.replicate(nothing, {"a": 1.0}).count() == 0 and mixing.replicate(edges, {}, rest=0.0).count() == 0


def test_a_source_without_bytes_is_left_out(spark):
    rows = [(1, None, "a"), (2, "", "a"), *[(i, "x" if i > 3 else None, "b") for i in range(3, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.replicate(df, {"a": 1.0, "b": 1.0}, seed=1).collect())
    alone = Counter(r.doc_id for r in mixing.replicate(df.where("source = 'b'"), {"b": 1.0}, seed=1).collect())
    assert got and got == alone and not got.keys() & {1, 2}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = entry.queries()[name](spark, sf), con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(want.fetchall())


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "chosen", 2, "user", "ok"),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no<|im_end|>"),
        (2, "chosen", 0, None, None), (2, "rejected", 0, "unknown", ""),
        (3, "chosen", None, "user", "a"), (None, "chosen", 0, "user", "a"), (4, "other", 0, "user", "a"),
    ]
    got = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    start, end = map(int, one.chosen_spans.split(":"))
    assert one.chosen[start:end] == "yes<|im_end|>"
    start, end = map(int, one.rejected_spans.split(":"))
    assert one.rejected[start:end] == "no<| im_end|><|im_end|>"
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and got[3].rejected == "" and got[3].chosen_spans == ""
    odd = [(7, "chosen", 0, "user", "<|im_x"), (7, "rejected", 0, "user", "<| im_x"), (8, "chosen", 0, "assistant", "é" * 100000), (8, "chosen", 0, "assistant", "é" * 100000)]
    for extra in ("c", "r", "t", "my col", "a.b"):
        more = spark.createDataFrame(odd, "pair_id long, side string, turn int, role string, text string").withColumn(extra, F.lit("mine"))
        found = {r.pair_id: r for r in chat.format_preferences(more).collect()}
        assert found[7].n_common == 0 and found[7].chosen == found[7].rejected == "<|im_start|>user\n<| im_x<|im_end|>\n"  # compared as written
        assert found[8].chosen_spans == "22:100032,100055:200065" and found[8].n_common == 0
    empty = spark.createDataFrame([], "pair_id long, side string, turn int, role string, text string")
    assert chat.format_preferences(empty).count() == 0


def test_every_conversation_with_a_reply_gives_a_pair(spark):
    rows = [
        (2, 0, "user", "q"), (2, 1, "assistant", "a2"), (2, 2, "user", "bye"), (3, 0, None, None), (3, 1, "assistant", None),
        (4, 0, "user", "alone"), (4, 1, "assistant", "a4"), (6, 0, "user", "no reply"), (7, 5, "assistant", "z"), (7, 5, "assistant", "a7"),
        (None, 0, "assistant", "x"), (8, None, "assistant", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("before", F.lit("mine"))
    got = {r.pair_id: r for r in chat.format_pairs(chat.swapped_replies(df)).collect()}
    said = lambda t: f"<|im_start|>assistant\n{t}<|im_end|>\n"
    assert {i: (r.chosen, r.rejected) for i, r in got.items()} == {2: (said("a2"), said("")), 3: (said(""), said("a2")), 4: (said("a4"), ""), 7: (said("a7"), "")}
    assert got[4].n_common == 1 and got[7].n_common == 0 and got[7].prompt == ""
    assert chat.format_pairs(chat.swapped_replies(df.where("false"))).count() == 0


PAGES = [
    (1, "https://www.Example.com:80/a?x=1#top", "<p>é</p>"), (2, "http://example.com/b", "<p>é</p>"), (3, None, None), (4, "http://[bad", ""),
    (5, "http://b.example.org", "x" * 300000), (None, "http://b.example.org", "none"), (6, "http://example.com/b", "<p>é</p>"), (7, "http://example.com/c d", "<p>z</p>"),
]


def test_archive_roundtrip_and_search(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archive = warc.write_archive(pages.repartition(3))
    captures = warc.look_up(archive, pages)
    got = {r.page_id: r for r in warc.read_records(archive, captures).collect()}
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: -1 if p[0] is None else p[0]):
        first.setdefault(h or "", i)
    assert set(got) == {p[0] for p in PAGES}
    for i, url, h in PAGES:
        body, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), url)
        if first[h or ""] == i:
            assert r.record_type == "response" and r.refers_to is None and r.payload == body
        else:
            assert r.record_type == "revisit" and r.refers_to == first[h or ""]
    absent = spark.createDataFrame([(99, "http://example.com/b"), (1, "http://zz.example")], "page_id long, url string")
    assert warc.look_up(archive, absent).count() == 0
    assert warc.surt("https://www.Example.com:80/a?x=1#top") == "com,example,www)/a?x=1"


def test_all_captures_of_a_key_are_found(spark, monkeypatch):
    """One page id and url with many payloads, over several blocks and index files; extra columns; repeated rows."""
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(1, "http://a.example/", f"v{k}") for k in range(40)] + [(None, "http://a.example/", f"n{k}") for k in range(9)] + [(2, "http://a.example/", "v0")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as sha", "'mine' as `my.key`")
    archive = warc.write_archive(pages.repartition(4))
    got = Counter((r.page_id, r.record_type, r.payload_digest) for r in warc.read_records(archive, warc.look_up(archive, pages.union(pages))).collect())
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert got == Counter((i, "revisit" if i == 2 else "response", sha(h)) for i, _, h in rows)


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    assert archive.files.count() == 0 and warc.read_records(archive, warc.look_up(archive, pages)).count() == 0


def test_registered_archive(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    first = {}
    for r in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    want = Counter()
    for r in pages:
        body, lead = (r.html or "").encode(), first[r.html or ""]
        again = lead != r.page_id
        want[r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", lead if again else None] += 1
    assert Counter(map(tuple, queries.op8_warc_index(spark, sf).collect())) == want


@pytest.fixture
def all_partitions(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_tiny_source_is_spread_and_a_mad_rate_is_refused(spark, all_partitions):
    rows = [(1, "x", "tiny"), *[(i, "y" * 500, "big") for i in range(2, 42)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.replicate(df, {"tiny": 1.0, "big": 1.0}, seed=2)
    got = out.where("doc_id = 1").select("copy", "n_copies").collect()
    rate = 0.5 * 20001
    u = [int(hashlib.md5(f"2|count|1|{j}".encode()).hexdigest()[:13], 16) / 16**13 for j in range(1, math.ceil(rate / 32) + 1)]
    assert sorted(r.copy for r in got) == list(range(1, inverse(rate, u) + 1)) and {r.n_copies for r in got} == {len(got)}
    assert out.where("doc_id = 1").selectExpr("spark_partition_id() as p").distinct().count() > 1
    with pytest.raises(Exception, match="would be repeated"):
        mixing.replicate(df.withColumn("text", F.when(F.col("doc_id") == 1, F.col("text")).otherwise(F.repeat("text", F.lit(2000)))), {"tiny": 1.0, "big": 1.0}).collect()


def test_rows_without_ids_are_spread(spark, all_partitions):
    df = spark.createDataFrame([(None, f"text {i}", "a") for i in range(200)], "doc_id long, text string, source string")
    out = mixing.replicate(df, {"a": 1.0})
    assert out.selectExpr("spark_partition_id() as p").distinct().count() > 1
