import functools
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from panelwright.llm import bpe, cotrain, pii, queries, repetition
from panelwright.llm import textgrid as tg

public_tokenizers = pytest.importorskip("public_tokenizers")
BLANK = r"[^\x20\x09-\x0D]+"


def rules(text):
    text = text or ""
    words = re.findall(BLANK, text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_repetition_equals_brute_force(spark, sf, edges):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), edges):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in repetition.repetition_rules(df).collect())
        assert got == Counter((r.doc_id, *rules(r.text)) for r in df.select("doc_id", "text").collect())


def test_repetition_keeps_clean_texts(spark, sf, nothing):
    out = queries.op10_repetition_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert out.where("kept").count() / out.count() > 0.99
    assert repetition.repetition_rules(nothing).count() == 0


def test_tokens_equal_the_library(spark, sf, edges, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    odd = [(20, "ΑΣ Σας İstanbul ſ<|endoftext|>it'll"), (21, "é 中文 \U0001f600!?\x1c \x85 a"), (22, "aeh" * 3000), (23, "<|startoftext|><|endoftext|>")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text")).union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in bpe.encode_documents(docs, path).collect())
    codes = [(str(r.doc_id), want.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert got == sorted((i, ids, want.decode(ids, skip_special_tokens=False)) for i, ids in codes)
    assert bpe.encode_documents(nothing, path).count() == 0


def test_long_merging_equals_short_merging():
    codec = bpe.codec_of(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for word in ("onhaonanthetion" * 3, "zzzzqqqq", "aaaaaaaaaaaaaaa"):
        ids = [codec.vocab[c] for c in codec.symbols(word)]
        assert codec.merged(ids[:48]) == codec._merged_long(ids[:48])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


@functools.cache
def matched(pattern, text):
    return list(re.finditer(pattern, text))


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in matched(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


HARD = [
    (30, "a@b.c.d@e.f x.y@z.q_d@e.f .@a.b a@b a@b..c"),
    (31, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3"),
    (32, "4111 1111 1111 1111-x 4111-1111-1111-1111 5- 4111111111111111 1 2 3 4 5 6 7 8 9 0 1 2 3 4"),
    (33, "+1 (269) 555-3296 4524132264652876 +33 1 23 45 67 89, +1+12 345 678 901 (+49) 30 1234567"),
    (34, "é+1 (988) 555-2485 \U0001f600 bob.42@mail8.example.com. 10.0.0.1:80"),
    (35, "7" * 20000 + " " + "a" * 20000 + "@"),
]


LOCAL = "A-Za-z0-9._%+-"
AT, DOT, POINT = r"(?: ?[\[({]at[\])}] ?| at )", r"(?:\.| ?[\[({]dot[\])}] ?| dot )", r"(?:\.|\[\.\]|\(\.\)| ?[\[(]dot[\])] ?)"
LOOSE = {
    "email": rf"(?<![{LOCAL}])[A-Za-z0-9][{LOCAL}]{{0,63}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})+",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:{POINT}[0-9]{{1,3}}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}([ ./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([ ./_-])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
}


def fits(kind, v, loose=False):
    digits = re.sub("[^0-9]", "", v)
    if kind == "email":
        return not loose or bool(re.fullmatch(r"[^@]{1,64}@[^@]{1,250}[.][A-Za-z]{2,}", v))
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in v.split("."))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def plain(kind, v):
    if kind == "email":
        return re.sub(DOT, ".", re.sub(AT, "@", v))
    return re.sub(POINT, ".", v) if kind == "ip" else v


def votes(kind, v, before, after):
    """What the five labelers say of a candidate."""
    has = lambda pattern, of: bool(regex.search(pattern, of, regex.ASCII))
    say = lambda yes, no: 1 if yes else -1 if no else 0
    clear, digits = plain(kind, v), re.sub("[^0-9]", "", v)
    form = {
        "email": has(r"^[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}$", clear) and " at " not in v,
        "ip": has(r"^(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}$", clear),
        "card": has(r"^([0-9]{4}([ -]?)[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{12,19})$", v),
        "phone": has(r"^([+]|00)[0-9]{1,3}[ .-]?[(]?[0-9]{1,4}[)]?([ .-]?[0-9]{2,4}){2,4}$|^[(][0-9]{2,4}[)]", v),
    }[kind]
    known = {
        "email": lambda: say(has(rf"[.]({pii.DOMAINS})$", clear.lower()), True),
        "ip": lambda: say(not has(f"^({pii.RESERVED})", clear), True),
        "card": lambda: say(has(f"^({pii.ISSUERS})", v), True),
        "phone": lambda: say(has(r"^([+]|00)", v) and has(f"^({pii.DIALLING})", re.sub("^00", "", digits)), has(r"^[+]0|^[0-9(]", v)),
    }[kind]()
    near = f"{before} {after}".lower()
    yes, no = (bool(regex.search(rf"(^|[^\p{{L}}])({cue})(?!\p{{L}})", near)) for cue in pii.CUES[kind])
    odd = has(r"[0-9=_/\\][^\s]*\s*$", before) or has(r"^\s*[^\s]*[0-9=_/\\]", after)
    free = has(r"(^|[\s(<\[\"':;,|\x01])$", before) and has(r"^($|[\s)>\]\"':;,.!?|\x01])", after)
    stuck = has(r"[0-9A-Za-z=/_.-]$", before) or has(r"^([0-9A-Za-z=/_]|[.-][0-9A-Za-z])", after)
    return [say(form, True), known, say(yes and not no, no and not yes), -1 if odd else 1, say(free, stuck)]


def supervised(rows):
    """All spans of (doc_id, text) rows, candidate by candidate."""
    base, more, counts = {}, {}, Counter()
    for n, (_, text) in enumerate(rows):
        text = rest = text or ""
        base[n], more[n] = [], []
        for kind, pattern in PATTERNS.items():
            end = 0
            found = [m for m in matched(pattern, text) if kind != "card" or sum(c.isdigit() for c in m[0]) > 11]
            for m, after in zip(found, [*(x.start() for x in found[1:]), len(text)], strict=False):
                counts[kind, fits(kind, m[0]), tuple(votes(kind, m[0], text[max(end, m.start() - 48) : m.start()], text[m.end() : min(after, m.end() + 32)]))] += 1
                end = m.end()
                if fits(kind, m[0]):
                    base[n].append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
            for m in matched(pattern, rest):
                if fits(kind, m[0]):
                    rest = rest[: m.start()] + "\x01" * len(m[0]) + rest[m.end() :]
        for kind, pattern in LOOSE.items():
            end = 0
            found = list(re.finditer(pattern, rest))
            for m, after in zip(found, [*(x.start() for x in found[1:]), len(rest)], strict=False):
                passed = fits(kind, plain(kind, m[0]), loose=True)
                said = votes(kind, m[0], rest[max(end, m.start() - 48) : m.start()], rest[m.end() : min(after, m.end() + 32)])
                counts[kind, passed, tuple(said)] += 1
                end = m.end()
                if passed:
                    more[n].append(((m.start(), list(PATTERNS).index(kind), m.end(), kind), said))
    table = sorted((kind, passed, list(v), m) for (kind, passed, v), m in counts.items())
    weights = pii.train(table, pii.estimate(table))
    score = lambda kind, said: weights.get(kind, 0) + sum(weights.get(f"{kind} {name}{'+' if v > 0 else '-'}", 0) for name, v in zip(pii.VOTES, said, strict=True) if v)
    spans = [sorted(base[n] + [span for span, said in more[n] if score(span[3], said) >= 0]) for n in range(len(rows))]
    return [tuple(sorted(base[n])) for n in range(len(rows))], [tuple(x) for x in spans]


HARD += [
    (36, "write to jane.doe (at) mail [dot] example [dot] com or see 10[.]20[.]30[.]40, card 4111/1111/1111/1111; call (212) 555-0199 or 212-555-0199"),
    (37, "they look at that.Then 4111111111111112 and version 1.2.3.400 x4111.1111.1111.1111y"),
    (38, "a@b.co " * 700 + "é 4111 1111 1111 1112 (4111111111111111)\n+44 20 7946 0958"),
]


def span_rows(found):
    key = lambda r: tuple(tuple(x) for x in r)
    return Counter((str(r.doc_id), key(r.base), key(r.spans)) for r in found.collect())


def test_spans_equal_brute_force(spark, sf, edges, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text")).union(spark.createDataFrame(HARD, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base, spans = supervised(rows)
    assert [list(b) for b in base] == [base_spans(t) for _, t in rows]
    assert span_rows(pii.private_spans(docs)) == Counter((str(i), b, s) for (i, _), b, s in zip(rows, base, spans, strict=True))
    assert pii.private_spans(nothing).count() == 0


def test_spans_of_a_text_do_not_depend_on_the_corpus():
    """What the base rules lose is found with either corpus, and what fails its check with none."""
    import duckdb

    lists = []
    for scale in ("0.001", "0.01", "0.1"):
        rows = duckdb.sql(f"select doc_id, text from '/root/testdata/sf{scale}/documents.parquet' order by doc_id").fetchall()
        lists.append(supervised(HARD + rows)[1][: len(HARD)])
    assert lists[0] == lists[1] == lists[2]
    added = {i: [(x[3], x[0], x[2]) for x in s] for (i, _), s in zip(HARD, lists[0], strict=True)}
    assert ("phone", 0, 17) in added[33] and ("card", 18, 34) in added[33]
    assert {kind for kind, _, _ in added[36]} == set(pii.KINDS) and not added[37]
    assert all(luhn(re.sub("[^0-9]", "", t[a:b])) for (_, t), s in zip(HARD, lists[0], strict=True) for a, _, b, kind in s if kind == "card")


def test_registered_spans(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base, spans = supervised(rows)
    show = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
    got = {r.doc_id: r for r in queries.op9_weak_pii(spark, sf).collect()}
    for (i, _), b, s in zip(rows, base, spans, strict=True):
        counts = tuple(sum(x[3] == k for x in b) for k in pii.KINDS)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == counts
        assert (got[i].base_sha256, got[i].spans) == (hashlib.sha256(show(b).encode()).hexdigest(), show(s))


def test_the_model_sides_with_the_better_labelers():
    good, bad = [1, 1, 0, 1, 1], [-1, -1, -1, -1, 0]
    counts = [("phone", True, good, 90), ("phone", True, bad, 40), ("phone", False, good, 30), ("ip", True, [1, 1, 1, 1, 1], 50)]
    post = pii.estimate(counts)
    assert post[0] > 0.9 and post[1] < 0.1 and post[2] == 0 and post[3] > 0.9
    weights = pii.train(counts, post)
    assert all(w >= 0 for f, w in weights.items() if f.endswith("+")) and all(w <= 0 for f, w in weights.items() if f.endswith("-"))
    assert pii.train([], []) == {} and pii.train(counts[2:3], [0.0]) == {}


def auc(score, y):
    good, bad = [s for s, q in zip(score, y, strict=True) if q], [s for s, q in zip(score, y, strict=True) if not q]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)


def test_quality_on_held_out_labels(spark, sf):
    """Each view and both together, on labels that were not fitted."""
    folder = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = cotrain.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = labels.where("doc_id % 2 = 1")
    out = cotrain.with_scores(docs, model).join(rest, "doc_id")
    for quality in (0, 1):
        rows = out.where(f"quality = {quality}")
        kept = rows.where("quality_kept").count() / rows.count()
        assert kept > 0.98 if quality else kept < 0.1
    rows = docs.join(rest, "doc_id").select("text", "source", "lang", "n_chars", "quality").toArrow().combine_chunks().to_batches()[0]
    text, meta = model.logits(rows)
    y = rows.column("quality").to_pylist()
    assert auc(text, y) > 0.98 and auc(meta, y) > 0.5 and auc(model.combined(text, meta), y) > 0.98


def grams(text):
    """A text's words, word pairs and character trigrams in UTF-8, letters in lower case."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    return [words, list(zip(words, words[1:], strict=False)), [low[i : i + 3] for i in range(len(low) - 2)]]


def test_text_view_equals_brute_force(edges):
    """Features by plain counting, with buckets so many that none holds two different features."""
    texts = [r.text or "" for r in edges.select("text").collect()] + ["a b a b", "b c! b c!", "x", "", "ab", "A B"]
    y = np.array([i % 2 for i in range(len(texts))], float)
    data, offs = tg.flat(pa.array(texts, pa.string()))
    got = cotrain.grams(data, offs)
    for k in range(3):
        name = {}  # bucket of each feature
        for i, text in enumerate(texts):
            mine = got[k][0][got[k][1][i] : got[k][1][i + 1]].tolist()
            assert len(mine) == len(grams(text)[k])
            for gram, bucket in zip(grams(text)[k], mine, strict=True):
                assert name.setdefault(gram, bucket) == bucket
    buckets, counts, first = cotrain.sparse(data, offs)
    sample = cotrain.Sample(cotrain.shares(data, offs), buckets, counts, first, np.zeros((len(texts), 1)))
    settings = cotrain.Settings()
    view = cotrain.TextView.fit(sample, y, settings)
    assert np.allclose(view.rows(sample), view.rows_of(data, offs))
    seen = [Counter(), Counter()]
    for i in range(len(texts)):
        seen[int(y[i])].update(set(buckets[first[i] : first[i + 1]].tolist()))
    total = [(y == q).sum() + settings.smooth for q in (0, 1)]
    mean = np.mean([seen[0][b] + seen[1][b] + 1 for b in range(sum(cotrain.SIZES))])
    for b in buckets.tolist():
        extra = settings.smooth * (seen[0][b] + seen[1][b] + 1) / mean
        assert np.isclose(view.odds[b], math.log((seen[1][b] + extra) / total[1]) - math.log((seen[0][b] + extra) / total[0]))


def test_handed_over_are_the_most_confident_of_all(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").repartition(3), spark.read.parquet(f"{sf}/labels.parquet")
    settings = cotrain.Settings(rounds=0, handed=7, sure=0.6)
    model = cotrain.fit(docs, labels, settings)
    none = labels.select("doc_id").where("false")
    rows = docs.select("text", "source", "lang", "n_chars", "doc_id").toArrow().combine_chunks().to_batches()[0]
    for giver, logit in enumerate(model.logits(rows)):
        for label, sign in ((1, 1), (0, -1)):
            sure = sorted(((sign * s, t, m) for s, t, m in zip(logit, rows.column("text").to_pylist(), rows.column("source").to_pylist(), strict=True) if sign * s >= math.log(1.5)), key=lambda x: -x[0])
            best = [s for k, (s, t, m) in enumerate(sure) if all((t, m) != x[1:] for x in sure[:k])][:7]
            found = cotrain._confident(docs, model, settings, "doc_id", "text", none).where(f"giver = {giver} and label = {label}").collect()
            assert np.allclose(sorted({r.key: r.logit for r in found}.values(), reverse=True)[: len(best)], best)
            assert len(found) <= 3 * 7


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (5, None), (99, 0)], "doc_id long, quality int")
    model = cotrain.fit(edges, labels)
    out = cotrain.with_scores(edges, model)
    assert out.count() == edges.count() and out.columns[: len(edges.columns)] == edges.columns
    assert cotrain.fit(edges, labels.where("quality = 1")) is None and cotrain.fit(nothing, labels) is None
    assert cotrain.with_scores(edges, None).where("not quality_kept").count() == 0
    assert cotrain.with_scores(nothing, model).count() == 0
    both = labels.union(labels.selectExpr("doc_id", "1 - quality"))
    assert cotrain.fit(edges, both) is None  # of documents with both labels none counts
    first, again = (cotrain.with_scores(edges, cotrain.fit(df, labels)).select("doc_id", "quality_score").collect() for df in (edges, edges.repartition(5).union(edges)))
    assert sorted(map(str, first)) == sorted(map(str, again))  # repeated rows change nothing
