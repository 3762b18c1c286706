import random
import re
from collections import Counter, defaultdict

import numpy as np

from panelwright.llm import near
from panelwright.llm.components import component_links
from panelwright.llm.staging import Staging


def shingles(text):
    words = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", (text or "").lower())
    seen, out = Counter(), []
    for s in [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else []):
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def similarity(a, b):
    place = {s: i for i, s in enumerate(b)}
    line = [place[s] for s in a if s in place]
    best = []  # quadratic longest increasing run
    for i, x in enumerate(line):
        best.append(1 + max((best[j] for j in range(i) if line[j] < x), default=0))
    m = max(best, default=0)
    return m / (len(a) + len(b) - m) if a or b else 1.0


def classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    grams = {i: shingles(t) for i, t in rows}
    ids = list(grams)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if grams[a] and grams[b] and similarity(grams[a], grams[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=3, groups=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        if g % 2:
            base[5:5] = passage
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = [rng.choice(words)] if rng.random() < 0.7 else []
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_star_of_copies_is_one_class(spark):
    """Copies that are each similar to the original, but mostly not to each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for at in rng.sample(range(5, 190), 4):
            copy[at] = f"n{i}_{at}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {60} and sum(r.kept for r in got) == 1


def test_edges(edges, nothing):
    got = near.near_classes(edges).collect()
    assert len(got) == edges.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.class_size))
    assert by[2] == {(1, 3)} == by[1]  # equal words
    assert by[6] == by[7] == by[8] == {(6, 3)} and by[9] == by[10] == {(9, 2)}  # one letter more at the end of a long text; case
    assert by[3] == by[4] and by[5] != by[4]  # no words: equal texts only
    out = near.drop_near_copies(edges)
    assert out.columns == edges.columns and out.where("rid != 'mine' or class_id != 'mine'").count() == 0
    assert out.count() == sum(r.kept for r in got)
    assert near.near_classes(nothing).count() == 0 and near.drop_near_copies(nothing).count() == 0


def linked(spark, texts):
    """The components of texts that all share one sketch."""
    rows = spark.createDataFrame([(i, t, [7]) for i, t in texts.items()], "rid long, text string, sketch array<long>")
    comp = {r.node: r.comp for r in near.near_links(rows.select("rid", "text"), rows.select("rid", "sketch"), Staging(spark, "t")).collect()}
    return {frozenset(j for j in texts if comp.get(j, j) == comp.get(i, i)) for i in texts}


def test_excerpts_within_their_hubs_are_linked(spark):
    """Two texts similar to each other but to no hub, all of whose k-mers the hubs have."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:190], "other", *words[191:]]), 3: " ".join(words[:150]), 4: " ".join(words[4:150])}
    assert linked(spark, texts) == {frozenset({1, 2}), frozenset({3, 4})}


def test_a_pair_that_draws_many_common_kmers_meets_once(spark, monkeypatch):
    met, meetings = [], near._meetings
    monkeypatch.setattr(near, "_meetings", lambda *a: met.append(meetings(*a).collect()) or meetings(*a))
    words = [f"w{i}" for i in range(1200)]
    other = [f"x{i}" if i % 150 == 75 else w for i, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join([*words[:900], "other", *words[901:]]), 3: " ".join(words[:850]), 4: " ".join(other[4:850]), 5: " ".join(words[9:846])}
    assert linked(spark, texts) == {frozenset({1, 2}), frozenset({3, 4, 5})}
    assert len(met) == 1 and sorted(sorted(p) for p in met[0]) == [[3, 4], [3, 5], [4, 5]]


def test_one_bucket_of_many_families_equals_brute_force(spark):
    rng = random.Random(11)
    long = [f"l{i}" for i in range(500)]
    rows = corpus(seed=4)
    for at in range(0, 400, 40):  # excerpts of one text, two copies of each
        rows += [(len(rows) + i, " ".join([*long[at : at + 90 - 2 * i], f"end{rng.random()}"])) for i in range(2)]
    rows.append((len(rows), " ".join(long)))
    want = classes(rows)
    assert linked(spark, dict(rows)) == {frozenset(j for j in want if want[j] == c) for c in want.values()}


def test_similar_texts_draw_a_common_kmer_whatever_the_hub():
    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 50, 300):
        for _ in range(20):
            a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            b = rng.permutation(a)[: int(np.ceil(0.8 * n))]
            for hub in (a, b, rng.choice(a, n // 2, replace=False), b[:0]):
                assert np.isin(near.drawn(a, hub), near.drawn(b, hub)).any()


def test_order_matters_to_the_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert near.aligned(a, a) and not near.aligned(a, np.concatenate([a[50:], a[:50]]))
    assert near.aligned(a, a[10:]) and not near.aligned(a, a[25:])


def test_components(spark):
    stage = Staging(spark, "t")
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    links = stage.put(spark.createDataFrame(pairs, "u long, v long"), "links")
    got = {r.u: r.v for r in component_links(links, stage, "c").collect()}
    parent = {x: x for p in pairs for x in p}
    for _ in range(len(pairs)):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    group = lambda where: {frozenset(y for y in parent if where(y) == where(x)) for x in parent}
    assert group(lambda x: got.get(x, x)) == group(parent.get)
    assert component_links(links.where("false"), stage, "d").count() == 0
