from collections import Counter

import pytest

import corpus_pipeline as cp
from panelwright.llm import mixing

from .test_exact_sharding import brute
from .test_near import classes


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage returned, on the smallest corpus."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, step in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        step(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [spark.read.parquet(f"{sf}/documents.parquet"), *out]


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1]) and stages[-1].columns == ["doc_id", "ids", "decoded"]


def test_quality_stage_keeps_clean_documents(spark, sf, stages):
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(stages[0], "doc_id").select("doc_id", "quality").collect()
    left = {i for i, _ in texts(stages[1])}
    good, bad = ([r.doc_id in left for r in labels if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(len(bad), 1) < 0.2


def test_exact_stage(stages):
    assert sorted(i for i, _ in texts(stages[2])) == sorted(max(ids) for ids in brute(texts(stages[1])).values())


def test_near_stage(stages):
    found = classes(texts(stages[2]))
    assert sorted(i for i, _ in texts(stages[3])) == sorted(i for i, c in found.items() if i == c)


def test_mix_and_encode_stages(stages):
    before, after = dict(texts(stages[3])), texts(stages[4])
    assert all(before[i] == t for i, t in after) and stages[5].count() == len(after)
    assert Counter(r.doc_id for r in stages[5].collect()) == Counter(i for i, _ in after)
    again = mixing.replicate(stages[3], cp.MIXTURE, seed=7, marks=False)
    assert Counter(i for i, _ in texts(again)) == Counter(i for i, _ in after)


def test_run_is_the_stages(spark, sf, stages):
    assert Counter((r.doc_id, r.decoded) for r in cp.run(spark, sf).collect()) == Counter((r.doc_id, r.decoded) for r in stages[5].collect())
