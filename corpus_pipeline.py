"""The corpus pipeline: quality, exact and near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it and reads it back as
the next one's docs. All but the last return the columns of ``documents``. Stages change the
number of rows: rejected documents go, one row of each group of copies stays, and mixing repeats
or leaves out documents to bring the sources to equal shares of bytes. The same document may so
be encoded several times, a row each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import bpe, cotrain, exact, mixing, near
from panelwright.llm.queries import MIXTURE
from panelwright.llm.staging import Staging


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the co-trained quality classifier rejects."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.with_scores(docs, model, only_kept=True).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact.drop_exact_copies(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the row with the least id."""
    return near.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares, in random order."""
    return mixing.replicate(docs, MIXTURE, seed=7, marks=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the ids decoded again."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("exact", keep_distinct), ("near", keep_unlike), ("mix", mix), ("encode", encode)]

#: The classifier's and the near-copy stage's decisions have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written before the next reads it."""
    stage = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.put(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
