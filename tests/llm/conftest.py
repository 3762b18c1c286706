import pytest

LONG = "lorem ipsum dolor sit amet " * 6000

#: Edge rows for every document operator: nulls, empty, blank, long, repeated rows, ties; clashing extra columns.
EDGES = [
    (1, "Hello World, hello again and again", "en", "a"),
    (2, "hello world, HELLO again and again", "en", "a"),
    (2, "hello world, HELLO again and again", "en", "a"),
    (3, None, None, None),
    (4, "", "en", None),
    (5, " \n\t ", "en", "b"),
    (None, "null id text", "en", "b"),
    (None, None, "en", "b"),
    (6, LONG, "de", "b"),
    (7, LONG + "x", "de", "b"),
    (8, LONG, "de", "b"),
    (9, "ÄÖÜ straße", "de", "c"),
    (10, "äöü straße", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA).withColumn("n_chars", F.length("text"))
    for name in ("bytes", "rid", "cls", "row", "rest", "key", "bucket", "copy", "kept", "class_id", "node", "digit", "size", "shard"):
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("false")
