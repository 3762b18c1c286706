"""mapInArrow with batches of bounded size.

Spark's own bound is 64 MB a batch; a task then holds that in the JVM and in its Python worker, several times over while
a batch is built and copied, and two tasks an executor already need hundreds of MB. One longer row is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "8m"


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow``; where the session has no bound of its own, BATCH_BYTES becomes its bound (plans read it when they run)."""
    conf = df.sparkSession.conf
    if conf.get(BOUND, None) is None:
        conf.set(BOUND, BATCH_BYTES)
    return df.mapInArrow(function, schema)
