"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null texts as empty ones; other columns, whatever their names, stay out of the way."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def per_batch(df: DataFrame, work: Callable[[list[dict]], dict] | Callable, schema: str) -> DataFrame:
    """Applies ``work`` to the columns (dict of Python lists) of each Arrow batch; it returns a dict of lists or Arrow arrays.

    Spark fills a batch up to the bytes of ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB); here it is worked
    through in parts of a few MB, so a task holds no more than that and one row, however long the texts.
    """
    spark = df.sparkSession
    target = [(f.name, f.dataType) for f in _parsed(spark, schema).fields]
    from pyspark.sql.pandas.types import to_arrow_type

    fields = pa.schema([(n, to_arrow_type(t)) for n, t in target])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(batch.num_rows, (4 << 20) * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                got = work(part.to_pydict())
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def _parsed(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def kept_in_worker(key: tuple, make: Callable):
    """A value that a Python worker makes once and keeps between its tasks; a handful of such values at most."""
    store = sys.__dict__.setdefault("_strataloom_kept", {})
    if key not in store:
        if len(store) > 16:
            store.clear()
        store[key] = make()
    return store[key]


def trimmed() -> None:
    """Gives what a worker has freed back to the system, where the C library can do that; workers share an executor's memory with its JVM."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
