"""What the training-data operators share: tables, shared scratch tables, slicing of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlex.functions.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch folders by owner, while one is named.
_owned: dict[str, list[str]] = {}
_owner: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/netlex-{uuid.uuid4().hex}"
    if _owner:
        _owned.setdefault(_owner[-1], []).append(folder)
    return f"{folder}/{name}"


@contextlib.contextmanager
def scratch_of(spark: SparkSession, owner: str):
    """Scratch tables made inside belong to `owner`; those that it made before are deleted first."""
    for folder in _owned.pop(owner, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str, max_bytes: int = 2_000_000):
    """Arrow batches cut by rows so that `column` (string or binary) has about max_bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).tolist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    release()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary() if col.type == pa.string() else pa.large_binary()).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as no column of df has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
