"""What several operators share: word patterns, stored intermediate tables, worker-side tokenizers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelattice.common import stored  # noqa: F401  for the operators

# Java pattern of what lies between words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, records: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """What runs inside sends whole texts to Python by so many rows and bytes a batch: executor and worker each hold a batch of each task."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def release() -> None:
    """Give memory that a batch no longer needs back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def word_count(text: Column | str) -> Column:
    """Number of blank-separated words; null counts as no words."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.array_remove(F.split(t, BLANKS), "")).cast("long")


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text falls on the remainder; a null id hashes as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """Texts of an Arrow column, some rows at a time; a null is an empty text."""
    for at in range(0, len(column), rows):
        for t in column.slice(at, rows).to_pylist():
            yield t if t is not None else ""


def raw_texts(column: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 bytes of each text, some rows at a time; a null is empty."""
    for at in range(0, len(column), rows):
        for t in column.slice(at, rows).cast(pa.large_binary()).to_pylist():
            yield t if t is not None else b""


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets into them; nulls are empty."""
    col = column.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0]:off[-1]] if len(off) else body[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """doc_id, text and y of at most `most` labelled documents outside the held-out fold, chosen by hash of the id: one row an id, with its
    least text and its highest label. The ids are bounded by `most`, so they are broadcast and only their texts are shuffled."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
