"""Helpers shared by the training-data operators: reading, keys, cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: `[^\x20\x09-\x0D]+` splits exactly where bytes.split() does.
SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only in local mode, as in tests, a temporary folder is made and set where
    none is named.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidecast-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Lets Spark delete a write's shuffle files when it ends, as nothing runs it again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: what follows depends on files
    that survive the loss of an executor, and is planned from their real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidecast/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def discard(*written: DataFrame) -> None:
    """Delete what cut() wrote, once all that reads it has been written too."""
    for df in written:
        delete(df.sparkSession, df.cut_path)


def plus(df: DataFrame, **kinds: str) -> T.StructType:
    """The columns of df and further ones."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        schema.add(name, T._parse_datatype_string(kind))
    return schema


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches whose texts have about `most` bytes together, so
    that what Python makes of them follows the longest text and not the row count.
    Texts come whole, as UTF-8 (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            before = ends[begin - 1] if begin else 0
            stop = min(len(ends), int(np.searchsorted(ends, before + most)) + 1)
            yield batch.slice(begin, stop - begin), [t or b"" for t in column.slice(begin, stop - begin).cast(pa.large_binary()).to_pylist()]
            begin = stop


def letters(text: bytes) -> bool:
    """Whether any Unicode letter occurs (signs such as ² or ① are none)."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def drawn(rate: Column, *key: Column | str) -> Column:
    """Whether a row is in a sample of that share, by a hash of its key; shares may be as small as 2**-52."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) < rate * float(1 << 53)
