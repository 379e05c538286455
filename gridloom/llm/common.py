"""What the operators of this subpackage share: the shared folder, tables in it, word and checksum columns."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words (a regular expression that Java, Python and DuckDB read alike).
SPACES = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; where that is unset on a single machine, a folder of this session is set first."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and no executor owns the rows."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once no plan that is still to run reads them."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.table_path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_mod(doc_id: Any, n: int) -> Any:
    """crc32 of an id's decimal text, modulo n: a Column for a Column, an int for an int. A null id gives 0."""
    if isinstance(doc_id, Column):
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0).cast("long"))
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_arrow(df: DataFrame) -> DataFrame:
    """``df``; its session hands tasks' Python at most 4 MB a batch (or one row) from now on, as all operators here take it.

    The setting is read when a lazy plan runs, so it can't be put back here.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df


def small_batches(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``most`` bytes each, so that a batch of long texts stays small in memory."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
