"""Helpers shared by the operations of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch. A batch of long texts must fit into a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and bytes; each operation on texts does so. Smaller bounds stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster can't."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assaykit-checkpoint-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/assaykit/{spark.sparkContext.applicationId}"


@contextmanager
def tidied(spark: SparkSession):
    """Shuffle files of what runs within go when it ends, not when the driver next collects its garbage."""
    was = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, was) if was is not None else spark.conf.unset(TIDY)


def new_table(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_tables(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, by: str | None = None, tidy: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    The rows no longer depend on shuffle files, so a lost executor costs one task and
    not the whole lineage, and what stands above is computed once however often it is used.
    With by, each value of that column has files of its own, so a reader of one value reads no other.
    With tidy, the shuffle files behind df go at once.
    The table stays until forget(df), or clean_up(spark) once results have been read.
    """
    spark = df.sparkSession
    path = new_table(spark, label)
    with tidied(spark) if tidy else nullcontext():
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*dfs: DataFrame) -> None:
    """Delete the tables of cut() results that no DataFrame to come reads."""
    for df in dfs:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application's operations left in the shared folder; their results can't be read afterwards."""
    _delete(spark, _tables(spark))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty. No str objects are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


_HELD: dict = {}


def held(key, make):
    """What a worker keeps from one batch to the next under key, made when it isn't there.

    Workers serve one stage after another, so only the last key's is kept.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list array from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    if offsets[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
