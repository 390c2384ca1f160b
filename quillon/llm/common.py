"""Helpers shared by the operators: bounded Arrow chunks, ragged gathers, tables between steps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that one Python step holds at once, whatever size Spark's Arrow batches have.
CHUNK_BYTES = 4 << 20
#: Session settings that the operators want, where the session has none of its own: smaller batches on their way to
#: Python, and no shuffle files kept of what has been written.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
DEFAULTS = (None, "10000", "false", "67108864", "64MB")

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def tuned(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS; what its user has set stays."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) in DEFAULTS:
            spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, as in tests, may do without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillon-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet in the shared folder, smaller than a checkpoint of rows that hold text, in a folder for each value of
    the columns `by`; see discard()."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored() frames that nothing reads any more."""
    for df in frames:
        if path := _paths.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Stores frames as long as its block lasts. (Checkpoints would do, but they carry the constraints of all plans before
    them, which double with each round of an iteration.)"""

    def __enter__(self):
        self.frames: list[DataFrame] = []
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(stored(df))
        return self.frames[-1]

    def __exit__(self, *_):
        discard(*self.frames)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers give back their memory at the end of each task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Returns free memory of Python, Arrow and the C library to the system: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def chunks(batches, text: str, limit: int = CHUNK_BYTES):
    """Slices of the batches with at most `limit` bytes of text, or one row if that is longer."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return out + np.repeat(starts.astype(np.int64) - before, lengths)


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array without nulls."""
    array = array.cast(pa.binary())
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return data, offsets


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def added(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with more columns behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
