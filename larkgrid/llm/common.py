"""Shared helpers: the cluster's shared folder, written tables that cut lineage, and hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own, in local mode only: on a cluster it would not be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return root or f"file://{tempfile.gettempdir()}/larkgrid-shared"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which ends its lineage there.

    Unlike a local checkpoint the files outlive any executor. `discard` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larkgrid_path = path
    _written.append(out)
    return out


#: Tables written in this process that have not been deleted.
_written: list[DataFrame] = []


def written() -> int:
    return len(_written)


def discard_since(mark: int, keep: DataFrame) -> None:
    """Deletes all tables written since `written()` gave mark, but `keep`: what a step needed that has been written in the end."""
    discard(*(t for t in _written[mark:] if t is not keep))


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing lazy refers to any more."""
    for t in tables:
        path = getattr(t, "_larkgrid_path", None)
        if path:
            jvm = t.sparkSession._jvm
            conf = t.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
            _written[:] = [x for x in _written if x._larkgrid_path != path]


#: Bytes that may be broadcast.
BROADCAST_BYTES = 32 << 20


def light(rows: DataFrame, size: int) -> DataFrame:
    """For a join's smaller side of `size` bytes: broadcast if that is little, else left to a shuffle, which builds its table from it."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows.hint("shuffle_hash")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by number, which no column of ours can clash with; `toDF` with the old names undoes it."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def spill_dir() -> str:
    """A folder for one task's own spill files: one of Spark's local scratch folders, as its shuffle uses.

    Nothing in it is read by any other task, and a task that is run again starts it afresh.
    """
    roots = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")
    return tempfile.mkdtemp(prefix="larkgrid-spill-", dir=roots[os.getpid() % len(roots)])


def split_mod4(doc_id="doc_id"):
    """crc32 of doc_id as text, mod 4; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


#: What a Python worker remembers from task to task, by the operator's name: how to forget it.
remembered: dict[str, Callable[[], None]] = {}


def forget(own: str | None = None) -> None:
    """Drops what operators other than `own` remember in this worker, which serves all of them in turn."""
    for name, drop in remembered.items():
        if name != own:
            drop()


def give_back() -> None:
    """Returns free memory of this process to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, in a worker that holds no more than `run` needs: idle workers stay, and count as their executor's memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(own)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def text_chunks(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `size` bytes of text, so that Python objects are made for few rows at a time."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(b):
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + size, side="right")))
            yield b.slice(start, end - start)
            start = end
