"""Helpers that the operators share: inputs, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows (or elements of arrays) of some 50 bytes that a table may have to be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of the context, else of ``spark.checkpoint.dir``.

    Only a local test session without the setting gets a temporary folder; a cluster
    without it is an error, as executors could not see one another's files.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="docloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for the steps that are run here."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the frames made here go when the job that materialises them has ended; else they stay on the executors' disks for the session."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of ``spark.checkpoint.dir`` and cut its lineage."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read again."""
    return Scratch(df.sparkSession).table(df)


class Scratch:
    """Tables in the shared folder that a job writes, reads and drops when their readers are done.

    A table is compressed columns, so it is smaller than a checkpoint of the same rows,
    and a reader takes only the columns that it needs.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, shared_folder(spark), {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/table-{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.select("*").write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch; frames that are derived from one are ignored."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for t in tables:
            if (found := self.paths.pop(id(t), None)) is not None:
                at = jvm.org.apache.hadoop.fs.Path(found[1])
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches, column: str, max_bytes: int = 4 << 20):
    """Cut Arrow record batches so that ``column`` holds at most ``max_bytes`` in each (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(array, max_bytes: int = 1 << 20):
    """Lists of the strings of an Arrow array, in order, of ``max_bytes`` at most together (or one string); null is empty."""
    import pyarrow as pa

    for part in slices([pa.RecordBatch.from_arrays([array], names=["x"])], "x", max_bytes):
        yield [x or "" for x in part.column(0).to_pylist()]


def mapped(array, kind, work, max_bytes: int = 4 << 20):
    """An Arrow array of ``kind`` with ``work`` of each value of a binary or string array (null stays null), made a few MB at a time."""
    import pyarrow as pa

    parts = [pa.array([None if x is None else work(x) for x in part.column(0).to_pylist()], kind) for part in slices([pa.RecordBatch.from_arrays([array], names=["x"])], "x", max_bytes)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
