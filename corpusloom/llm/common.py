"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents' columns in their order; operators look columns up by name and ignore others.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts the same way.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; a folder of this machine only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
    sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: survives lost executors and cuts lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_keys(text: str = "text") -> list[Column]:
    """Two independently seeded 64-bit hashes of a text: a 128-bit key for exact copies.  A null text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("_t1"), F.xxhash64(F.lit(7), whole).alias("_t2")]


def column_values(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def group_slices(keys) -> Iterator[tuple[int, int]]:
    """(from, to) of the runs of equal neighbours in a numpy array."""
    import numpy as np

    if len(keys):
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


#: Paths of the tables that stash() has written and nothing has deleted.
_stashed: set[str] = set()


def stash(df: DataFrame) -> DataFrame:
    """Write a table between phases as Parquet in the shared checkpoint folder and read it back: compact, and it cuts lineage.

    Results are lazy and may read stashed tables until they are written; whoever has written them calls sweep().
    """
    import uuid

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    where = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    back = spark.read.schema(df.schema).parquet(where)
    back._stash = where
    _stashed.add(where)
    return back


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _stashed.discard(where)


def discard(*stashed: DataFrame) -> None:
    """Delete stashed tables that nothing will read again."""
    for df in stashed:
        _delete(df.sparkSession, df._stash)


def sweep(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete every stashed table but those of keep: once a result is written, nothing reads what led to it."""
    for where in _stashed - {df._stash for df in keep}:
        _delete(spark, where)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release(spark: SparkSession) -> None:
    """Shuffle files of finished phases go when the driver notices that nothing needs them; ask it to look now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel to Python: keep Arrow batches to so many rows where the session still has the default of 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trimmed(run):
    """A batch function that hands freed memory back when its task ends: workers outlive tasks, and memory is others' too."""
    from functools import wraps

    @wraps(run)
    def lean(batches):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return lean
