"""Helpers shared by the operators: shared folders, row shaping, vocabulary files."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import is_local

#: Bytes of text that one task handles.
TASK_BYTES = 24 << 20
#: Rows of a result batch that leave a Python worker together.
BATCH_ROWS = 4096
#: Bytes of an Arrow batch, and rows that the Parquet reader decodes together.
BATCH_BYTES, READ_ROWS = 2 << 20, 512
#: Pairs of an id and a hash that are broadcast to rows (16 bytes each).
BROADCAST_KEYS = 1_000_000
#: Bytes of text that a Python function takes from one batch at a time.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where a local session names none. On a cluster it has to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='trisearch-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/trisearch-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where df has such a column, in whatever case."""
    have, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        found.append(name)
    return found


def same_row(docs: DataFrame, keys: DataFrame, text_hash: Column) -> tuple[DataFrame, Column]:
    """keys (doc_id, text_hash), a stored table, under names that docs lacks, broadcast if they are
    few, so that texts are not shuffled; and the condition that joins docs with them."""
    a, b = fresh(docs, "key_id", "key_hash")
    keys = keys.toDF(a, b)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (text_hash == F.col(b))


def small_batches(spark: SparkSession) -> None:
    """Batches of the session, of Arrow and of the Parquet reader, hold a few MB of
    long texts, so that those of an executor's tasks do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); a null text is empty, and other columns, whatever
    their names, are left behind."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_of_id(col: Column) -> Column:
    """crc32 of an id written as decimal digits; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def tasks_for(spark: SparkSession, size: int, each: int = TASK_BYTES) -> int:
    """Partitions for size bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def chunks(batch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of an Arrow batch with about limit bytes of the column each, so
    that a batch of very long texts never becomes Python objects at once."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, min(int(np.searchsorted(ends, base + limit, "right")), at + BATCH_ROWS))
        yield batch.slice(at, to - at)
        at = to


def release(collect: bool = True) -> None:
    """Gives memory of dropped objects back to the system; collect: of those in cycles, too."""
    import ctypes
    import gc

    import pyarrow as pa

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


_loaded: dict = {}


def keep_only(keys) -> None:
    """Drops what once() keeps under other keys."""
    if others := _loaded.keys() - set(keys):
        for key in others:
            del _loaded[key]
        release()


def alone(run, *keys):
    """run, a function of batches, as the only one that has memory in its Python worker: before it, what once()
    keeps under other keys goes, since workers live on from one operator to the next; afterwards what run has dropped."""

    def only(batches):
        keep_only(keys)
        try:
            yield from run(batches)
        finally:
            release(collect=False)

    return only


def once(key, make):
    """make(), kept for later tasks of the same Python worker; holds the last few only."""
    if key not in _loaded:
        while len(_loaded) >= 4:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = make()
    return _loaded[key]


def send_file(spark: SparkSession, path: str):
    """A vocabulary file of fixed size (a few MB) as a broadcast of (digest, bytes)."""
    import hashlib

    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))
