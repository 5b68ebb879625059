"""The trigram index: versioned Parquet folders behind a pointer.

A version has files (file_id, run, path, mtime, size, content_hash, build), lists (g, run, at), sorted by
range of g so that a lookup skips row groups, grams (g, df) and meta. A run is the files that a build read
together, whose numbers follow each other from run on; a list has the places in one run of the files with
a trigram, so that a posting is two bytes of a row and not a row. A build
writes a new folder and then replaces the file CURRENT, which names the version;
readers see either the old index or the new one, which stays for a while.
"""

from __future__ import annotations

import logging
import os
import threading
import time
import uuid
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexFailure, LockFailure
from ..operators.postings import grams_of, small_batches, together
from .corpus import BROADCAST, LISTED, restricted

log = logging.getLogger("trisearch")

FORMAT = 5
#: Seconds after which a lock that nobody renews is taken for left behind, and between renewals.
LOCK_SECONDS, RENEW_SECONDS = 300, 60
#: Seconds for which replaced versions stay.
KEEP_SECONDS = 3600
#: Limits of file numbers and of trigrams of three bytes; tasks of a build whose numbers are broadcast.
MAX_FILES, MAX_GRAMS, MAX_TASKS = 1 << 40, 1 << 24, 1_000_000
#: Files of an index of which one byte each is broadcast.
MASKED = 1 << 26
#: Bytes of content that one partition of the postings stands for.
PART_BYTES = 256 << 20


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


class Lock:
    """One build at a time: a file that is created only if it isn't there, and whose time its holder renews."""

    def __init__(self, spark: SparkSession, index: str):
        self.spark, self.path, self.done = spark, f"{index}/LOCK", threading.Event()

    def _renew(self):
        while not self.done.wait(RENEW_SECONDS):
            try:
                fs, p = _fs(self.spark, self.path)
                fs.setTimes(p, int(time.time() * 1000), -1)
            except Exception as e:  # the session may end first; the next time may succeed
                log.debug("lock not renewed: %s", e)

    def __enter__(self):
        for _ in range(3):
            try:
                _write_text(self.spark, self.path, f"{os.getpid()} {int(time.time())}", overwrite=False)
                threading.Thread(target=self._renew, daemon=True).start()
                return self
            except Exception as e:  # the file system's own exception, through the gateway
                fs, p = _fs(self.spark, self.path)
                if not fs.exists(p):
                    raise LockFailure(str(e).splitlines()[0]) from e
                if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > LOCK_SECONDS:
                    fs.delete(p, False)
        raise LockFailure(f"another build holds {self.path}")

    def __exit__(self, *_):
        self.done.set()
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, False)


@dataclass
class Index:
    """An opened version."""

    spark: SparkSession
    path: str
    meta: dict

    @property
    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    @property
    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    @property
    def postings(self) -> DataFrame:
        """(g, file_id); filters on g reach the scan of the lists."""
        return self.lists.select("g", "run", F.explode("at").alias("at")).select("g", (F.col("run") + F.col("at")).alias("file_id"))

    @property
    def grams(self) -> DataFrame:
        """(g, df): how many files have a trigram, in the order of g."""
        return self.spark.read.parquet(f"{self.path}/grams")


def current(spark: SparkSession, index: str) -> str | None:
    pointer = f"{index}/CURRENT"
    return _read_text(spark, pointer).strip() if _exists(spark, pointer) else None


def open_index(spark: SparkSession, index: str) -> Index:
    version = current(spark, index)
    if version is None:
        raise IndexFailure(f"no index at {index}")
    path = f"{index}/{version}"
    if not _exists(spark, f"{path}/meta"):
        raise IndexFailure(f"index {path} is not complete")
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["format_version"] != FORMAT:
        raise IndexFailure(f"unsupported index version {meta['format_version']}, expected {FORMAT}")
    return Index(spark, path, meta)


def _openable(spark: SparkSession, index: str) -> Index | None:
    """The current version; None if there is none or it is of another format, so that a build reads everything."""
    try:
        return open_index(spark, index) if current(spark, index) else None
    except IndexFailure as e:
        log.info("index %s is built anew: %s", index, e)
        return None


def _read(files: DataFrame) -> DataFrame:
    """(file_id, run, g, at, path, mtime, size, content_hash) of files (path, mtime, size, content): a row without g for each
    file, and for each run and trigram in it one of run, g and at. Ids count a task's files, its number in the high bits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first, contents in together(batch, 5):
                n, start = len(contents), batch.column(0)[first].as_py()
                some = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(n, start)), pa.nulls(n, pa.int32()), pa.nulls(n, lists), *some.columns[1:5]], names=names)
                which, g = grams_of(contents, ends=True)
                if len(g):
                    begins = np.flatnonzero(np.diff(g, prepend=-1)).astype(np.int32)
                    n = len(begins)
                    at = pa.ListArray.from_arrays(pa.array(np.append(begins, np.int32(len(g)))), pa.array(which.astype(np.int16)))
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(np.full(n, start)), pa.array(g[begins]), at, *(pa.nulls(n, c.type) for c in batch.columns[1:5])], names=names)

    import pyarrow as pa

    lists = pa.list_(pa.int16())
    names = ["file_id", "run", "g", "at", "path", "mtime", "size", "content_hash"]
    small_batches(files.sparkSession)
    content = F.col("content").cast("binary")
    rows = files.select(F.monotonically_increasing_id().alias("file_id"), "path", F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size"), F.md5(content).alias("content_hash"), content.alias("content"))
    return rows.mapInArrow(run, "file_id long, run long, g int, at array<short>, path string, mtime long, size long, content_hash string")


def _left(lists: DataFrame, files: DataFrame, broadcast: bool) -> DataFrame:
    """The lists of an index without the places of files that are not kept; files: all of its files (file_id, run, kept)."""
    there = files.select("run", (F.col("file_id") - F.col("run")).cast("int").alias("place"), "kept", (~F.col("kept")).alias("gone"))
    # Files that earlier builds dropped have left gaps between the places.
    every = there.groupBy("run").agg(F.max("place").alias("last")).select("run", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("place"), F.lit(False).alias("kept"), F.lit(False).alias("gone"))
    places = there.unionByName(every).groupBy("run", "place").agg(F.bool_or("kept").alias("kept"), F.bool_or("gone").alias("gone"))
    runs = places.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("place", "kept")))["kept"].alias("mask"), F.bool_or("kept").alias("some"), F.bool_or("gone").alias("less"))
    masks = runs.where("some").select("run", "mask", "less")
    left = F.when(F.col("less"), F.filter("at", lambda i: F.get(F.col("mask"), i.cast("int")))).otherwise(F.col("at"))
    return lists.join(F.broadcast(masks) if broadcast else masks, "run").select("g", "run", left.alias("at")).where(F.size("at") > 0)


def check_limits(files: int, grams: int) -> None:
    for what, n, most in (("files", files, MAX_FILES), ("distinct trigrams", grams, MAX_GRAMS)):
        if n > most:
            raise IndexFailure(f"{n} {what} are more than an index can hold ({most})")


def build(corpus: DataFrame, index: str, commit_hash: str | None = None, incremental: bool = True, names: DataFrame | None = None, read=None) -> Index:
    """Builds a new version from a corpus and makes it the current one.

    Files whose path, mtime and size are those of the current version keep their
    postings; only the others are read for trigrams, and deleted ones go. Contents are read once and
    never shuffled, unless those of an incremental build's changed files are too many for their names to be broadcast.
    names: (path, mtime, size) of the corpus and maybe of binary files, where no file has to be opened for
    that; read: gives the corpus of a list of paths. meta tells how many files kept their postings and how many were read.
    """
    spark = corpus.sparkSession
    with Lock(spark, index):
        version = f"v-{uuid.uuid4().hex}"
        path = f"{index}/{version}"
        old = _openable(spark, index) if incremental else None
        plain = corpus.select("path", "mtime", "size", "content")
        kept, number, base = None, 1, 0
        if old:
            number = old.meta["build"] + 1
            base = (old.files.agg(F.max("file_id")).first()[0] or 0) + 1
            # All files of the index and of the corpus, in one pass over both: old ones that are there as they were are kept, new ones without an old one are read.
            there = (plain if names is None else names).select(*(F.col(c).alias(f"now_{c}") for c in ("path", "mtime", "size"))).distinct()
            same = [F.col(c) == F.col(f"now_{c}") for c in ("path", "mtime", "size")]
            old.files.join(there, same, "full_outer").withColumn("kept", F.col("file_id").isNotNull() & F.col("now_path").isNotNull()).write.parquet(f"{path}/state")
            state = spark.read.parquet(f"{path}/state")
            mine = state.where("file_id is not null")
            kept = mine.where("kept").select(*old.files.columns)
            changed = state.where("file_id is null").select(F.col("now_path").alias("path")).distinct()
            some = [r["path"] for r in changed.limit(LISTED + 1).collect()]
            few = len(some) <= LISTED
            if not few and changed.count() <= BROADCAST:
                changed = F.broadcast(changed)
            plain = (read(some) if read and few else restricted(plain, some if few else changed)).select("path", "mtime", "size", "content")
        _read(plain).write.parquet(f"{path}/fresh")
        fresh = spark.read.parquet(f"{path}/fresh")
        # Ids without gaps: those of a task follow those of the tasks before it.
        task = F.shiftright("run", 33)
        made = fresh.where("path is not null").select("file_id", "run", "path", "mtime", "size", "content_hash")
        tasks = made.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
        sizes = [(r["task"], r["n"]) for r in tasks.orderBy("task").toLocalIterator()]
        bases = spark.createDataFrame([(t, base + b) for (t, _), b in zip(sizes, accumulate((n for _, n in sizes), initial=0))], "task long, base long")
        numbered = lambda c: F.col("base") + F.col(c).bitwiseAND(F.lit((1 << 33) - 1))
        dense = lambda rows: rows.withColumn("task", task).join(F.broadcast(bases) if len(sizes) <= MAX_TASKS else bases, "task").withColumns({c: numbered(c) for c in ("file_id", "run") if c in rows.columns}).drop("task", "base")
        files = dense(made).withColumn("build", F.lit(number))
        lists = dense(fresh.where("g is not null").select("g", "run", "at"))
        if kept is not None:
            files = files.unionByName(kept)
            lists = lists.unionByName(_left(old.lists, mine, old.meta["file_count"] <= MASKED))
        files.write.parquet(f"{path}/files")
        total = spark.read.parquet(f"{path}/files").agg(F.count("*").alias("n"), F.count_if(F.col("build") == number).alias("read"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest")).first()
        parts = max(1, -(-(total["bytes"] or 0) // PART_BYTES))
        spread = lists.repartitionByRange(parts, "g", "run").sortWithinPartitions("g", "run").select("g", "run", "at")
        spread.write.option("parquet.writer.version", "v2").option("compression", "zstd").parquet(f"{path}/lists")
        lengths = spark.read.parquet(f"{path}/lists").groupBy("g").agg(F.sum(F.size("at").cast("long")).alias("df"))
        lengths.repartitionByRange("g").sortWithinPartitions("g").write.parquet(f"{path}/grams")
        grams = spark.read.parquet(f"{path}/grams").count()
        check_limits(total["n"], grams)
        meta = [(FORMAT, number, grams, total["n"], total["n"] - total["read"], total["read"], total["bytes"] or 0, total["newest"] or 0, int(time.time()), commit_hash)]
        spark.createDataFrame(meta, "format_version int, build int, trigram_count long, file_count long, kept_files long, read_files long, bytes long, newest long, built_at long, commit_hash string").coalesce(1).write.parquet(f"{path}/meta")
        for part in ("fresh", "state"):
            fs, p = _fs(spark, f"{path}/{part}")
            fs.delete(p, True)
        before = current(spark, index)
        _write_text(spark, f"{index}/CURRENT.{version}", version)
        _replace(spark, _fs(spark, f"{index}/CURRENT.{version}")[1], _fs(spark, f"{index}/CURRENT")[1])
        if before:
            _write_text(spark, f"{index}/{before}/SUPERSEDED", version)
        _drop_old(spark, index, version)
        return open_index(spark, index)


def _drop_old(spark: SparkSession, index: str, version: str) -> None:
    """Deletes the versions that have been replaced for KEEP_SECONDS; searches that opened one of the others may still run."""
    fs, p = _fs(spark, index)
    for status in fs.listStatus(p):
        folder = status.getPath()
        if not folder.getName().startswith("v-") or folder.getName() == version:
            continue
        marker = _fs(spark, f"{index}/{folder.getName()}/SUPERSEDED")[1]
        # One without a marker was left by a build that failed.
        since = fs.getFileStatus(marker) if fs.exists(marker) else status
        if time.time() - since.getModificationTime() / 1000 > KEEP_SECONDS:
            fs.delete(folder, True)


def _replace(spark: SparkSession, made, pointer) -> None:
    """Renames made to pointer, over what is there, in one step."""
    sc = spark.sparkContext
    options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    conf = sc._jsc.hadoopConfiguration()
    uri = pointer.getFileSystem(conf).makeQualified(pointer).toUri()
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(made, pointer, options)


def size_on_disk(spark: SparkSession, index: str) -> int:
    fs, p = _fs(spark, index)
    return fs.getContentSummary(p).getLength()
