"""Trigram extraction, postings and their set algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.trigrams import Query


#: Places of a text whose trigrams are made distinct before those of the whole text are.
SPAN = 1 << 15


def trigrams_sql(text: Column) -> Column:
    """The distinct trigrams of a text's bytes as six hexadecimal digits, in built-in functions. The
    bytes are a lambda's argument: what a lambda makes itself is made again for each place."""

    def windows(data: Column) -> Column:
        last = F.octet_length(data) - 2
        span = lambda first: F.array_distinct(F.transform(F.sequence(first, F.least(first + (SPAN - 1), last)), lambda i: F.hex(F.substring(data, i, 3))))
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), last, F.lit(SPAN)), span)))

    made = F.get(F.transform(F.array(text.cast("binary")), windows), F.lit(0))
    return F.when(F.octet_length(text) >= 3, made).otherwise(F.array().cast("array<string>"))


#: Bytes of contents, and number of them, whose trigrams are sorted together.
TOGETHER, RUN = 2 << 20, 4096


def small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches hold about as many bytes as are sorted together, however long a table's partitions are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TOGETHER))


def _sorted(keys):
    """The distinct ones of an array of keys, sorted; the array is used up."""
    import numpy as np

    keys.sort()
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return keys[first]


def _windows(data):
    """The three bytes from each place of an array of bytes, but the last two, as one number."""
    import numpy as np

    every = data[:-2].astype(np.int64)
    for part in (data[1:-1], data[2:]):
        every <<= 8
        every |= part
    return every


def grams_of(contents: list[bytes], ends: bool = False):
    """(which, g): the distinct trigrams of each content, packed into ints, ordered by g and then by content. With ends the
    last bytes begin trigrams too, whose missing bytes are zero; texts have no zero bytes."""
    import numpy as np

    if len(contents) == 1 and len(contents[0]) > TOGETHER:
        # Of one long content, the distinct ones of its parts, which share two bytes.
        data, g = np.frombuffer(contents[0] + (b"\0\0" if ends else b""), np.uint8), np.empty(0, np.int64)
        for at in range(0, len(data) - 2, TOGETHER):
            g = _sorted(np.concatenate([g, _sorted(_windows(data[at : at + TOGETHER + 2]))]))
        return np.zeros(len(g), np.int64), g.astype(np.int32)
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    data = np.frombuffer(b"".join(c + b"\0\0" for c in contents), np.uint8)
    keys = _windows(data) if len(data) > 2 else np.empty(0, np.int64)
    keys <<= 32
    counts = sizes + 2
    if len(keys):
        keys |= np.repeat(np.arange(len(contents), dtype=np.int32), counts)[:-2]
    # Those that begin in what stands between two contents, and without ends those that go over an end, are none.
    none = np.zeros(len(data), bool)
    last = np.cumsum(counts)
    for back in (1, 2) if ends else (1, 2, 3, 4):
        at = last - back
        none[at[counts >= back]] = True
    keys = _sorted(keys[~none[:-2]])
    return keys & 0xFFFFFFFF, (keys >> 32).astype(np.int32)


def together(batch, column: int):
    """(first row, contents) of runs of an Arrow batch's rows with few bytes of contents in all; null ones are empty. A content that is longer is a run of its own."""
    run, at, size = [], 0, 0
    for i, content in enumerate(batch.column(column)):
        content = content.as_py() or b""
        if run and (size + len(content) > TOGETHER or len(run) == RUN):
            yield at, run
            run, at, size = [], i, 0
        run.append(content)
        size += len(content)
    if run:
        yield at, run


def extract(files: DataFrame) -> DataFrame:
    """(file_id, g) of files (file_id, content): each distinct trigram of a file's
    bytes once, packed into an int. A null content has none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, contents in together(batch, 1):
                which, g = grams_of(contents)
                for lo in range(0, len(g), 200_000):
                    some = slice(lo, lo + 200_000)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which[some] + at)), pa.array(g[some])], names=["file_id", "g"])

    small_batches(files.sparkSession)
    return files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).mapInArrow(run, "file_id long, g int")


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("g").agg(F.count("*").alias("df"))


def lookup(postings: DataFrame, grams: list[int]) -> DataFrame:
    """The postings of some trigrams; the filter reaches the Parquet scan."""
    return postings.where(F.col("g").isin(sorted(grams)))


def prefix_lookup(postings: DataFrame, pair: bytes) -> DataFrame:
    """The ids of files with a trigram that begins with two bytes."""
    low = pair[0] << 16 | pair[1] << 8
    return postings.where(F.col("g").between(low, low + 255)).select("file_id").distinct()


def candidates(postings: DataFrame, query: Query) -> DataFrame:
    """The ids of files that satisfy a query that is neither all nor none: one scan
    of the postings and one aggregation, with a flag for each trigram. Queries of
    prefixes are for postings with the ends of files, as an index has them."""
    if all(p.op == "prefix" for p in query.parts or (query,)):
        ranges = [F.col("g").between(p.gram, p.gram + 255) for p in query.parts or (query,)]
        return postings.where(reduce(lambda a, b: a | b, ranges)).select("file_id").distinct()
    grams = sorted(query.grams())
    found = lookup(postings, grams)
    if query.op in ("gram", "and") and all(p.op == "gram" for p in query.parts):
        return found.groupBy("file_id").count().where(F.col("count") == len(grams)).select("file_id")
    flags = found.groupBy("file_id").agg(*(F.max(F.col("g") == g).alias(f"g{g}") for g in grams))
    return flags.where(query.condition(lambda g: F.col(f"g{g}"))).select("file_id")
