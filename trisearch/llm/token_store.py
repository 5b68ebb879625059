"""Token ids as ORC files.

Documents are dealt by ranges of their ids, encoded, and written in ascending
order, a file for each range. ORC keeps the ids as run-length encoded integers
and an index of every row group; a Bloom filter on doc_id lets a reader that
looks up one document skip whole stripes, and stripes are read in parallel.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from functools import cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Settings of the ORC writer.
ORC = {
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}
#: Words of which a Python worker remembers the ids; beyond, it starts anew.
CACHE_WORDS = 800_000
CACHE_LENGTH = 64


def plain(word: str) -> bool:
    """Whether a word is of letters and digits, and still is when it is composed and lowered."""
    return word.isalnum() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalnum())


@cache
def odd() -> re.Pattern:
    """Finds a comma or full stop at a word's end that may be part of a longer run of
    signs, as after a sign or after a letter that leaves one when it is composed and lowered."""
    left = "".join(c for c in map(chr, range(0x80, 0x30000)) if c.isalnum() and not plain(c))
    return re.compile(rf"[.,](?<=[\W_{left}].)[ \n]")


def stem(word: str) -> str:
    """What to encode for a word: letters and digits with a comma or full stop
    after them without it, as that is a token of its own, and ASCII letters lowered."""
    bare = word[:-1] if word[-1:] in (".", ",") else word
    if not plain(bare):
        return word
    return bare.lower() if bare.isascii() else bare


def spread(text: str) -> list[str]:
    """The words of a text, with what would only make more of them taken off:
    ASCII letters lowered, commas and full stops after words on their own."""
    if "<|" not in text and not odd().search(text):
        text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        text = text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " , ").replace(".\n", " . ")
    return text.replace("\n", " ").split(" ")


class WordEncoder:
    """Encodes texts with a tokenizers file that drops white space, by words:
    as no token crosses a space or line end, a text's ids are those of its words."""

    def __init__(self, data: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words in the cache."""
        import numpy as np

        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), 1000):  # faster than word by word
            some = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                words = [*words, *some]
                continue
            data, ends = ids.tobytes(), (4 * ends).tolist()
            self.cache.update(zip(some, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        rest = [w for w in words if w not in self.cache]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id after them."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        words, ends = [], []
        for t in texts:
            words += spread(t)
            ends.append(len(words))
        found = list(map(cache.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = {words[i] for i in missing}
        marked = {w: s for w in new if (s := stem(w)) != w}
        bare = [w for w in {*new, *marked.values(), *".,"}.difference(marked) if w not in cache]
        self.learn(bare)
        for w, s in marked.items():
            cache[w] = cache[s] + cache[w[-1]] if w[-1] in ".," else cache[s]
        for i in missing:
            found[i] = cache[words[i]]
        for w in [*marked, *(w for w in bare if len(w) > CACHE_LENGTH)]:
            cache.pop(w, None)
        last = end.to_bytes(4, "little")
        return [b"".join(found[a:b]) + last for a, b in zip([0, *ends], ends, strict=False)]


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 1) -> None:
    """Writes the ids of docs (doc_id, text) to ORC files under path.

    Columns: doc_id, part and row (the place in the order), first (ids of the
    documents before it in its part), n_tokens, ids. Null texts are empty and
    have the end id only; null doc_ids come first; rows of one doc_id are in the
    order of their texts' hashes and then of the texts; an empty table gives
    files without rows; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = common.send_file(spark, vocabulary)
    rows = common.id_text(docs)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = common.once(("words", sent.value[0]), lambda: WordEncoder(sent.value[1]))
        part, row, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in common.chunks(batch):
                ids = encoder.encode(some.column(1).to_pylist(), end)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns = [some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(first + ends - n), pa.array(n), values]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "row", "first", "n_tokens", "ids"])
                row, first = row + len(n), first + int(ends[-1])

    tie = F.xxhash64("text")
    dealt = rows.withColumn("tie", tie).repartitionByRange(common.tasks_for(spark, common.text_bytes(rows)), "doc_id", "tie")
    ordered = dealt.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(run, "doc_id long, part int, row long, first long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


#: Files of which the places are broadcast, a few bytes each; beyond, they are joined by a shuffle.
BROADCAST_FILES = 1_000_000


def _starts(stored: DataFrame) -> DataFrame:
    """(part, before): the ids in all files before each file, a row for each file."""
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    return F.broadcast(starts) if len(stored.inputFiles()) <= BROADCAST_FILES else starts


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows (doc_id, start, n_tokens, ids); start counts the ids of all documents before."""
    stored = spark.read.orc(path)
    return stored.join(_starts(stored), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, from its ids as read from the files."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(3)
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            n = np.diff(at).astype(np.int64)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])

    stored = spark.read.orc(path)
    made = stored.select("doc_id", "part", "first", "ids").mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return made.join(_starts(stored), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of some documents; the filter reaches the files' Bloom filters and row indexes."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")
