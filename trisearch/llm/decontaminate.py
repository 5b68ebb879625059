"""Benchmark decontamination, in DataFrame functions only.

Windows of a document that are as long as a benchmark item are fingerprinted by
SimHash and looked up among the items' fingerprints. Fingerprints are cut into so few
blocks that any two within the radius differ in at most two bits of some block; items
stand under all values that near to their blocks. Those that meet and are within the radius are
candidates, and the weighted Jaccard similarity of their shingles, which is exact, decides.

The windows of a length start at every word. To be at least as similar to an item as
asked, a window must hold a number of shingles that items of its length have, and
only windows that hold so many are fingerprinted; this leaves out none that is similar.
Only these shingles are joined, and of the others nothing is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
BITS, RADIUS = 64, 20
#: Bits in which fingerprints may differ in the block in which they meet.
FLIPS = 2
#: Rows made of the items (shingles, or values of blocks), and stretches of windows, that are
#: broadcast (up to 40 bytes each); with more, a shuffle joins them.
BROADCAST_ROWS, BROADCAST_STRETCHES = 2_000_000, 1_000_000
#: Windows of a stretch: next to each other, they share a copy of their words.
STRETCH = 256


def words_of(text: Column) -> Column:
    """The runs of letters and digits of a text, A-Z lowered."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, size: int | Column) -> Column:
    """Hashes of the runs of size words, in order; of fewer words one hash of all; of none none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n > 0, many).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """The fingerprint: each bit is what most of the hashes, each as often as it comes, have there."""
    # Each sum counts some bits at a time, one in each field of a long; short lists need small fields.
    return F.when(F.size(hashes) < 1 << 7, _majority(hashes, 8)).otherwise(_majority(hashes, 32))


def _majority(hashes: Column, width: int) -> Column:
    fields = range(0, BITS, width)
    ones = F.lit(sum(1 << at for at in fields))
    counted = lambda b: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, b).bitwiseAND(ones))
    sums = F.array(*map(counted, range(width)))
    most = lambda n: F.when(n * 2 > F.size(hashes), F.lit(1)).otherwise(F.lit(0)).cast("long")

    def bits(n):
        found = F.lit(0).cast("long")
        for at in fields:
            found = found.bitwiseOR(F.shiftleft(most(F.shiftrightunsigned(n, at).bitwiseAND(F.lit((1 << width) - 1))), at))
        return found

    # The last sum's bits move furthest.
    return F.aggregate(F.reverse(F.transform(sums, bits)), F.lit(0).cast("long"), lambda a, n: F.shiftleft(a, 1).bitwiseOR(n))


def parts(fingerprint: Column, radius: int) -> list[tuple[Column, int]]:
    """(value, bits) of the blocks that cover all bits; at most FLIPS bits differ in
    one of them at least if at most radius do in all."""
    n = radius // (FLIPS + 1) + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)), hi - lo) for lo, hi in zip(edges, edges[1:])]


def probes(fingerprint: Column, radius: int) -> Column:
    """An array of (block, value): of every block all values that differ in at most FLIPS bits."""
    flips = lambda bits: F.expr("array({}L)".format("L, ".join(str(sum(some)) for n in range(FLIPS + 1) for some in combinations([1 << i for i in range(bits)], n))))
    near = lambda i, v, bits: F.transform(flips(bits), lambda f: F.struct(F.lit(i).alias("block"), v.bitwiseXOR(f).alias("value")))
    return F.concat(*(near(i, v, bits) for i, (v, bits) in enumerate(parts(fingerprint, radius))))


def blocks(fingerprint: Column, radius: int) -> Column:
    """An array of (block, value): every block as it is."""
    return F.array(*(F.struct(F.lit(i).alias("block"), v.alias("value")) for i, (v, _) in enumerate(parts(fingerprint, radius))))


def first_block(apart: Column, radius: int) -> Column:
    """Of the blocks in which fingerprints meet, of which apart has the differing bits, the first."""
    return F.coalesce(*(F.when(F.bit_count(v) <= FLIPS, i) for i, (v, _) in enumerate(parts(apart, radius))))


def repeats(ordered: Column) -> Column:
    """An ascending array without the first of each element's copies."""
    return F.filter(ordered, lambda v, i: F.get(ordered, i - 1) == v)


def weighted_jaccard(x: str, y: str) -> Column:
    """Sum of the smaller over sum of the larger numbers of each element, of two columns of ascending arrays."""
    x, y = F.col(x), F.col(y)
    times = lambda a, v: F.size(F.filter(a, lambda w: w == v))
    # Most elements come once; only the further copies are counted one by one.
    more = F.aggregate(F.array_intersect(repeats(x), repeats(y)), F.lit(0), lambda s, v: s + F.least(times(x, v), times(y, v)) - 1)
    shared = F.size(F.array_intersect(x, y)) + more
    return shared / (F.size(x) + F.size(y) - shared)


def _items(benchmark: DataFrame, words: int) -> DataFrame:
    """(item_id, size, hashes, fingerprint) of the items that have words; hashes ascend."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", F.size("words").alias("size"), F.sort_array(shingles(F.col("words"), words)).alias("hashes")).dropDuplicates(["item_id", "hashes"])
    return items.withColumn("fingerprint", simhash(F.col("hashes")))


def _starts(places: Column, n: Column, size: Column, words: int, threshold: float) -> Column:
    """Where windows of size words start in a text of n words that hold so many of
    places (ascending) that they can be as similar as threshold; each start once."""
    k, long = F.least(size, F.lit(words)), F.least(n, size)
    held = long - k + 1
    # With m and held shingles, two are t similar if they share t (m + held) / (1 + t).
    need = F.greatest(F.ceil((size - k + 1 + held) * threshold / (1 + threshold) - 1e-9).cast("int"), F.lit(1))

    def run(i):  # windows with the i-th place and the need - 1 after it, and without the one before
        first = F.greatest(F.element_at(places, i + need - 1) - held + 1, F.when(i > 1, F.get(places, i - 2) + 1).otherwise(F.lit(0)), F.lit(0))
        last = F.least(F.element_at(places, i), n - long)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    runs = F.when(F.size(places) >= need, F.flatten(F.transform(F.sequence(F.lit(1), F.size(places) - need + 1), run))).otherwise(none)
    # Windows that the text's end cuts short hold fewer shingles, of which more must be shared.
    enough = lambda s: F.size(F.filter(places, lambda p: p >= s)) >= F.greatest((size - k + 1 + n - s - k + 1) * threshold / (1 + threshold) - 1e-9, F.lit(1))
    last = n - k + 1 - F.ceil((size - k + 1) * threshold - 1e-9).cast("int")
    short = F.when(last > n - long, F.filter(F.sequence(n - long + 1, last), enough)).otherwise(none)
    return F.concat(runs, short)


def _stretches(places: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, size, first, last): the windows to fingerprint, as runs of starts that follow
    each other, of places (doc_id, text_hash, n, size, places)."""
    starts = places.select("doc_id", "text_hash", "size", _starts(F.col("places"), F.col("n"), F.col("size"), words, threshold).alias("starts"))
    begins = F.filter("starts", lambda s, i: (i == 0) | (F.get("starts", i - 1) != s - 1) | (s % STRETCH == 0))
    ends = F.filter("starts", lambda s, i: (F.coalesce(F.get("starts", i + 1), F.lit(-1)) != s + 1) | ((s + 1) % STRETCH == 0))
    runs = starts.select("doc_id", "text_hash", "size", begins.alias("begins"), ends.alias("ends"))
    return runs.select("doc_id", "text_hash", "size", F.explode(F.arrays_zip("begins", "ends")).alias("run")).select("doc_id", "text_hash", "size", F.col("run.begins").alias("first"), F.col("run.ends").alias("last"))


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, start) of each text of docs (doc_id,
    text) with a window that is as long as an item of benchmark (item_id, text) and
    whose weighted Jaccard similarity to it is at least threshold: the most similar
    window, the first of equal ones, which starts at word start (from 0). A window may be
    cut short by the text's end. Only what the fingerprints tell apart is missed (README).

    Items and texts that are null, empty or without words take part in nothing; an
    item of fewer words than a shingle must be found as a whole; repeated rows of one id and
    text count as one, different texts of an id are told apart by text_hash (xxhash64),
    repeated items are kept apart by id; null ids stay null; an empty table gives an
    empty result; other columns are ignored.
    """
    common.small_batches(docs.sparkSession)
    items = common.cut(_items(benchmark, words))
    known = items.select("size", F.explode("hashes").alias("hash")).distinct()
    # Runs of fewer words are needed only if items are that short.
    facts = items.agg(F.coalesce(F.sum(F.size("hashes").cast("long")), F.lit(0)), F.count("*"), F.collect_set(F.least("size", F.lit(words)))).first()
    if not facts[1]:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, similarity double, start int")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    split = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    met = None
    for k in facts[2]:
        whole = split.where(F.size("words") >= k).select("doc_id", "text_hash", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"), k)).alias("pos", "hash"))
        some = whole.join(_sent(known.where(F.least("size", F.lit(words)) == k), facts[0]), "hash").select("doc_id", "text_hash", "n", "size", "pos")
        met = some if met is None else met.union(some)

    places = met.groupBy("doc_id", "text_hash", "size").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("pos")).alias("places"))
    runs = common.cut(_stretches(places, words, threshold))
    wanted = runs.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("size", "first", "last")).alias("runs"))
    again = texts.join(_sent(wanted, runs.count(), BROADCAST_STRETCHES), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    again = again.select("doc_id", "text_hash", "runs", words_of(F.col("text")).alias("words"))
    part = lambda r: F.struct(r["size"].alias("size"), r["first"].alias("first"), (r["last"] - r["first"]).alias("more"), F.slice("words", r["first"] + 1, r["last"] - r["first"] + r["size"]).alias("part"))
    cuts = again.select("doc_id", "text_hash", F.explode(F.transform("runs", part)).alias("r")).select("doc_id", "text_hash", "r.*")
    k = F.least("size", F.lit(words))
    cuts = cuts.select("doc_id", "text_hash", "size", "first", "more", shingles(F.col("part"), k).alias("hashes"))
    one = lambda j: F.struct((F.col("first") + j).alias("start"), F.slice("hashes", j + 1, F.col("size") - k + 1).alias("found"))
    windows = cuts.select("doc_id", "text_hash", "size", F.explode(F.transform(F.sequence(F.lit(0), "more"), one)).alias("w")).select("doc_id", "text_hash", "size", "w.start", F.sort_array("w.found").alias("found"))
    printed = windows.withColumn("print", simhash(F.col("found")))
    asked = printed.select("*", F.explode(blocks(F.col("print"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    stood = items.select("item_id", "size", "fingerprint", F.explode(probes(F.col("fingerprint"), radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    apart = F.col("print").bitwiseXOR(F.col("fingerprint"))
    near = asked.join(_sent(stood, facts[1] * 500), ["size", "block", "value"]).where((F.bit_count(apart) <= radius) & (first_block(apart, radius) == F.col("block")))
    same = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("s")) & (F.col("fingerprint") == F.col("f"))
    near = near.join(_sent(items.select(F.col("item_id").alias("i"), F.col("size").alias("s"), F.col("fingerprint").alias("f"), "hashes"), facts[0]), same)
    scored = near.select("doc_id", "text_hash", "item_id", "start", weighted_jaccard("found", "hashes").alias("similarity")).where(F.col("similarity") >= threshold)
    best = F.max_by("start", F.struct("similarity", -F.col("start")))
    return scored.groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("start"))


def _sent(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has few rows."""
    return F.broadcast(df) if rows <= limit else df


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in whose text nothing leaks."""
    found = common.stored(leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    return docs.join(*common.same_row(docs, found, F.xxhash64("text")), "left_anti")
