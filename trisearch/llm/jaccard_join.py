"""N-gram Jaccard join: a size-aware join of light and heavy sets.

Each text's set of word shingles is a set of 64-bit hashes in one order for all
texts: shingles that very many texts share come last. Two sets as alike as asked
share at least k shingles among the first of either (its prefix for k). A set below
a size enumerates the pairs of its prefix for k = 2; a larger one, and for the sake
of pairs across the boundary a somewhat smaller one, stands in the inverted lists of
its prefix for k = 1. The boundary is where enumerating costs as much as scanning.

A list with many sets isn't expanded into all pairs. Rounds compare its sets with
a few of them; what they link is one component afterwards, and at last all pairs of
sets that no round put together, of like sizes, are compared. A bitmap of each set bounds
the overlap from above; pairs within the bound are verified with the sets. The list of a shingle that
very many texts share stands in segments, and no step has all of it in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components

WORDS, PERCENT = 5, 80
#: Counters by which shingles that many texts share are told: 2 to a power, one for each 8 shingles or so.
MIN_BITS, MAX_BITS = 14, 22
BLOCK = 4096
#: Bits of a set's bitmap: about two for each shingle, a power of two between these.
MIN_BITMAP, MAX_BITMAP = 1 << 8, 1 << 14
#: Sets of a list with which each round compares the others, before the rest is compared.
HUBS = (8, 8, 16)
#: Steps of the components between rounds.
LABEL_STEPS = 2
#: Sets of a segment of a list, about.
SEGMENT = 1 << 15
#: Words of which a Python worker remembers the hash; beyond, it starts anew.
CACHE_WORDS = 300_000
#: Ids that are broadcast to select texts (8 bytes each); beyond, a shuffle joins them.
BROADCAST_IDS = 1_000_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.cache = words, {}

    def __call__(self, text: str):
        import numpy as np
        import xxhash

        cache, words = self.cache, text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        try:
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        n = len(words) - k + 1
        # A shingle of fewer words, of a short text, starts from another number.
        x = np.full(n, k, np.uint64)
        for j in range(k):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return np.unique(x)


def names_of(shingles) -> tuple[int, int]:
    """Two hashes, of 63 bits each, of all shingles of a set."""
    import xxhash

    found = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return found & (1 << 63) - 1, found >> 65


def node_of(shingles, twice=frozenset(), bits: int = 63) -> int:
    """The name of a set: its first hash, cut to some bits, or its second where that is one of twice."""
    node, check = names_of(shingles)
    node &= (1 << bits) - 1
    return check if node in twice else node


def bitmap_of(shingles) -> bytes:
    """Bits that each shingle of the set flips; where two bitmaps differ, the sets do."""
    import numpy as np

    bits = min(MAX_BITMAP, max(MIN_BITMAP, 1 << (2 * len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 > 0).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ; the longer one's parts are laid over each other."""
    import numpy as np

    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)  # bit counts of signed numbers are of their absolute values
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y))) ^ y).sum())


def folded(bitmaps: list[bytes]):
    """Of each bitmap its parts of the least size laid over each other, as columns of 64 bits."""
    import numpy as np

    return np.array([np.bitwise_xor.reduce(np.frombuffer(b, np.int64).reshape(-1, MIN_BITMAP // 64)) for b in bitmaps]).reshape(len(bitmaps), -1)


def needed(n, percent: int = PERCENT):
    """The shingles that a set of n has to share at least with any set that it links to."""
    return -(-percent * n // 100)


def slots(shingles, bits: int):
    import numpy as np

    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def prefix_keys(shingles, level, boundary: int, percent: int = PERCENT):
    """(keys, places, levels): what a set stands under, see the module, where in its
    order the shingle of the key is, 0 for pairs, and how frequent the key can be."""
    import numpy as np

    n = len(shingles)
    bits = len(level).bit_length() - 1
    found = level[slots(shingles, bits)]
    order = np.argsort(found, kind="stable")
    ordered, found = shingles[order], found[order]
    first = n - needed(n, percent) + 1
    keys, places, levels = [ordered[:0]], [np.zeros(0, np.int32)], [found[:0]]
    if n <= boundary and (k := min(n, first + 1)) > 1:
        i, j = np.triu_indices(k, 1)
        keys.append((ordered[i] * np.uint64(0xBF58476D1CE4E5B9) + ordered[j]) * np.uint64(0x94D049BB133111EB))
        places.append(np.zeros(len(i), np.int32))
        levels.append(found[i])  # ascending, so i's is the lower one
    if n > boundary * percent // 100:
        keys.append(ordered[:first])
        places.append(np.arange(first, dtype=np.int32))
        levels.append(found[:first])
    return np.concatenate(keys), np.concatenate(places), np.concatenate(levels)


def boundary_by_cost(counts, level, percent: int = PERCENT) -> int:
    """The size up to which pairs of the prefix are no more than the entries of
    inverted lists that a set's prefix meets. Their mean length follows from the
    second moment of the counters, less what unlike shingles in a counter add."""
    import numpy as np

    n = total = squares = 0
    for at in range(0, len(counts), 1 << 16):
        rare = counts[at : at + (1 << 16)][level[at : at + (1 << 16)] == 0].astype(float)
        n, total, squares = n + len(rare), total + rare.sum(), squares + (rare**2).sum()
    length = 1 + max(0.0, squares - total**2 / max(n, 1)) / max(total, 1)
    size = 3
    while size < 200 and (size + 1 - needed(size + 1, percent) + 2) / 2 <= length:
        size += 1
    return size


def _scan(rows: DataFrame, words: int, bits: int, name_bits: int) -> DataFrame:
    """A row (doc_id, text_hash, n, node, check, bitmap, f0 to f3) for each of rows (doc_id, text, text_hash),
    and for each task and block of counters one with (block, counts), the low bytes of all before the high ones."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("check", pa.int64()), ("bitmap", pa.binary()), *((f"f{i}", pa.int64()) for i in range(4)), ("block", pa.int32()), ("counts", pa.binary())])
        shingler, counts, seen = Shingler(words), np.zeros(1 << bits, np.int32), set()
        for batch in batches:
            for part in common.chunks(batch, limit=2 << 20):
                found = [shingler(t) for t in part.column(1).to_pylist()]
                nodes = [node_of(x, bits=name_bits) if len(x) else None for x in found]
                checks = [names_of(x)[1] if len(x) else None for x in found]
                bitmaps = [bitmap_of(x) for x in found]
                none = np.array([x is None for x in nodes])
                n = len(found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(map(len, found)), pa.int32()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(bitmaps, pa.binary()), *(pa.array(c, mask=none) for c in folded(bitmaps).T.copy()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
                new = [x for x, name in zip(found, checks, strict=True) if name is not None and name not in seen and not seen.add(name)]  # copies do not make a shingle frequent
                if new:
                    at, times = np.unique(slots(np.concatenate(new), bits), return_counts=True)
                    counts[at] += times.astype(np.int32)
        blocks = np.minimum(counts, 65535).astype("<u2").view(np.uint8).reshape(-1, BLOCK, 2).transpose(0, 2, 1).reshape(-1, 2 * BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            none = {f.name: pa.nulls(len(part), f.type) for f in schema}
            none |= {"block": pa.array(part, pa.int32()), "counts": pa.array([blocks[i].tobytes() for i in part], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(none.values()), schema=schema)

    return rows.mapInArrow(common.alone(run), "doc_id long, text_hash long, n int, node long, check long, bitmap binary, f0 long, f1 long, f2 long, f3 long, block int, counts binary")


def _levels(scanned: DataFrame, percent: int, bits: int):
    """(level of each counter, segments of a list by the level of its key, boundary). The counters' sums have a fixed size."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = np.frombuffer(c, np.uint8).reshape(2, -1).astype(np.int64)
                sums[b] = sums.get(b, 0) + low + (high << 8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    counts = np.zeros((1 << bits) // BLOCK * BLOCK, np.int32).reshape(-1, BLOCK)
    for r in scanned.where("block is not null").select("block", "counts").repartition("block").mapInArrow(run, "block int, counts binary").toLocalIterator():
        counts[r["block"]] = np.frombuffer(r["counts"], np.int32)
    counts = counts.ravel()
    # Level 0 for what chance brings together; then two levels for each doubling.
    mean = counts.mean()
    steps = max(mean + 4 * mean**0.5, 2) * 2.0 ** (np.arange(64) / 2)
    level = np.zeros(len(counts), np.int8)
    for at in range(0, len(counts), 1 << 16):
        level[at : at + (1 << 16)] = np.searchsorted(steps, counts[at : at + (1 << 16)], "right")
    # A counter of level 0 has what comes together by chance.
    segments = np.concatenate([[1], np.maximum(1, np.ceil((np.minimum(steps[1:], 2.0**31) - mean) / SEGMENT))]).astype(np.int64)
    return level, segments, boundary_by_cost(counts, level, percent)


def _lists(rows: DataFrame, level, segments, boundary: int, words: int, percent: int, naming: dict) -> DataFrame:
    """(key, segment, node, n, place): the lists with more than one set; segment is 0 where a list has one only."""
    sent = rows.sparkSession.sparkContext.broadcast(level)  # a byte for each counter

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shingler, seen = Shingler(words), set()
        for batch in batches:
            for part in common.chunks(batch, limit=2 << 20):
                found, nodes, sizes = [], [], []
                for text in part.column(1).to_pylist():
                    x = shingler(text)
                    if len(x) and (node := node_of(x, **naming)) not in seen:
                        seen.add(node)
                        found.append(prefix_keys(x, sent.value, boundary, percent))
                        nodes.append(node)
                        sizes.append(len(x))
                if not found:
                    continue
                keys, places, levels = (np.concatenate(x) for x in zip(*found, strict=True))
                each = [len(k) for k, _, _ in found]
                names, many = np.repeat(np.array(nodes, np.int64), each), segments[levels]
                columns = keys.view(np.int64), np.where(many > 1, 1 + names % many, 0).astype(np.int32), names, np.repeat(np.array(sizes, np.int32), each), places
                for at in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["key", "segment", "node", "n", "place"])

    order = Window.partitionBy("key", "segment").orderBy("node")
    entries = rows.mapInArrow(common.alone(run), "key long, segment int, node long, n int, place int").withColumn("last", F.lag("node").over(order)).where("last is null or last <> node").drop("last")
    return entries.withColumns({"last": F.lag("node").over(order), "next": F.lead("node").over(order)}).where("segment > 0 or last is not null or next is not null").drop("last", "next")


def _like(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m can be alike enough by their sizes, and with the
    shingle at places i and j as the first that they share."""
    rest = F.least(n - i, m - j)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= (n + m) * percent)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave the asked overlap possible."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            apart = np.fromiter(map(differing, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            shared = (n + m - apart) // 2  # at most
            yield batch.select([0, 1]).filter(pa.array(100 * shared >= percent * (n + m - shared)))

    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"bitmap{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "nb", "bitmapa", "bitmapb").mapInArrow(common.alone(run), "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, percent: int, naming: dict) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is as asked. pairs is a stored table."""

    def sets(batches):
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            for part in common.chunks(batch):
                found = [s for t in part.column(0).to_pylist() if len(s := shingler(t))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s, **naming) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "items"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                i = np.searchsorted(y, x)
                i[i == len(y)] = 0
                shared = int((y[i] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = ends.join(nodes, "node").select(F.col("rep").alias("doc_id"), "node")
    few = pairs.count() <= BROADCAST_IDS // 2
    ids = wanted.select(F.col("doc_id").alias("rep"))
    texts = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    found = texts.mapInArrow(common.alone(sets), "node long, items binary").join(ends, "node", "left_semi").dropDuplicates(["node"])
    one = lambda x: found.select(F.col("node").alias(x), F.col("items").alias(f"items{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "itemsa", "itemsb").mapInArrow(common.alone(run), "a long, b long")


def _by_hubs(left: DataFrame, hubs: int, turn: int, percent: int, cut: bool) -> DataFrame:
    """Pairs (a, b) of a list's sets with a few of them. cut: whether lists have segments."""
    marked = left.withColumn("h", F.xxhash64("node", F.lit(turn)))
    # The sets with most links so far are the likeliest to link to others.
    order = Window.partitionBy("key", "segment").orderBy(F.desc("degree"), "h", "node")
    one = F.struct("node", "n", "place", "component")
    hub = F.when(F.row_number().over(order) <= hubs, one)
    fits = lambda o: (o["component"] != F.col("component")) & _like(F.col("n"), o["n"], F.col("place"), o["place"], percent)
    pairs = lambda rows: rows.select("node", F.explode(F.transform(F.filter("hubs", fits), lambda o: o["node"])).alias("o")).select(*_pair("node", "o"))
    before = marked.withColumn("hub", hub).withColumn("hubs", F.collect_list("hub").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = pairs(before)
    if cut:
        # The first segment's are those of the other ones, too; stored, so that the join can be split.
        first = marked.where("segment = 1").withColumn("r", F.row_number().over(order)).where(F.col("r") <= hubs)
        first = common.stored(first.groupBy("key").agg(F.collect_list(one).alias("hubs")), "hubs")
        found = found.union(pairs(marked.where("segment > 1").join(first, "key")))
    return found


def _all_others(left: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of a set outside its list's largest component with a set of another one."""
    # Stored, so that the joins with long lists can be split.
    core = left.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("core"))
    core = common.stored(core, "cores")
    left = left.join(nodes.select("node", *(f"f{i}" for i in range(4))), "node")
    outside = left.join(core, "key").where("component <> core").select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "place", "component", "f0", "f1", "f2", "f3")))
    outside = common.stored(outside, "outside")
    apart = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"f{i}2"))) for i in range(4)), F.lit(0))
    shared = (F.col("n") + F.col("n2") - apart) / 2  # at most
    possible = shared * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    fits = (left["key"] == outside["key"]) & (F.col("component") != F.col("component2")) & _like(F.col("n"), F.col("n2"), F.col("place"), F.col("place2"), percent) & possible
    return left.join(outside, fits).select(*_pair("node", "node2"))


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, name_bits: int = 63) -> DataFrame:
    """(doc_id, text_hash, n, group_id, component_id) of every row of docs (doc_id, text), see linked().

    text_hash is xxhash64 of the text; group_id names the component and is null for sets without shingles.
    name_bits: of the hash that names a set; sets of one name get others.
    """
    spark = docs.sparkSession
    rows = common.id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    bits = min(MAX_BITS, max(MIN_BITS, round(math.log2(max(common.text_bytes(rows), 1) / 48))))
    scanned = common.stored(_scan(rows, words, bits, name_bits), "scan")
    members = scanned.where("block is null").drop("block", "counts")

    def named(members: DataFrame) -> DataFrame:
        every = [F.min("doc_id").alias("rep"), F.min("check").alias("low"), F.max("check").alias("high"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), *(F.first(f"f{i}").alias(f"f{i}") for i in range(4))]
        return common.stored(members.where("node is not null").groupBy("node").agg(*every), "nodes")

    nodes = named(members)
    # Names of more than one set: of 10^10 sets about five.
    twice = frozenset(r["node"] for r in nodes.where("low <> high").select("node").collect())
    if twice:
        other = spark.createDataFrame([(x,) for x in twice], "node long").withColumn("again", F.lit(True))
        members = members.join(other, "node", "left").withColumn("node", F.when(F.col("again"), F.col("check")).otherwise(F.col("node"))).drop("again")
        nodes = named(members)
    naming = {"twice": twice, "bits": name_bits}
    level, segments, boundary = _levels(scanned, percent, bits)
    lists = common.stored(_lists(rows.drop("text_hash"), level, segments, boundary, words, percent, naming), "lists")
    cut = not lists.where("segment > 0").isEmpty()

    links, labels, tried = None, None, None
    own = Window.partitionBy("key", "segment")
    for turn, hubs in enumerate([*HUBS, None]):
        added = False
        if links is None:
            left = lists.withColumn("component", F.col("node")).withColumn("degree", F.lit(0))
        else:
            # A round needs no more than that sets of one label are connected; what comes after all rounds is costly where they are not of one.
            labels = common.stored(components(links, LABEL_STEPS if hubs else None), "labels")
            # Lists whose sets are not all of one component yet, and all that are in segments.
            degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
            known = labels.join(degrees, "node", "left")
            left = lists.join(known, "node", "left").withColumns({"component": F.coalesce("component", "node"), "degree": F.coalesce("degree", F.lit(0))})
            left = left.withColumns({"low": F.min("component").over(own), "high": F.max("component").over(own)}).where("segment > 0 or low <> high").drop("low", "high")
        found = (_by_hubs(left, hubs, turn, percent, cut) if hubs else _all_others(left, nodes, percent)).distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = common.stored(found, "pairs")
        if found.isEmpty():
            continue
        tried = found if tried is None else tried.union(found)
        possible = common.stored(_bounded(found, nodes, percent), "possible")
        new = common.stored(_verified(possible, rows, nodes, words, percent, naming), "linked")
        if added := not new.isEmpty():
            links = new if links is None else links.union(new)
    if added:
        labels = common.stored(components(links), "labels")

    if labels is None:
        labels = spark.createDataFrame([], "node long, component long")
    # Both are stored, so that the joins with a large component's or a repeated set's rows can be split.
    reached = labels.join(nodes.select("node", "rep"), "node")
    lows = common.stored(reached.groupBy(F.col("component").alias("group_id")).agg(F.min("rep").alias("component_id")), "lows")
    reached = reached.join(lows, F.col("component") == F.col("group_id")).select("node", "group_id", "component_id")
    alone = nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("group_id"), F.col("rep").alias("component_id"))
    least = common.stored(reached.unionByName(alone), "groups")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(least, "node", "left").select("doc_id", "text_hash", "n", "group_id", component.alias("component_id"))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Texts are cut at ASCII white space with A-Z lowered; a text's set has its
    distinct shingles of words, or all of a shorter text as one. Two rows are linked when their sets'
    intersection has at least percent hundredths of their union; component_id is
    the smallest id that links reach. A null or empty text, or one of white space,
    has no shingles and links with nothing, so its component is its own id. Null ids take part and have
    the component of what they link to, null if that has no other id; repeated
    rows are each returned; an empty table gives an empty one; other columns are ignored.
    Sets are told apart by 126 bits of hashes and shingles by 64-bit ones.
    """
    return grouped(docs, words, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest
    id, null being the largest, and of rows of one id that of the smallest hash of
    the text; of rows equal in both any one. Rows without shingles all stay."""
    found = common.stored(grouped(docs, words, percent), "members").where("group_id is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.groupBy("group_id").agg(F.min(rank).alias("best")).select(F.col("best.doc_id").alias("d"), F.col("best.text_hash").alias("h"), F.lit(True).alias("is_best"))
    counted = found.groupBy("doc_id", "text_hash").count()
    marked = counted.join(best, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    # Rows of one id and text are all gone or all but one.
    gone = common.stored(marked.where("is_best is null or count > 1").select("doc_id", "text_hash", F.col("is_best").isNotNull().alias("repeated")), "gone")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(*common.same_row(docs, gone.drop("repeated"), text_hash), "left_anti")
    repeated = gone.where("repeated").drop("repeated")
    if repeated.isEmpty():
        return kept
    (name,) = common.fresh(docs, "text_hash")
    once = docs.join(*common.same_row(docs, repeated, text_hash), "left_semi").withColumn(name, text_hash).dropDuplicates(["doc_id", name]).drop(name)
    return kept.unionByName(once)
