"""Near-duplicate embeddings by iterative quantisation.

A rotation learned from a bounded sample turns each vector into a balanced binary
code. Codes stand in several hash tables, one for each part of their bits; a lookup
also tries every value one bit away, so all codes within a known Hamming distance
meet in some table. What is found is reranked with the original vectors. Equal
vectors are one class from the start and are never expanded into pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

THRESHOLD = 0.98
BITS, TABLES = 64, 4
#: Codes farther apart than this are not reranked.
RADIUS = 20
#: Bound of the sample that the rotation is learned from: the vectors with the smallest hashes.
SAMPLE, ROUNDS, SEED = 10_000, 50, 7


@dataclass
class Quantiser:
    mean: object
    turn: object  # dimensions x bits

    def codes(self, x):
        """64-bit codes of unit vectors in rows."""
        import numpy as np

        bits = (x - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1).view(">u8").astype("<u8").view(np.int64).ravel()


def _random(n: int, seed: int):
    """A random rotation of n dimensions, of which at most BITS are left."""
    import numpy as np

    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, BITS))))
    return turn


def _full(turn):
    """turn, and where it has fewer columns than BITS those of random rotations after it."""
    import numpy as np

    n, bits = turn.shape
    more = [_random(n, SEED + i) for i in range(1, -(-BITS // bits))]
    return np.hstack([turn, *more])[:, :BITS]


def unlearned(n: int) -> Quantiser:
    """For vectors of n dimensions of which the sample has none."""
    import numpy as np

    return Quantiser(np.zeros(n), _full(_random(n, SEED)))


def learn(x) -> Quantiser:
    """Iterative quantisation of unit vectors in rows: principal components, then
    by turns the codes of the turned vectors and the rotation that fits these best.
    Vectors of fewer dimensions than BITS get the rest of their bits from random rotations."""
    import numpy as np

    mean = x.mean(0)
    centred = x - mean
    values, vectors = np.linalg.eigh(centred.T @ centred)
    top = vectors[:, np.argsort(-values)[: min(BITS, x.shape[1])]]
    v = centred @ top
    turn = _random(top.shape[1], SEED)
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return Quantiser(mean, _full(top @ turn))


def unit(x):
    import numpy as np

    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """(node, label, embedding, rep, copies): equal vectors of a label, that can link at all.
    Written at once: node is a number of the written row."""
    e = F.col("embedding")
    good = F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = vectors.where(F.col("label").isNotNull() & e.isNotNull()).where(F.coalesce(good, F.lit(False)))
    found = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return found.withColumn("node", F.monotonically_increasing_id())


def _coded(nodes: DataFrame) -> DataFrame:
    """(node, label, dims, code) of classes."""
    import numpy as np

    sample = nodes.withColumn("size", F.size("embedding")).orderBy(F.xxhash64("label", "embedding"), "node").select("size", "embedding").limit(SAMPLE).collect()
    models = {}
    for size in {r["size"] for r in sample}:
        models[size] = learn(unit(np.array([r["embedding"] for r in sample if r["size"] == size])))
    sent = nodes.sparkSession.sparkContext.broadcast(models)  # as many as there are kinds of vectors in the sample

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(2)
            size = np.diff(vectors.offsets.to_numpy())
            codes = np.zeros(len(size), np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            for n in np.unique(size):
                some = np.flatnonzero(size == n)
                x = unit(flat[(at[some][:, None] + np.arange(n))])
                codes[some] = (sent.value.get(int(n)) or unlearned(int(n))).codes(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(codes)], names=["node", "label", "dims", "code"])

    return nodes.select("node", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, "node long, label string, dims int, code long")


def candidates(coded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b, each once: classes of a label and size whose codes differ by
    at most one bit in some table's part, and by at most radius in all."""
    width = BITS // TABLES
    part = lambda c, t: F.shiftrightunsigned(c, t * width).bitwiseAND(F.lit((1 << width) - 1))
    table = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), part("code", t).alias("v")) for t in range(TABLES))))
    stood = coded.select("label", "dims", F.col("node").alias("b"), F.col("code").alias("other"), table.alias("p")).select("label", "dims", "b", "other", "p.*")
    near = F.explode(F.array(F.lit(0), *(F.lit(1 << i) for i in range(width))))
    asked = stood.select("label", "dims", F.col("b").alias("a"), F.col("other").alias("code"), "t", "v", near.alias("flip")).select("label", "dims", "a", "code", "t", F.col("v").bitwiseXOR(F.col("flip")).alias("v"))
    met = asked.join(stood, ["label", "dims", "t", "v"]).where("a < b")
    apart = F.col("code").bitwiseXOR(F.col("other"))
    # Only in the first table in which they meet.
    first = F.lit(True)
    for t in range(TABLES - 1):
        first = first & ((F.col("t") <= t) | (F.bit_count(part(apart, t)) > 1))
    return met.where(first).where(F.bit_count(apart) <= radius).select("a", "b")


def links(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose vectors' cosine is at least threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                size = np.diff(batch.column(2).offsets.to_numpy())
                keep = np.zeros(batch.num_rows, bool)
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                at = np.concatenate([[0], np.cumsum(size)])
                for n in np.unique(size):
                    some = np.flatnonzero(size == n)
                    place = at[some][:, None] + np.arange(n)
                    keep[some] = np.einsum("ij,ij->i", unit(x[place]), unit(y[place])) >= threshold
                yield batch.select([0, 1]).filter(pa.array(keep))

    one = lambda x: nodes.select(F.col("node").alias(x), F.col("embedding").alias(f"e{x}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and the cosine of their vectors is at
    least threshold. A null label, a null, empty or zero vector and one with null or
    non-finite components links with nothing, nor do vectors of different sizes. A row with a null vec_id takes part;
    its component is the smallest id reached, null if there is none. Repeated rows
    each count and are each returned; an empty table gives an empty one; other
    columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    nodes = common.stored(classes(rows), "vectors")
    found = common.stored(links(candidates(_coded(nodes)), nodes, threshold), "links")
    both = found.union(found.select(F.col("b"), F.col("a")))
    others = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    labels = common.stored(components(found).join(nodes.select("node", "rep"), "node"), "labels")
    # Stored, so that the join with a large component's members can be split.
    lows = common.stored(labels.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("low")), "lows")
    reached = labels.join(lows, F.col("component") == F.col("c")).select("node", "low", F.lit(True).alias("linked"))
    least = nodes.join(reached, "node", "left").join(others, "node", "left")
    low = F.when(F.col("linked"), F.col("low")).otherwise(F.col("rep"))
    known = least.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), low.alias("low"))
    joined = rows.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
