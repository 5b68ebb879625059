"""Toxicity by class-conditional Kneser-Ney models.

Interpolated Kneser-Ney models of the characters of words, one of toxic and one
of ordinary labelled texts, with larger discounts for what comes more often. Long contexts have counts of their
class; below them both back off to the same continuation counts, so that a rare expression is about
as likely in either. A text's score is the difference of its log-likelihoods for
each word and for the words that stand out, put on a scale from 0 to 1 by a
logistic curve fitted across folds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: labelled documents of each class, those with the
#: smallest hashes of their ids, and of these the ones that have at most so many characters.
MAX_DOCS, MAX_CHARS = 1000, 1_000_000
#: Characters of an n-gram; up to SHARED characters, counts are of both classes.
ORDER, SHARED = 8, 2
#: What is taken from the count of an n-gram that comes once, twice, and more often.
DISCOUNTS = (0.95, 1.4, 1.7)
FOLDS = 2
#: Words of ratio 0 that are added to a text, and the ratio beyond which a word is more than noise.
PRIOR, NOISE = 20, 2.5
#: Ratios are cut at this.
CLIP = 12.0
#: Words of which a Python worker remembers the ratio; beyond, it starts anew.
CACHE_WORDS = 300_000
#: Longer words are cut into words of so many characters.
LONGEST = 64
#: Characters around a word.
BEGIN, END = "\x02", "\x03"


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case, within a word apostrophes too; the parts of long ones."""
    import regex

    found = regex.findall(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*", text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[at : at + LONGEST] for w in found for at in range(0, len(w), LONGEST)]


def _characters(words: list[str]):
    """The characters of words, ends included, one after another; how many of its
    word's there are up to each; which count, as all but BEGIN do; and where each word ends among those."""
    import numpy as np

    text = "".join([f"{BEGIN}{w}{END}" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int32, len(words)) + 2
    ends = np.cumsum(sizes, dtype=np.int32)
    have = np.arange(len(codes), dtype=np.int32) - np.repeat(ends - sizes, sizes) + 1
    return codes, have, have > 1, np.cumsum(sizes - 1)


def _hashes(codes):
    """For n from 0 to ORDER + 1 the hash of the n characters that end at each place."""
    import numpy as np

    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for n in range(1, ORDER + 2):
        yield h
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n - 1 :] = codes[: max(len(codes) - n + 1, 0)]
        shifted += np.uint64(n << 24)
        h = (h ^ shifted) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    yield h


@dataclass
class Ratio:
    """Log-likelihood ratios of words, toxic against ordinary.

    grams[n]: the ascending hashes of the n-grams, and for each class what an n-gram has of
    its own; rests[n]: what it leaves to shorter contexts where it is the context itself. The
    last of rests[1] is that of BEGIN, which never follows anything.
    """

    grams: list
    rests: list
    floor: float

    def words(self, words: list[str]):
        import numpy as np

        codes, have, counts, ends = _characters(words)
        hashes = _hashes(codes)
        next(hashes)
        at = np.flatnonzero(counts)
        p = np.full((2, len(at)), self.floor) * self.rests[0]
        left, context = np.arange(len(at)), None
        for n, h in zip(range(1, ORDER + 1), hashes):
            if n > 1:
                # A context that is not known leaves none longer that is.
                left = left[have[at[left]] >= n]
                of = context[at[left] - 1]
                left, of = left[of >= 0], of[of >= 0]
                p[:, left] *= self.rests[n - 1][:, of]
            keys, own = self.grams[n]
            gram = h[at[left]]
            i = np.searchsorted(keys, gram)
            i[i == len(keys)] = 0
            known = keys[i] == gram
            p[:, left[known]] += own[:, i[known]]
            context = np.full(len(counts), -1)
            context[at[left[known]]] = i[known]
            if n == 1:
                context[~counts] = len(keys)
        logs = np.concatenate([[0], np.cumsum(np.log(p[1]) - np.log(p[0]))])
        return logs[ends] - logs[np.concatenate([[0], ends[:-1]])]


def fit_ratio(words: list[str], uses) -> Ratio:
    """The two models of words, of which uses has the numbers of ordinary and of toxic texts that have them."""
    import numpy as np

    codes, have, counts, ends = _characters(words)
    sizes = np.diff(np.concatenate([[0], ends]))
    uses = np.repeat(np.asarray(uses, np.float32), sizes, axis=1)
    have, begun = have[counts], np.flatnonzero(counts) - 1
    alphabet = len(np.unique(codes)) + 1
    grams, rests = [None], []
    taken, hashes = np.array([0, *DISCOUNTS]), _hashes(codes)
    shorter, same = next(hashes), next(hashes)
    for n, longer_ones in zip(range(1, ORDER + 1), hashes):
        # Arrays of all places are dropped as soon as they have served.
        inside = np.flatnonzero(have >= n).astype(np.int32)
        keys, first, of = np.unique(same[counts][inside], return_index=True, return_inverse=True)
        of, ctx = of.astype(np.int32), shorter[begun[inside[first]]]
        del shorter, first
        ctx, ctx_of = np.unique(ctx, return_inverse=True)
        a = np.array([np.bincount(of, u[inside], len(keys)) for u in uses])
        if n < ORDER:  # continuation counts, but of n-grams that begin a word their own
            begins = np.bincount(of, have[inside] > n, len(keys)) == 0
            del of, inside
            longer = np.flatnonzero(have > n).astype(np.int32)
            distinct, one, whose = np.unique(longer_ones[counts][longer], return_index=True, return_inverse=True)
            whose, ends_in = whose.astype(np.int32), np.searchsorted(keys, same[counts][longer[one]])
            kinds = np.array([np.bincount(ends_in, np.bincount(whose, u[longer], len(distinct)) > 0, len(keys)) for u in uses])
            a = np.where(begins, a, kinds)
            del whose, distinct, one, longer, ends_in, kinds
        shorter, same = same, longer_ones
        if n <= SHARED:
            a = np.array([a.sum(0)] * 2)
        total = np.array([np.bincount(ctx_of, x, len(ctx)) for x in a])
        less = taken[np.minimum(a, 3).astype(np.int8)]
        safe = np.maximum(total, 1e-9)
        own = (a - less) / safe[:, ctx_of]
        left = np.where(total > 0, np.array([np.bincount(ctx_of, x, len(ctx)) for x in less]) / safe, 1.0)
        grams.append((keys, own.astype(np.float32)))
        if n == 1:
            rests.append(left)
        else:
            below = grams[n - 1][0]
            rest = np.ones((2, len(below) + (n == 2)), np.float32)
            place = np.searchsorted(below, ctx)
            place[place == len(below)] = 0
            inner = below[place] == ctx
            rest[:, place[inner]] = left[:, inner]
            if n == 2:  # what is left is BEGIN
                rest[:, -1:] = left[:, ~inner]
            rests.append(rest)
    return Ratio(grams, rests, 1 / alphabet)


def fit_logistic(x, y, steps: int = 40, ridge: float = 1e-3):
    """(mean, scale, weights) of a logistic regression by Newton steps."""
    import numpy as np

    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return mean, scale, w


class Words:
    """Remembers the ratios of words."""

    def __init__(self, ratio: Ratio):
        self.ratio, self.cache = ratio, {}

    def features(self, lists: list[list[str]]):
        """For each list of words three comparisons of its likelihoods, each normalised by length:

        the mean of the words' ratios; what ratios have beyond NOISE, added up, by the
        root of the number of words, with which the noise of a sum grows; and the mean of the two
        largest. A word that comes n times counts 1 + log n times in the mean and once elsewhere.
        """
        import numpy as np

        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = [w for w in set().union(*lists) if w not in cache]
        for at in range(0, len(new), 5_000):
            some = new[at : at + 5_000]
            cache.update(zip(some, self.ratio.words(some).tolist(), strict=True))
        rows = np.zeros((len(lists), 3))
        for i, words in enumerate(lists):
            if words:
                counts = Counter(words)
                r = np.minimum(np.fromiter(map(cache.__getitem__, counts), float, len(counts)), CLIP)
                weights = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
                top = np.partition(r, -2)[-2:] if len(r) > 1 else r
                rows[i] = (r * weights).sum() / (weights.sum() + PRIOR), np.maximum(r - NOISE, 0).sum() / (len(r) + PRIOR) ** 0.5, top.sum() / 2
        return rows


class Classifier:
    """score(): 0 to 1 for lists of words."""

    def __init__(self, ratio: Ratio | None, curve: tuple | None, shift: float, share: float):
        """share: of toxic ones among all labelled texts; shift: what the sample's share differs from it by, as logits."""
        self.ratio, self.curve, self.shift, self.share = ratio, curve, shift, share

    def scorer(self):
        """A function from lists of words to their scores, which remembers words as long as it is kept."""
        import numpy as np

        if self.ratio is None:
            return lambda lists: np.full(len(lists), float(self.share))
        words = Words(self.ratio)
        mean, scale, w = self.curve

        def score(lists: list[list[str]]):
            z = (words.features(lists) - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1] + self.shift, -30, 30)))
            return np.where([not x for x in lists], self.share, p)

        return score

    def score(self, lists: list[list[str]]):
        return self.scorer()(lists)


def _counts(found: DataFrame) -> DataFrame:
    """(word, n0, n1, ...): how many texts of found (toxic, fold, text) have each word, by fold and label (n of 2 * fold + label)."""

    def run(batches):
        import pyarrow as pa

        counts = [Counter() for _ in range(2 * FOLDS)]
        for batch in batches:
            for part in common.chunks(batch, limit=1 << 20):
                for toxic, fold, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    counts[2 * fold + toxic].update(set(words_of(text)))
        words = list(set().union(*counts))
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            columns = [pa.array(some, pa.string()), *(pa.array([c[w] for w in some], pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["word", *(f"n{i}" for i in range(2 * FOLDS))]
    made = found.select("toxic", "fold", "text").mapInArrow(common.alone(run), "word string, " + ", ".join(f"{n} long" for n in names[1:]))
    return made.groupBy("word").agg(*(F.sum(n).alias(n) for n in names[1:]))


def _features(found: DataFrame, ratios: list[Ratio]):
    """(features, labels) of the sample's documents, each by the model that has not seen its fold."""
    import numpy as np

    sent = found.sparkSession.sparkContext.broadcast(ratios)  # bounded as the sample is

    def run(batches):
        import pyarrow as pa

        models = [Words(r) for r in sent.value]
        for batch in batches:
            for part in common.chunks(batch, limit=1 << 20):
                toxic, fold, texts = (c.to_pylist() for c in part.columns)
                x = np.array([models[k].features([words_of(t)])[0] for k, t in zip(fold, texts, strict=True)]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), pa.array(toxic, pa.int32())], names=["x0", "x1", "x2", "toxic"])

    # Three numbers and a label for each document of the sample.
    rows = found.select("toxic", "fold", "text").mapInArrow(common.alone(run), "x0 double, x1 double, x2 double, toxic int").toArrow()
    return np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(3)]), rows.column("toxic").to_numpy().astype(float)


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int | None = 2, folds: int = 4) -> Classifier:
    """A classifier from docs (doc_id, text) and labels (doc_id, toxic).

    Rows of one document with several labels count as toxic if one says so.
    Null labels and ids are left out, and ids whose crc32 modulo folds is
    held_out_fold. The sample is bounded, see MAX_DOCS and MAX_CHARS, its texts are read whole and
    all their words count.
    Without both classes every score is the share of toxic labels, 0 without labels.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if held_out_fold is not None:
        usable = usable.where(F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(folds)) != held_out_fold)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    n = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(sum(n.values()), 1)
    none = Classifier(None, None, 0.0, share)
    if not 0 < share < 1:
        return none
    picked = [r for label in (0, 1) for r in usable.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(MAX_DOCS).collect()]
    # At most 2 * MAX_DOCS rows; from Arrow, as a list's rows would go through a second set of Python workers, which stays.
    columns = {"doc_id": pa.array([r["doc_id"] for r in picked], pa.int64()), "toxic": pa.array([r["toxic"] for r in picked], pa.int32()), "fold": pa.array([r["h"] % FOLDS for r in picked], pa.int32())}
    sample = spark.createDataFrame(pa.table(columns))
    found = common.id_text(docs).where(F.length("text") <= MAX_CHARS).join(F.broadcast(sample), "doc_id")
    table = _counts(found).toArrow()
    words = table.column("word").to_pylist()
    uses = np.array([table.column(f"n{i}").to_numpy() for i in range(2 * FOLDS)]).reshape(FOLDS, 2, -1)
    if not words or not (uses.sum((0, 2)) > 0).all():
        return none
    del table
    ratios = []
    for k in range(FOLDS):
        ratios.append(fit_ratio(words, uses.sum(0) - uses[k]))
        common.release()
    x, y = _features(found, ratios)
    del ratios
    if not 0 < y.sum() < len(y):
        return none
    have = y.mean()
    shift = float(np.log(share / (1 - share)) - np.log(have / (1 - have)))
    made = Classifier(fit_ratio(words, uses.sum(0)), fit_logistic(x, y), shift, share)
    del words, uses
    common.release()
    return made


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) of every row of docs. A null or empty text, or one
    without words, scores the share of toxic labels; null ids and repeated rows
    are kept; an empty table gives an empty one; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded as the sample is

    def run(batches):
        import pyarrow as pa

        score = sent.value.scorer()
        for batch in batches:
            for part in common.chunks(batch, limit=1 << 20):
                scores = score([words_of(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return common.id_text(docs).mapInArrow(common.alone(run), "doc_id long, score double")


def keep_ordinary(docs: DataFrame, classifier: Classifier, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score below threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded as the sample is

    def run(batches):
        import pyarrow as pa

        score = sent.value.scorer()
        for batch in batches:
            for part in common.chunks(batch, limit=1 << 20):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array(score([words_of(t or "") for t in texts]) < threshold))

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(common.alone(run), docs.schema)
