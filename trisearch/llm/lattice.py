"""Subword lattice likelihood of documents.

A word's lattice holds every segmentation into pieces of an existing vocabulary,
weighted by the vocabulary's scores, and one edge for the word as a whole, if
training texts have it. A forward recursion in log space adds up all paths. A
document's probability is that of its words and an end, for each class of training
texts (languages), added up over the classes.

The counts of training words are a table that grows with the corpus. Scoring
never broadcasts it: documents are dealt into buckets of bounded size, each bucket
asks the table for its own distinct words, and the answers meet the bucket's
documents in one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Folds of the ids' crc32 and the one that training leaves out.
FOLDS, HELD_OUT = 5, 1
DISCOUNT = 0.75
#: Of tokens without counts: how likely the end is.
END_SHARE = 0.01
#: Of what a class leaves to unseen words: the part of the other classes' counts; pieces get the rest.
OTHERS = 0.2
#: Rounds of expectation and maximisation for the pieces' scores, from the vocabulary's own, which
#: count as so many words at last.
ROUNDS, PRIOR = 3, 1000
#: Longest piece in characters that a vocabulary may have, and characters of a word that are looked up at a time.
PIECE, STRIP = 16, 4096
#: The end of a text among the tokens, which are never empty.
END = b""


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, in UTF-8, with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Marginal log10 probabilities of words under the scores of a vocabulary's pieces."""

    start = 0x9E3779B97F4A7C15

    def __init__(self, data: bytes):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i)]
        scores = np.array([model.get_score(i) for i in ids])
        # Scores are log probabilities, or else, as in BPE files, ranks with the sign changed.
        weights = np.exp(scores) if scores.min() > -100 else 1 / (10 - np.minimum(scores, 0))
        byte, found = np.full(256, 1e-9), []
        for i, w in zip(ids, weights, strict=True):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte[int(piece[3:5], 16)] = w
            else:
                if len(piece) > PIECE:
                    raise ValueError(f"the vocabulary has a piece of {len(piece)} characters, more than {PIECE}")
                h = np.full(1, self.start, np.uint64)
                for c in reversed(piece):
                    h = self.longer(h, np.array([ord(c)], np.uint64))
                found.append((len(piece), int(h[0]), w))
        found.sort()
        self.pieces = {}  # by length: ascending hashes and the place of the first
        for n in {f[0] for f in found}:
            at = [k for k, f in enumerate(found) if f[0] == n]
            self.pieces[n] = np.array([found[k][1] for k in at], np.uint64), at[0]
        # The weights of the pieces, and last the weight of all bytes together.
        self.prior = np.array([*(f[2] for f in found), byte.sum()]) / (weights.sum() or 1)
        self.byte_share = np.log(byte / byte.sum())
        self.set(self.prior, 0.3)

    def set(self, weights, stop: float) -> None:
        """weights: of the pieces and the bytes; stop: how likely a piece is a word's last."""
        import numpy as np

        self.logs = np.log(weights / weights.sum())
        self.go, self.stop = np.log(1 - stop), np.log(stop)

    @staticmethod
    def longer(h, code):
        """The hash of some characters with one more before them."""
        import numpy as np

        x = (h ^ code) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))

    def log10(self, words: list[bytes]):
        import numpy as np

        found = np.zeros(len(words))
        for some, texts in self._alike(words):
            if len(texts[-1]) > STRIP:
                found[some] = [self._long(t) + self.stop - self.go for t in texts]
                continue
            sizes, _, _, total = self._forward(texts)
            found[some] = total[np.arange(len(texts)), sizes] + self.stop - self.go
        return found / np.log(10)

    def expected(self, words: list[bytes]):
        """How often each piece, and last a byte's character, is used by words, in expectation over their segmentations.
        Words longer than STRIP count as their parts of that length."""
        import numpy as np

        counts = np.zeros(len(self.prior))
        for _, texts in self._alike(words):
            texts = [t[at : at + STRIP] for t in texts for at in range(0, len(t), STRIP)]
            sizes, arcs, places, total = self._forward(texts)
            width, rows = total.shape[1] - 1, np.arange(len(texts))
            rest = np.full(total.shape, -np.inf)
            rest[rows, sizes] = -total[rows, sizes]
            for j in range(width - 1, -1, -1):
                paths = np.stack([arcs[n - 1][:, j + n - 1] + rest[:, j + n] for n in range(1, min(len(arcs), width - j) + 1)])
                most = np.maximum(paths.max(0), -1e300)
                rest[:, j] = np.where(sizes == j, rest[:, j], most + np.log(np.maximum(np.exp(paths - most).sum(0), 1e-300)))
            for n, (arc, place) in enumerate(zip(arcs, places, strict=True), 1):
                share = np.exp(total[:, : width - n + 1] + arc[:, n - 1 :] + rest[:, n:])
                if place is None:
                    continue
                here = place >= 0
                part = share[here] * (np.exp(self.logs[place[here]] + self.go - arc[:, n - 1 :][here]) if n == 1 else 1)
                counts += np.bincount(place[here], part, len(counts))
                if n == 1:
                    counts[-1] += share.sum() - part.sum()
        return counts

    def _alike(self, words: list[bytes]):
        """Groups of words of like length: at most a tenth of padding, about a million characters."""
        texts = ["▁" + w.decode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            to, size = at + 1, len(texts[order[at]])
            while to < len(order) and (n := len(texts[order[to]])) <= size * 1.1 + 1 and (to - at) * n < 500_000:
                to += 1
            some = order[at:to]
            yield some, [texts[i] for i in some]
            at = to

    def _long(self, text: str) -> float:
        """The sum of all paths through a text, strip by strip, as a logarithm."""
        import numpy as np

        # The sums of paths to the last places, the latest first, are kept near 1.
        last, scale = np.zeros(PIECE), 0.0
        last[0] = 1
        for lo in range(0, len(text), STRIP):
            before = min(lo, PIECE - 1)
            arcs, _ = self._arcs([text[lo - before : lo + STRIP]])
            for shares in np.exp(np.concatenate([*arcs, *[np.full_like(arcs[0], -np.inf)] * (PIECE - len(arcs))]).T[before:]):
                now = float(last @ shares)
                scale += np.log(now)
                last[1:] = last[:-1] / now
                last[0] = 1
        return scale

    def _arcs(self, texts: list[str]):
        """The arcs of each length by their end, and their pieces."""
        import numpy as np

        width = max(map(len, texts))
        codes = np.frombuffer("".join([t.ljust(width, "\0") for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width)
        kinds, which = np.unique(codes, return_inverse=True)
        spelled = [sum(self.logs[-1] + self.byte_share[b] + self.go for b in chr(c).encode("utf-8", "surrogatepass")) for c in kinds]
        single = np.array(spelled)[which.reshape(codes.shape)]
        wide = codes.astype(np.uint64)
        arcs, places, h = [], [], np.full(codes.shape, self.start, np.uint64)
        for n in range(1, min(PIECE, width) + 1):
            h = self.longer(h[:, 1:] if n > 1 else h, wide[:, : width - n + 1])
            cost, place = np.full((len(texts), width), -np.inf), None
            if n in self.pieces:
                keys, first = self.pieces[n]
                i = np.searchsorted(keys, h)
                i[i == len(keys)] = 0
                place = np.where(keys[i] == h, i + first, -1)
                cost[:, n - 1 :] = np.where(place >= 0, self.logs[place] + self.go, -np.inf)
            arcs.append(np.logaddexp(cost, single) if n == 1 else cost)
            places.append(place)
        return arcs, places

    def _forward(self, texts: list[str]):
        """The texts' lengths, the arcs of each length by their end, their pieces, and the sums of all paths to each place."""
        import numpy as np

        sizes = np.array(list(map(len, texts)))
        width = int(sizes.max())
        arcs, places = self._arcs(texts)
        total = np.full((len(texts), width + 1), -np.inf)
        total[:, 0] = 0
        for j in range(1, width + 1):
            paths = np.stack([total[:, j - n] + arcs[n - 1][:, j - 1] for n in range(1, min(PIECE, j) + 1)])
            most = paths.max(0)
            total[:, j] = most + np.log(np.exp(paths - most).sum(0))
        return sizes, arcs, places, total


def prepared(vocabulary: tuple, weights: tuple | None) -> Lattice:
    """The worker's lattice with the given pieces' counts and stop probability."""
    import numpy as np

    lattice = common.once(("lattice", vocabulary[0]), lambda: Lattice(vocabulary[1]))
    if weights is None:
        lattice.set(lattice.prior, 0.3)
    elif getattr(lattice, "fitted", None) is not weights:
        counts = PRIOR * lattice.prior
        np.add.at(counts, list(weights[0]), list(weights[0].values()))
        lattice.set(counts, weights[1])
    lattice.fitted = weights
    return lattice


def _token_counts(rows: DataFrame, classes: int) -> DataFrame:
    """(word, c0, c1, ...): how often each token comes in rows (text, class)."""

    def run(batches):
        import pyarrow as pa

        counts = [Counter() for _ in range(classes)]

        def out():
            every = list({w for c in counts for w in c})
            for at in range(0, len(every), 50_000):
                some = every[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([c[w] for w in some], pa.int64()) for c in counts)], names=["word", *(f"c{k}" for k in range(classes))])

        for batch in batches:
            for part in common.chunks(batch):
                for text, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts[k].update(words_of(text))
                    counts[k][END] += 1
            if sum(map(len, counts)) > 400_000:
                yield from out()
                counts = [Counter() for _ in range(classes)]
        yield from out()

    columns = [f"c{k}" for k in range(classes)]
    partial = rows.mapInArrow(run, "word binary, " + ", ".join(f"{c} long" for c in columns))
    return partial.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", class_col: str | None = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, max_classes: int = 64) -> DataFrame:
    """Scores every row of docs (doc_id, text), learning from those whose crc32 of the id modulo folds is not held_out.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; see
    the module for score and the README for base_score. A null text is empty, and
    an empty one has its end as only token; a null id counts as an empty one for the fold; a null class
    is one of its own; more than max_classes are an error, as each has a column of counts; repeated rows are scored and learned from each; without
    training rows base_score is 0 for every text and score rests on the vocabulary
    alone; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = common.send_file(spark, vocabulary)
    out = F.pmod(common.crc_of_id(F.col(id_col).cast("long")), F.lit(folds)) == held_out
    label = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), label.alias("class"), out.alias("held_out"))

    names = sorted(r["class"] for r in rows.where(~F.col("held_out") & F.col("class").isNotNull()).select("class").distinct().limit(max_classes + 1).collect())
    if len(names) > max_classes:
        raise ValueError(f"more than {max_classes} classes: name a coarser column, none, or a larger bound")
    index = F.coalesce(*(F.when(F.col("class") == n, k) for k, n in enumerate(names)), F.lit(len(names)))
    classes = len(names) + 1
    train = rows.where(~F.col("held_out")).select("text", index.cast("int").alias("k"))

    counts = _token_counts(train, classes)
    path = common.scratch(spark, "words")
    counts.write.parquet(path)
    table = spark.read.schema(counts.schema).parquet(path)
    own = [f"c{k}" for k in range(classes)]
    every = sum((F.col(c) for c in own), F.lit(0))
    totals = table.agg(F.count("*").alias("v"), *(F.sum(c).alias(c) for c in own), *(F.count_if(F.col(c) > 0).alias(f"t{k}") for k, c in enumerate(own)), *(F.sum(F.when(F.col("word") == F.lit(END), F.col(c))).alias(f"d{k}") for k, c in enumerate(own))).first()
    n_k, t_k, d_k = ([totals[f"{x}{k}"] or 0 for k in range(classes)] for x in "ctd")
    n, v = sum(n_k), totals["v"]

    def used(batches):
        import numpy as np
        import pyarrow as pa

        lattice = prepared(sent.value, weights)
        counts, words = np.zeros(len(lattice.prior)), 0
        for batch in batches:
            some = [w for w in batch.column(0).to_pylist() if w != END]
            counts, words = counts + lattice.expected(some), words + len(some)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*counts[at], words], pa.float64())], names=["piece", "n"])

    # The pieces' scores fit the training words, each word once: frequent words have edges of their own.
    weights = None
    for _ in range(ROUNDS if v > 1 else 0):
        # A row for each piece of the vocabulary at most.
        found = {r["piece"]: r["n"] for r in table.select("word").mapInArrow(used, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        n_words = found.pop(-1)
        weights = (found, n_words / max(sum(found.values()), n_words + 1))

    def spelled(batches):
        import pyarrow as pa

        lattice = prepared(sent.value, weights)
        for batch in batches:
            logs = lattice.log10(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float32())], names=[*batch.schema.names, "spelled"])

    table = common.stored(table.mapInArrow(spelled, ", ".join(["word binary", *(f"{c} long" for c in own), "spelled float"])), "spelled")

    size = common.text_bytes(rows)
    buckets = common.tasks_for(spark, size)
    dealt = rows.select("doc_id", "text", "held_out", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket")).repartition(buckets, "bucket")

    def distinct(batches):
        import pyarrow as pa

        seen: dict[int, set] = defaultdict(set)
        for batch in batches:
            for part in common.chunks(batch):
                for text, b in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    seen[b].update(words_of(text))
        for b, words in seen.items():
            words = [END, *words]
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["bucket", "word"])

    asked = dealt.mapInArrow(distinct, "bucket int, word binary")
    answers = asked.join(table, "word", "left").select("bucket", "word", "spelled", *(F.coalesce(c, F.lit(0)).alias(c) for c in own), F.coalesce(every, F.lit(0)).alias("c"))

    def meet(documents, words):
        import numpy as np
        import pyarrow as pa

        lattice = prepared(sent.value, weights)
        keys = words.column("word").to_pylist()
        place = {w: i for i, w in enumerate(keys)}
        c = words.column("c").to_numpy().astype(float)
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        logs = words.column("spelled").to_numpy().astype(float)
        new = np.flatnonzero(np.isnan(logs))  # words that training has not seen
        logs[new] = lattice.log10([keys[i] for i in new])
        # Natural logarithms: long words are far less likely than a double can hold.
        spell = logs * np.log(10) + np.log(1 - END_SHARE)
        if END in place:
            spell[place[END]] = np.log(END_SHARE)
        with np.errstate(divide="ignore"):
            shared = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / n), np.log(DISCOUNT * v / n) + spell) if n else spell
            logs = np.zeros((classes, len(keys)))
            for k in range(classes):
                c_k = words.column(f"c{k}").to_numpy().astype(float)
                rest = np.logaddexp(np.log(OTHERS) + shared, np.log(1 - OTHERS) + spell)
                p = np.logaddexp(np.log(np.maximum(c_k - DISCOUNT, 0) / n_k[k]), np.log(DISCOUNT * t_k[k] / n_k[k]) + rest) if n_k[k] else shared
                logs[k] = p / np.log(10)
        prior = np.log10((np.array(d_k, float) + 1) / (sum(d_k) + classes))
        result = []
        ids, texts = documents.column("doc_id"), documents.column("text")
        for text in texts:
            at = np.fromiter(map(place.__getitem__, [*words_of(text.as_py()), END]), np.int64)
            by_class = prior + logs[:, at].sum(1)
            most = by_class.max()
            result.append((len(at), int((c[at] > 0).sum()), float(base[at].sum()), float(most + np.log10((10.0 ** (by_class - most)).sum()))))
        n_tokens, n_known, base_score, total = zip(*result, strict=True)
        return pa.table({"doc_id": ids, "held_out": documents.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(result), pa.int64()), "base_score": pa.array(base_score), "score": pa.array(total)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(meet, schema)
