"""Scores of the lattice operator spelled out, and very long words."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from trisearch.llm import lattice

DATA = open(P.path("piece_bpe_32k.model"), "rb").read()


def paths(model, text):
    """The log10 of the sum over all segmentations of a word, place by place with exact scaling."""
    import sentencepiece

    names = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    weight = {names.id_to_piece(i): 1 / (10 - min(names.get_score(i), 0)) for i in range(3, names.get_piece_size())}
    total = sum(weight.values())
    sums = [0.0]
    for j in range(1, len(text) + 1):
        some = []
        for n in range(1, min(j, lattice.PIECE) + 1):
            piece = text[j - n : j]
            p = 0.7 * weight.get(piece, 0) / total
            if n == 1:
                p += math.prod(0.7 * weight[f"<0x{b:02X}>"] / total for b in piece.encode())
            if p:
                some.append(sums[j - n] + math.log(p))
        most = max(some)
        sums.append(most + math.log(sum(math.exp(x - most) for x in some)))
    return (sums[-1] + math.log(0.3 / 0.7)) / math.log(10)


def test_long_words_in_strips(monkeypatch):
    rnd = random.Random(3)
    model = lattice.Lattice(DATA)
    words = ["".join(rnd.choice("aeinrst日é ") for _ in range(n)).replace(" ", "▁") for n in (5, 40, 300, 5000)]
    whole = model.log10([w.encode() for w in words])
    assert np.allclose(whole, [paths(model, "▁" + w) for w in words])
    monkeypatch.setattr(lattice, "STRIP", 37)
    assert np.allclose(model.log10([w.encode() for w in words]), whole)
    counts = model.expected([w.encode() for w in words[:3]])
    assert 0 < counts.sum() < sum(map(len, words))


def test_a_million_letters():
    model = lattice.Lattice(DATA)
    one, ten = model.log10([b"xyz" * 33_333, b"xyz" * 333_330])
    assert one < -20_000 and math.isclose(ten / one, 10, rel_tol=1e-2)


def test_a_vocabulary_with_longer_pieces_is_refused(monkeypatch):
    monkeypatch.setattr(lattice, "PIECE", 8)
    with pytest.raises(ValueError, match="characters"):
        lattice.Lattice(DATA)


@pytest.mark.parametrize("class_col", ["lang", None])
def test_scores_are_those_of_the_model(spark, monkeypatch, class_col):
    monkeypatch.setattr(lattice, "ROUNDS", 0)
    rnd = random.Random(5)
    vocabulary = {"en": ["the", "word", "and", "Other"], "de": ["der", "und", "wort"], "fr": ["le", "mot"], None: ["nul"]}
    rows = [(i, " ".join(rnd.choice(vocabulary[c]) for _ in range(rnd.randrange(1, 9))), c) for i, c in enumerate(rnd.choice(list(vocabulary)) for _ in range(60))]
    rows += [(100 + i, t, "en") for i, t in enumerate(["ab" * 2500, "", "the unseen wort", "le le le"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in lattice.score(docs, P.path("piece_bpe_32k.model"), class_col=class_col).collect()}

    model, end = lattice.Lattice(DATA), ""
    train = [(t, c if class_col else None) for i, t, c in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    classes = [*sorted({c for _, c in train if c}), None]
    tokens = lambda t: [*t.lower().split(), end]
    counts = {k: Counter(w for t, c in train if c == k for w in tokens(t)) for k in classes}
    every = sum(counts.values(), Counter())
    n, v = sum(every.values()), len(every)
    spell = {}

    def spelled(w):
        if w not in spell:
            spell[w] = math.log10(lattice.END_SHARE) if w == end else float(model.log10([w.encode()])[0]) + math.log10(1 - lattice.END_SHARE)
        return spell[w]

    add = lambda *xs: (m := max(xs)) + math.log10(sum(10 ** (x - m) for x in xs))
    log = lambda x: math.log10(x) if x > 0 else -math.inf

    def word(w, k):
        shared = add(log(max(every[w] - lattice.DISCOUNT, 0) / n), log(lattice.DISCOUNT * v / n) + spelled(w))
        own = sum(counts[k].values())
        if not own:
            return shared
        rest = add(log(lattice.OTHERS) + shared, log(1 - lattice.OTHERS) + spelled(w))
        return add(log(max(counts[k][w] - lattice.DISCOUNT, 0) / own), log(lattice.DISCOUNT * len(counts[k]) / own) + rest)

    docs_of = {k: sum(c == k for _, c in train) for k in classes}
    for i, t, _ in rows:
        expected = add(*(log((docs_of[k] + 1) / (len(train) + len(classes))) + sum(word(w, k) for w in tokens(t)) for k in classes))
        assert math.isclose(got[i], expected, rel_tol=1e-6), (i, t[:30])


def test_too_many_classes_are_an_error(spark):
    docs = spark.createDataFrame([(i, "a b", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="classes"):
        lattice.score(docs, P.path("piece_bpe_32k.model"), max_classes=3)
