"""The class-conditional models against Kneser-Ney spelled out with dictionaries."""

import math
import random
from collections import defaultdict

import numpy as np

from trisearch.llm import toxicity as T


def plain(words, uses):
    """A function from a word to its log-likelihood ratio."""
    counts, shown = [defaultdict(lambda: [0, 0]) for _ in range(T.ORDER + 2)], set()
    for w, *u in zip(words, *uses):
        text = T.BEGIN + w + T.END
        shown |= set(text)
        for end in range(2, len(text) + 1):
            for n in range(1, min(end, T.ORDER + 1) + 1):
                for k in (0, 1):
                    counts[n][text[end - n : end]][k] += u[k]
    tables = [None]
    for n in range(1, T.ORDER + 1):
        table = {}
        for g, c in counts[n].items():
            if n < T.ORDER and g[0] != T.BEGIN:
                c = [sum(h[1:] == g and x[k] > 0 for h, x in counts[n + 1].items()) for k in (0, 1)]
            table[g] = [sum(c)] * 2 if n <= T.SHARED else c
        tables.append(table)
    less = lambda x: (0, *T.DISCOUNTS)[min(x, 3)]

    def p(text, end, k):
        found = 1 / (len(shown) + 1)
        for n in range(1, min(end, T.ORDER) + 1):
            context = text[end - n : end - 1]
            after = [c[k] for g, c in tables[n].items() if g[:-1] == context]
            if not after:
                break
            if total := sum(after):
                own = tables[n].get(text[end - n : end], [0, 0])[k]
                found = (own - less(own)) / total + sum(map(less, after)) / total * found
        return found

    def ratio(w):
        text = T.BEGIN + w + T.END
        return sum(math.log(p(text, i, 1) / p(text, i, 0)) for i in range(2, len(text) + 1))

    return ratio


def test_ratios_are_those_of_kneser_ney():
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("abc'é") for _ in range(rnd.randrange(1, 12))) for _ in range(40)})
    uses = np.array([[rnd.choice((0, 0, 1, 2, 5)) for _ in words] for _ in (0, 1)])
    uses[0] += uses.sum(0) == 0
    expected, model = plain(words, uses), T.fit_ratio(words, uses)
    asked = [*words[::3], "z", "abab", "aaaaaaaaaaaaaaaa", "cé'", "q" * 30]
    assert np.allclose(model.words(asked), [expected(w) for w in asked], rtol=1e-4, atol=1e-4)


def test_long_words_are_cut_and_all_of_them_count():
    text = "x" * 150 + " Don't " + "é" * 64
    assert T.words_of(text) == ["x" * 64, "x" * 64, "x" * 22, "don't", "é" * 64]
