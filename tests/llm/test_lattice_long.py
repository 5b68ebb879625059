"""Scores of words far less likely than a double can hold."""

import public_tokenizers as P
import pytest

from trisearch.llm import lattice


def test_long_words_cost_what_the_lattice_gives(spark):
    word = lambda n: "".join("0a7f3k9z"[i * i * 7 % 31 % 8] for i in range(n))
    sizes = [10, 200, 1000, 5000]
    docs = spark.createDataFrame([(i, word(n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice.score(docs, P.path("piece_bpe_32k.model"), class_col=None, folds=1, held_out=0).collect()}
    # Without training rows a text is its words' lattices and an end.
    model = lattice.Lattice(open(P.path("piece_bpe_32k.model"), "rb").read())
    expected = model.log10([word(n).encode() for n in sizes])
    end = got[0] - expected[0]
    assert all(got[i] == pytest.approx(expected[i] + end, rel=1e-6) for i in got) and -3 < end < 0 and got[3] < -5000
