"""Encoders against their libraries on characters of all planes and on long runs of one character."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from trisearch.llm import bpe, token_counts

#: Without planes in which nothing is assigned, but for samples of them.
EVERY = [*range(0x20, 0xD800), *range(0xE000, 0x34000), *range(0x34000, 0xE0000, 997), *range(0xE0000, 0xE0200), *range(0xE0200, 0x110000, 997)]


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(open(P.path("byte_bpe_50k.json"), "rb").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def spans():
    return token_counts.SpanEncoder(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())


def ids(codec, text):
    data = codec.encode(text)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_every_character_is_split_as_the_library_does(codec, library):
    # Letters, numbers and signs join the characters beside them; between units are line ends.
    for at in range(0, len(EVERY), 50_000):
        text = "".join(f"x{chr(c)}'s {chr(c)}1!{chr(c)}!\n" for c in EVERY[at : at + 50_000])
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


def test_random_characters(codec, library):
    rnd = random.Random(8)
    newer = list(codec.other)
    assert newer
    for _ in range(3000):
        text = "".join(rnd.choice([chr(rnd.choice(EVERY)), chr(rnd.choice(newer)), rnd.choice("a1 '!\n\t")]) for _ in range(12))
        assert ids(codec, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [c * 3000 + tail for c in " \n　a1!" for tail in ("", "x", "\t!", " 's")] + ["a  " + " \n" * 2500 + "b" + "\t" * 2047 + "c" + " " * 2049])
def test_long_runs_are_encoded_as_the_library_does(spans, text):
    assert spans.ids(text) == spans.encoding.encode_ordinary(text)


def test_very_long_texts(codec, spans):
    blank = " " * 2_000_000 + "a"
    found = spans.ids(blank)
    assert sum(spans.bytes[found]) == len(blank) and spans.encoding.decode(found) == blank
    for c in "a1!":
        text = c * 1_000_000
        assert codec.decode(ids(codec, text)) == text and spans.encoding.decode(spans.ids(text)) == text


def test_sections_of_a_blank_text(spark):
    docs = spark.createDataFrame([(1, " " * 300_000 + "a\nb"), (2, "\n" * 300_000)], "doc_id long, text string")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.section_counts(docs, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert got.keys() == {(1, -1), (1, 0), (1, 1), (2, -1)} and got[1, 0] > 0 and got[2, -1] > 0
