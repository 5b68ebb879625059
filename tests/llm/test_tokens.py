"""BPE coding, the token store and section counts against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from trisearch.llm import bpe, token_counts, token_store

TEXTS = ["Hello world, it's 2024!", "", None, "  two  spaces\n\n\ttabs ", "naïve café — 日本語 🙂", "a<|endoftext|>b <|endoftext|>", "<|ENDOFTEXT|> X.,Y 'S don't a.b,c ... ;, x≮y İK ſ Σ ẞ क़", "x" * 3000, "é" * 500, "!!!???", "don't I'LL", "\x1c\x85  end"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "n", 1), (3, TEXTS[3], "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_bpe_round_trip(docs):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path).collect()}
    assert bpe.round_trip(docs, path).count() == len(TEXTS) + 2 and None in got
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), t


def test_bpe_decode(docs):
    path = P.path("byte_bpe_50k.json")
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    assert all(decoded[i] == (t or "") for i, t in enumerate(TEXTS))
    codec, library = bpe.BpeCodec(open(path, "rb").read()), Tokenizer.from_file(path)
    rnd = np.random.default_rng(1)
    for _ in range(50):  # ids whose bytes need be no UTF-8
        ids = rnd.integers(0, 50257, 12).tolist()
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_merges_like_the_library():
    path = P.path("byte_bpe_50k.json")
    codec, library = bpe.BpeCodec(open(path, "rb").read()), Tokenizer.from_file(path)
    rnd = np.random.default_rng(2)
    for _ in range(300):
        text = "".join(rnd.choice(list("aabcdeinrst  'é1.\n"), rnd.integers(1, 40)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_store(spark, docs, tmp_path):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_store.write(docs, str(tmp_path / "t"), path)
    got = token_store.digests(spark, str(tmp_path / "t")).orderBy("start").collect()
    ordered = [(None, "no id")] + sorted([*enumerate(TEXTS), (3, TEXTS[3])], key=lambda r: r[0])
    start = 0
    for r, (i, t) in zip(got, ordered, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    assert token_store.lookup(spark, str(tmp_path / "t"), [0]).first().n_tokens == got[1].n_tokens
    assert token_store.read(spark, str(tmp_path / "t")).count() == len(ordered)


def test_token_store_has_bloom_filters_and_indexes(spark, docs, tmp_path):
    import pyarrow.orc as orc

    token_store.write(docs, str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    files = [orc.ORCFile(p) for p in (tmp_path / "t").glob("*.orc")]
    assert sum(f.nrows for f in files) == len(TEXTS) + 2
    assert all(f.row_index_stride == 1000 for f in files)


def test_word_encoder_is_the_library_for_any_text():
    path = P.path("word_bpe_49k.json")
    encoder, library = token_store.WordEncoder(open(path, "rb").read()), Tokenizer.from_file(path)
    rnd = np.random.default_rng(3)
    alphabet = list("abzEÉßI 'sdtre.,.,  \n-1½٣<|≯́日İΣ&")
    texts = ["".join(rnd.choice(alphabet, rnd.integers(0, 30))) for _ in range(1500)]
    for t, ids in zip(texts, encoder.encode(texts, 1), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.section_counts(empty, P.path("byte_bpe_50k.tiktoken")).count() == 0
    token_store.write(empty, str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    assert token_store.digests(spark, str(tmp_path / "t")).count() == 0


def test_section_counts(docs):
    import regex

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got = {}
    for r in token_counts.section_counts(docs.dropDuplicates(["doc_id"]), P.path("byte_bpe_50k.tiktoken")).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens, r.n_shared)
    for i, t in enumerate(TEXTS):
        t = t or ""
        spans = [m.span() for m in regex.finditer(r"[^\n]+", t)]
        counts, shared = {k: 0 for k in range(-1, len(spans))}, {k: 0 for k in range(-1, len(spans))}
        for a, b in library.encode(t, add_special_tokens=False).offsets:
            held = [max(0, min(b, e) - max(a, s)) for s, e in spans]
            best = held.index(max(held)) if held and max(held) > 0 else -1
            counts[best] += 1
            shared[best] += sum(h > 0 for h in held) > 1
        expected = {k: (*(spans[k] if k >= 0 else (None, None)), counts[k], shared[k]) for k in counts}
        assert got[i] == expected, t


def test_tokens_at_a_boundary():
    found, shared = token_counts.attribute(np.array([0, 2, 5, 9]), np.array([2, 6, 7, 11]), np.array([0, 4, 6]), np.array([3, 6, 8]))
    assert found.tolist() == [0, 1, 1, -1] and shared.tolist() == [False, True, True, False]
