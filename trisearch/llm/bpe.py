"""BPE encoding and decoding.

A word of the pre-tokeniser is a doubly linked list of symbols. A heap holds
the merges that its neighbours allow, lowest rank first and leftmost among
equals; an entry whose pair has changed since it was pushed is stale and is
skipped. Decoding joins the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from . import common

#: The pre-tokeniser's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of which a Python worker remembers the ids; beyond, it starts anew.
CACHE_WORDS = 700_000
#: Longer words are not remembered.
CACHE_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable and not a space, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def stand_ins() -> dict[int, str]:
    """For characters that the regex package takes for letters or numbers and the library,
    which knows an older Unicode, does not, or not for the same: one that both take for what the library does."""
    import regex
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    some = "".join(regex.findall(r"[\p{L}\p{N}]", every))

    def taken(kind: str) -> set[str]:
        return {c for part, _ in pre_tokenizers.Split(Regex(rf"[^{kind}]+"), "removed").pre_tokenize_str(some) for c in part}

    found = {}
    for kind, like in ((r"\p{L}", "ж"), (r"\p{N}", "²")):
        here = taken(kind)
        found |= {ord(c): like for c in here.difference(regex.findall(kind, some))}
        found |= {ord(c): "§" for c in set(regex.findall(kind, some)) - here if ord(c) not in found}
    return found


def _one_of(codes) -> re.Pattern:
    """Finds one of some characters."""
    codes, ranges = sorted(codes), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else r"(?!)")


class BpeCodec:
    """Encodes and decodes with a byte-level BPE vocabulary file (JSON)."""

    def __init__(self, data: bytes):
        import regex

        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.first = [vocab[c] for c in alphabet]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.other = stand_ins()
        self.odd = _one_of(self.other)
        self.cache: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols that are left when no merge applies; symbols is used up."""
        n, rank, made = len(symbols), self.rank, self.made
        if n == 1:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), 1 << 32)
            if symbols[i] < 0 or (j := after[i]) == n or rank.get(symbols[i] << 32 | symbols[j]) != r:
                continue  # stale
            symbols[i], symbols[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            if (p := before[i]) >= 0 and (r := rank.get(symbols[p] << 32 | symbols[i])) is not None:
                heappush(heap, r << 32 | p)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        first = self.first
        ids = self.merge([first[b] for b in word.encode()])
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def split(self, text: str) -> list[str]:
        """The words of the pre-tokeniser."""
        if text.isascii() or not self.odd.search(text):
            return self.words.findall(text)
        return [text[slice(*m.span())] for m in self.words.finditer(text.translate(self.other))]

    def plain(self, text: str) -> bytes:
        cache, out = self.cache, []
        for w in self.split(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.parts is None or not any(t in text for t in self.special):
            return self.plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.plain(p) for p in self.parts.split(text) if p)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def _map(docs: DataFrame, vocabulary: str, row, schema: str) -> DataFrame:
    """doc_id and row(codec, text), values of schema, for each row of docs."""
    import pyarrow as pa

    sent = common.send_file(docs.sparkSession, vocabulary)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]

    def run(batches):
        codec = common.once(("bpe", sent.value[0]), lambda: BpeCodec(sent.value[1]))
        for batch in batches:
            for part in common.chunks(batch):
                made = zip(*(row(codec, t) for t in part.column(1).to_pylist()), strict=True)
                columns = [pa.array(c, f.type) for c, f in zip(made, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(f.name for f in fields)])

    return common.id_text(docs).mapInArrow(common.alone(run, ("bpe", sent.value[0])), f"doc_id long, {schema}")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs (doc_id, text).

    ids is binary: little-endian unsigned 32-bit integers. A null or empty text
    has no ids; a null doc_id stays null; repeated rows each give a row; an
    empty table gives an empty one; other columns are ignored.
    """
    return _map(docs, vocabulary, lambda codec, text: (len(ids := codec.encode(text)) // 4, ids), "n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of every row of encoded (doc_id, ids) as encode() gives
    them. Null ids count as none and give an empty text."""
    sent = common.send_file(encoded.sparkSession, vocabulary)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codec = common.once(("bpe", sent.value[0]), lambda: BpeCodec(sent.value[1]))
        for batch in batches:
            for part in common.chunks(batch, "ids"):
                texts = [codec.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(common.alone(run, ("bpe", sent.value[0])), "doc_id long, text string")


def _round_trip(codec: BpeCodec, text: str):
    import numpy as np

    ids = codec.encode(text)
    decoded = codec.decode(np.frombuffer(ids, "<u4").tolist())
    return len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs:
    encoded, then decoded from the ids, in one pass and without a shuffle. Nulls
    and repeated rows are as in encode()."""

    def row(codec, text):
        n, _, ids_sha256, decoded_sha256 = _round_trip(codec, text)
        return n, ids_sha256, decoded_sha256

    return _map(docs, vocabulary, row, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_check(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As round_trip(), with ids before the digests, as encode() gives them."""
    return _map(docs, vocabulary, _round_trip, "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
