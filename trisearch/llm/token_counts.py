"""Token counts of a document's sections.

A whole document is encoded once. The ids' byte lengths, added up, give each
token's characters; an interval join of those spans with the sections' spans
counts the tokens of each section.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame

from . import common
from .bpe import PATTERN

#: Sections of a text: its lines without line ends; empty lines are none.
LINES = r"[^\n]+"
#: White space from so many characters on is encoded apart: to step back from its end,
#: as the pattern asks, the library needs a stack that grows with it.
BLANK = 2048


class SpanEncoder:
    """Ids with their spans, from a tiktoken vocabulary file."""

    def __init__(self, data: bytes):
        import numpy as np
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("spans", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = tiktoken.Encoding("blank", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens={})
        self.long = regex.compile(rf"\s{{{BLANK},}}+")
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)

    def ids(self, text: str) -> list[int]:
        """As encode_ordinary() of the library gives them."""
        found, at = [], 0
        for m in self.long.finditer(text):
            # The last character of white space goes with the word after it.
            end = m.end() - (m.end() < len(text))
            found += self.encoding.encode_ordinary(text[at : m.start()])
            found += self.blank.encode_ordinary(text[m.start() : end])
            at = end
        return found + self.encoding.encode_ordinary(text[at:])

    def spans(self, text: str):
        """(start, end) of each token in characters; a token of a part of a
        character covers that character."""
        import numpy as np

        ids = np.array(self.ids(text), np.int64)
        ends = np.cumsum(self.bytes[ids])
        starts = ends - self.bytes[ids]
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) == len(text):
            return starts, ends
        at = np.cumsum((data & 0xC0) != 0x80) - 1  # each byte's character
        return at[starts], at[ends - 1] + 1


def attribute(starts, ends, left, right):
    """For each token span the number of its section, -1 if it meets none.

    left and right: the sections' spans, in order and apart from each other. A
    token goes to the section that holds most of its characters, to the earlier
    of equal ones.
    """
    import numpy as np

    low, high = np.searchsorted(right, starts, "right"), np.searchsorted(left, ends, "left")
    found = np.where(low < high, low, -1)
    for i in np.flatnonzero(high - low > 1):
        shares = np.minimum(right[low[i] : high[i]], ends[i]) - np.maximum(left[low[i] : high[i]], starts[i])
        found[i] = low[i] + int(np.argmax(shares))
    return found, high - low > 1


def section_counts(docs: DataFrame, vocabulary: str, sections: str = LINES) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_shared) of each section of docs (doc_id, text).

    Sections are the matches of a pattern, numbered from 0, with the characters
    [start, end). n_tokens: the tokens that go to it, see attribute(); n_shared:
    those of them that other sections hold too. Section -1 has the tokens that meet no section,
    with null start and end. So a document's n_tokens add up to its token count.
    A null or empty text has one row, section -1 with 0 tokens, as has every text
    otherwise; null doc_ids and repeated rows are kept; an empty table gives an
    empty one; other columns are ignored.
    """
    sent = common.send_file(docs.sparkSession, vocabulary)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        encoder = common.once(("spans", sent.value[0]), lambda: SpanEncoder(sent.value[1]))
        pattern = regex.compile(sections)
        for batch in batches:
            for some in common.chunks(batch, limit=1 << 20):
                rows, columns = [], []
                for text in some.column(1).to_pylist():
                    spans = np.array([m.span() for m in pattern.finditer(text) if m.end() > m.start()], np.int64).reshape(-1, 2)
                    found, shared = attribute(*encoder.spans(text), spans[:, 0], spans[:, 1]) if text else (np.zeros(0, np.int64), np.zeros(0, bool))
                    k = len(spans) + 1
                    columns.append((np.arange(-1, k - 1), np.insert(spans[:, 0], 0, -1), np.insert(spans[:, 1], 0, -1), np.bincount(found + 1, minlength=k), np.bincount(found[shared] + 1, minlength=k)))
                    rows.append(k)
                section, start, end, n, shared = (np.concatenate(c).astype(np.int64) for c in zip(*columns, strict=True))
                ids = some.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                none = section < 0
                yield pa.RecordBatch.from_arrays([ids, pa.array(section), pa.array(start, mask=none), pa.array(end, mask=none), pa.array(n), pa.array(shared)], names=["doc_id", "section", "start", "end", "n_tokens", "n_shared"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_shared long")
