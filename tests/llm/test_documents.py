"""The operators on texts, against brute force on small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from trisearch.llm import decontaminate, graph, jaccard_join, lattice, licenses, toxicity

WORDS = [f"w{i}" for i in range(400)]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def near(rnd, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return " ".join(words)


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3), (7, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    assert got == union_find({n for p in real for n in p}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# N-gram Jaccard join


def jaccard_brute(rows):
    """doc_id -> (n_shingles, component) of rows with distinct ids."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        k = min(5, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    ids = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = union_find(ids, pairs)
    return {i: (len(sets[i]), found[i]) for i in ids}


def jaccard_rows():
    rnd = random.Random(7)
    rows = []
    for size in (1, 3, 5, 6, 8, 9, 12, 30, 80, 200):
        base = sentence(rnd, size)
        rows += [base, base.upper(), base.replace(" ", "\t\n")]
        rows += [near(rnd, base, e) for e in (1, 1, 2, 3)] + [base + " " + sentence(rnd, max(1, size // 8)) for _ in range(2)]
        rows += [sentence(rnd, size)]
    passage = sentence(rnd, 60)
    rows += [f"{passage} {sentence(rnd, rnd.choice((4, 8, 14, 60)))}" for _ in range(40)]
    hub = sentence(rnd, 120)
    rows += [near(rnd, hub, rnd.choice((1, 2, 3))) for _ in range(60)]
    rows += ["", None, "  \t ", "a b c", "É e", "x " * 9000]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("boundary", [None, 3, 40])
def test_jaccard_join(spark, boundary, monkeypatch):
    if boundary:
        monkeypatch.setattr(jaccard_join, "boundary_by_cost", lambda *a, **k: boundary)
    rows = jaccard_rows()
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, node string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_join_nulls_and_repeats(spark):
    t = sentence(random.Random(3), 20)
    rows = [(None, t), (5, t), (5, t), (9, t + " extra"), (None, "alone " + t[::-1]), (7, None), (7, "other " * 3)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (9, 5), (None, None), (7, 7), (7, 7)], key=str)
    assert jaccard_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = jaccard_rows()
    expected = jaccard_brute(rows)
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in rows], "doc_id long, text string, group_id long")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if c == i)
    t = sentence(random.Random(3), 20)
    odd = spark.createDataFrame([(None, t), (5, t), (5, t), (5, t + " more"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(odd).collect()), key=str) in ([(5, t), (None, None), (None, None)], [(5, t + " more"), (None, None), (None, None)])


def test_bitmaps_bound_the_overlap():
    rnd = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 120), (1500, 700), (9000, 9000)):
        x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rnd.integers(0, 2**63, m).astype(np.uint64)]))
        assert jaccard_join.differing(jaccard_join.bitmap_of(x), jaccard_join.bitmap_of(y)) <= len(np.setxor1d(x, y))


# Benchmark decontamination


def test_decontamination(spark):
    rnd = random.Random(11)
    items = [(i, sentence(rnd, rnd.choice((4, 14, 30, 59)))) for i in range(20)] + [(90, None), (91, " ! "), (92, "one two three")]
    rows = [(i, sentence(rnd, 80)) for i in range(20)]
    for i, (_, t) in enumerate(items[:20]):
        rows.append((100 + i, f"{sentence(rnd, 30)} {t} {sentence(rnd, 12)}"))
        rows.append((200 + i, t.upper().replace(" ", ", ")))
        rows.append((300 + i, f"{sentence(rnd, 3)} {' '.join(t.split()[1:])} {sentence(rnd, 5)}"))
        rows.append((400 + i, f"{t} {t}"))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, "One. Two? three"), (503, "one two")]

    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    expected = {}
    for d, t in rows:
        w = words(t)
        for i, item in items:
            b = words(item)
            for s in range(max(1, len(w) - len(b) + 1)) if w and b else ():
                x, y = grams(w[s : s + len(b)]), grams(b)
                v = sum((x & y).values()) / sum((x | y).values())
                if v >= 0.8 and v > expected.get((d, i), (0,))[0]:
                    expected[d, i] = (v, s)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.leaks(docs, bench).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k][0] - expected[k][0]) < 1e-12 and got[k][1] == expected[k][1] for k in got)
    leaked = {d for d, _ in expected}
    assert sorted((r.doc_id for r in decontaminate.clean(docs, bench).collect()), key=str) == sorted((d for d, _ in rows if d not in leaked), key=str)


def test_decontamination_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    bench, no_bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, no_bench).count() == decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.clean(docs, no_bench).count() == 1 and decontaminate.leaks(docs, bench).count() == 1


def test_blocks_meet_within_the_radius(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randrange(0, 21)):
            b ^= 1 << bit
        signed = [x - (1 << 64) if x >> 63 else x for x in (a, b)]
        rows.append(tuple(signed))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a long, b long")
    blocks, probes = decontaminate.blocks(F.col("a"), 20), decontaminate.probes(F.col("b"), 20)
    assert df.where(F.arrays_overlap(blocks, probes)).count() == 200
    # The first block in which they meet is one of those in which they do.
    first = decontaminate.first_block(F.col("a").bitwiseXOR(F.col("b")), 20)
    assert df.where(F.array_min(F.transform(F.array_intersect(blocks, probes), lambda x: x["block"])) == first).count() == 200


def test_simhash_and_similarity(spark):
    rnd = random.Random(3)
    rows = [([rnd.getrandbits(64) - (1 << 63) for _ in range(n)], [rnd.randrange(9) for _ in range(m)], [rnd.randrange(9) for _ in range(k)]) for n, m, k in ((1, 4, 9), (2, 30, 7), (255, 1, 1), (256, 5, 40), (700, 60, 60))]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "h array<bigint>, x array<bigint>, y array<bigint>").select("h", F.sort_array("x").alias("x"), F.sort_array("y").alias("y"))
    for r in df.select("h", "x", "y", decontaminate.simhash(F.col("h")).alias("s"), decontaminate.weighted_jaccard("x", "y").alias("j")).collect():
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        x, y = Counter(r.x), Counter(r.y)
        assert r.s % (1 << 64) == bits and abs(r.j - sum((x & y).values()) / sum((x | y).values())) < 1e-12


# Licences


def test_licenses(spark):
    grant, condition = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-condition"]
    rows = [
        (1, "Text here. Licensed under the Apache License, Version 2.0. More text."),
        (2, f"{grant}\n\n{condition}\nEnd"),
        (3, f"{grant}\nSomething else.\n{condition}"),
        (4, "released   under the\tMIT license!\nAll rights reserved."),
        (5, "no licence"),
        (6, ""),
        (7, None),
        (None, "All rights reserved."),
        (1, "Text here. Licensed under the Apache License, Version 2.0. More text."),
        (8, "x\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
    ]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.sentences, r.licenses, r.license) for r in licenses.recognise(docs).collect()), key=str)
    apache = (1, "apache-2.0-notice", "Apache-2.0", "Apache-2.0")
    assert got == sorted(
        [apache, apache, (2, "mit-grant mit-condition", "MIT", "MIT"), (3, "mit-grant mit-condition", "", None), (4, "mit-notice rights-reserved", "MIT all-rights-reserved", "MIT"), (None, "rights-reserved", "all-rights-reserved", "all-rights-reserved"), (8, "cc-by-nc-4.0-notice gpl-3.0-notice", "GPL-3.0 CC-BY-NC-4.0", "GPL-3.0")],
        key=str,
    )
    assert licenses.recognise(docs.limit(0)).count() == 0


# Lattice


def test_lattice_adds_up_all_segmentations():
    import sentencepiece

    data = open(P.path("piece_bpe_32k.model"), "rb").read()
    model = lattice.Lattice(data)
    names = sentencepiece.SentencePieceProcessor(model_proto=data)
    weight = {}
    for i in range(3, names.get_piece_size()):
        weight[names.id_to_piece(i)] = 1 / (10 - min(names.get_score(i), 0))
    total = sum(weight.values())
    byte = {int(k[3:5], 16): v / total for k, v in weight.items() if k.startswith("<0x") and len(k) == 6}

    def brute(text):
        sums = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            for n in range(1, min(j, lattice.PIECE) + 1):
                piece = text[j - n : j]
                p = 0.7 * weight.get(piece, 0) / total
                if n == 1:
                    p += math.prod(0.7 * byte[b] for b in piece.encode())
                sums[j] += sums[j - n] * p
        return math.log10(sums[-1] * 0.3 / 0.7)

    words = ["the", "thonmaarat", "über", "日本語", "x" * 40, "anblewh,", "🙂", "a"]
    assert np.allclose(model.log10([w.encode() for w in words]), [brute("▁" + w) for w in words])
    counts = model.expected([w.encode() for w in words])
    assert counts.min() >= 0 and len(words) < counts.sum() < sum(map(len, words)) + 20


def test_lattice_scores(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["Alpha", "beta", "gamma,", "delta"] if i % 2 else ["uno", "dos", "tres"]) for _ in range(rnd.randrange(1, 30))), "en" if i % 2 else "es") for i in range(80)]
    rows += [(80, None, "en"), (81, "", None), (82, "unseen zzz q", "xx"), (None, "beta uno", "en"), (3, rows[3][1], "en")]
    docs = spark.createDataFrame([(i, t, c, 1.0) for i, t, c in rows], "doc_id long, text string, lang string, score double")
    got = lattice.score(docs, P.path("piece_bpe_32k.model")).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(-1e6 < r.score < 0 for r in got)
    known = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_lattice_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    ids = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 2 == 0]
    got = lattice.score(docs, P.path("piece_bpe_32k.model"), class_col=None, folds=1, held_out=0).collect()
    assert [(r.base_score, r.train_tokens, r.held_out) for r in got] == [(0.0, 0, True)] * 2 and ids is not None
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice.score(docs.limit(0), P.path("piece_bpe_32k.model"), class_col=None).count() == 0


# Toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(9)
    syllables = ["ba", "do", "ki", "lu", "mer", "non", "pa", "ri", "so", "tu"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rnd.randrange(20, 120))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "grobx" + word(), "grobx" + word()]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, labelled):
    rows, labels = labelled
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    kept = {r.doc_id for r in toxicity.keep_ordinary(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.3}


def test_toxicity_of_odd_rows(spark, labelled):
    rows, labels = labelled
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 7), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "x", 0.5), (3, "!!!", 0.5), (4, "a" * 100_000, 0.5), (4, "idiot", 0.5), (4, "idiot", 0.5)], "doc_id long, text string, score double")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 7 and {r.score for r in got if r.doc_id in (1, 2)} == {model.share}
    assert toxicity.score(odd.limit(0), model).count() == 0
    for empty in (spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")):
        assert {r.score for r in toxicity.score(odd, toxicity.train(odd, empty)).collect()} == {0.0}
