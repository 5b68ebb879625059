"""Benchmark decontamination of items whose parts stand in another order, against brute force."""

import random
from collections import Counter

from trisearch.llm import decontaminate


def grams(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_swapped_parts_are_found(spark):
    rnd = random.Random(5)
    some = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items, rows = [], []
    for i, (size, cut) in enumerate([(60, 12), (60, 18), (60, 30), (100, 20), (100, 50), (200, 40), (200, 100)]):
        item = some(size)
        items.append((i, item))
        swapped = item[cut:] + item[:cut]
        rows += [(10 * i, some(25) + swapped + some(14)), (10 * i + 1, swapped), (10 * i + 2, some(9) + swapped + item + some(3)), (10 * i + 3, some(4) + item[3:]), (10 * i + 4, item[: size - 5]), (10 * i + 5, some(30) + item[: size - 8])]
    expected = {}
    for d, w in rows:
        for i, item in items:
            for s in range(len(w)):
                x, y = grams(w[s : s + len(item)]), grams(item)
                v = sum((x & y).values()) / sum((x | y).values())
                if v >= 0.8 and v > expected.get((d, i), (0,))[0]:
                    expected[d, i] = (v, s)
    assert {(10 * i, i) for i in range(7)} <= expected.keys()
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.leaks(docs, bench).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k][0] - expected[k][0]) < 1e-12 and found[k][1] == expected[k][1] for k in found)
