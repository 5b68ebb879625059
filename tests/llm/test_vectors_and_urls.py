"""Embedding near-duplicates and URL filtering."""

import math

import numpy as np
import pytest

from trisearch.llm import embedding_dedup, url_filter


def vectors(seed=1, n=120, dims=16):
    rnd = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rnd.normal(size=dims)
        for _ in range(rnd.integers(1, 4)):
            x = base + rnd.normal(size=dims) * rnd.choice([0, 0.05, 0.15])
            rows.append((len(rows), [float(v) for v in x.astype(np.float32)], int(rnd.integers(0, 3))))
    return rows


def brute(rows):
    good = {i: np.array(x, float) / np.linalg.norm(x) for i, x, label in rows if label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)}
    label = {i: y for i, _, y in rows}
    links = {i: set() for i, _, _ in rows}
    for a in good:
        for b in good:
            if a != b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98:
                links[a].add(b)
    component = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in links[todo.pop()] if not (x in seen or seen.add(x))]
        component[i] = min(seen)
    return {i: (len(links[i]), component[i], component[i] == i) for i in links}


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_near_duplicates(spark):
    rows = vectors()
    copies = [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [1.0, None] * 8, 1), (2005, [float("inf")] * 16, 1), (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1), (2009, [2.0, 4.0], 1)]
    every = rows + copies + odd
    expected = brute(every)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(every, SCHEMA)).collect()}
    links = sum(e[0] for e in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in expected) and sum(g[0] for g in got.values()) >= 0.95 * links
    assert all(got[i] == expected[i] for i in range(2000, 2010))
    assert sum(got[i] == expected[i] for i in expected) >= 0.95 * len(expected)


def test_null_ids_and_repeated_rows(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(None, x, 1), (4, x, 1), (4, x, 1), (None, [3.0, -1.0, 0.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kept string")).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, False)], key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rotation_is_orthogonal_and_codes_are_balanced():
    rnd = np.random.default_rng(2)
    x = embedding_dedup.unit(rnd.normal(size=(2000, 32)) * np.linspace(3, 0.2, 32))
    q = embedding_dedup.learn(x)
    assert np.allclose(q.turn[:, :32].T @ q.turn[:, :32], np.eye(32), atol=1e-9)
    bits = ((x - q.mean) @ q.turn > 0).mean(0)
    assert abs(bits - 0.5).max() < 0.15 and q.turn.shape == (32, embedding_dedup.BITS)
    assert len(np.unique(q.codes(x))) > 1500


@pytest.mark.parametrize("dims", [2, 16, 64, 100])
def test_codes_of_any_size_select(spark, dims):
    rnd = np.random.default_rng(dims)
    bases = rnd.normal(size=(300, dims))
    near = bases + rnd.normal(size=bases.shape) * 0.1 * np.abs(bases).mean()
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(np.concatenate([bases, near]).astype(np.float32))]
    nodes = embedding_dedup.classes(spark.createDataFrame(rows, SCHEMA)).persist()
    met = embedding_dedup.candidates(embedding_dedup._coded(nodes)).count()
    links = embedding_dedup.links(embedding_dedup.candidates(embedding_dedup._coded(nodes)), nodes).count()
    x = embedding_dedup.unit(np.array([r[1] for r in rows]))
    pairs = int(np.triu(x @ x.T >= 0.98, 1).sum())
    # Of two dimensions a sixteenth of all pairs link.
    assert met < 0.25 * 600 * 599 / 2 and pairs * 0.97 <= links <= pairs


URLS = [
    ("https://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://x.net/", "x.net", "/", "net/", "block"),
    ("http://x.net", "x.net", "", None, None),
    ("http://net/a", "net", "/a", "net/", "block"),
    ("https://example.net/fr/1?q=/en/", "example.net", "/fr/1", "net/", "block"),
    ("https://notexample.com/de/x", "notexample.com", "/de/x", None, None),
    ("https://m.example.com/de/x#y", "m.example.com", "/de/x", "example.com/de/", "block"),
    ("https://www.example.org/fr/2", "www.example.org", "/fr/2", "org/fr/", "allow"),
    ("ftp://u@h.org:80?x://y.net/", "u@h.org:80", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme/net/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(URLS)] + [(None, "http://x.net/", "x")], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.train(pages)).collect()}
    assert len(got) == len(URLS) + 1 and got[None].verdict == "block"
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), url_filter.train(pages.limit(0))).count() == 0


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_model_without_both_labels(labels, score):
    assert url_filter.UrlModel(["http://a.b/"] * len(labels), labels).score(["http://c.d/"]).tolist() == [score]


def test_trees_learn():
    rnd = np.random.default_rng(3)
    urls = [f"https://{'spam' if b else 'site'}{rnd.integers(0, 9)}.{'biz' if b and rnd.random() < 0.7 else 'org'}/{'1' * int(rnd.integers(3, 30) if b else rnd.integers(0, 4))}{'?a=1&b=2&c=3' if b else ''}" for b in rnd.integers(0, 2, 2000).tolist()]
    y = [int("spam" in u) for u in urls]
    model = url_filter.UrlModel(urls[:1500], y[:1500])
    assert np.mean((model.score(urls[1500:]) >= 0.5) == np.array(y[1500:])) > 0.97
    margin = url_filter.fit_trees(np.arange(40.0)[:, None], (np.arange(40) > 19).astype(float)).margin(np.arange(40.0)[:, None])
    assert ((margin > 0) == (np.arange(40) > 19)).all()


def test_the_sample_has_the_smallest_hashes(spark, monkeypatch):
    urls = [(i, f"http://h{i}.net/{i % 7}") for i in range(900)] + [(1000 + i, "http://hot.net/") for i in range(500)]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(5)
    seen = []
    monkeypatch.setattr(url_filter, "UrlModel", lambda u, y: seen.append((u, y)))
    for most in (20, 300, 5000):
        monkeypatch.setattr(url_filter, "MAX_ROWS", most)
        url_filter.train(pages)
        from pyspark.sql import functions as F

        every = [r["url"] for r in pages.select("url").distinct().orderBy(F.xxhash64("url")).collect()]
        assert seen[-1] == (every[:most], [1] * min(most, len(every)))


def test_rules_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    parts = ["net", "example", "org", "com", "a", "Example", "NET", "en", "de", "fr", "x"]
    some = lambda n, sep: sep.join(rnd.choice(parts, n))
    urls = [f"{rnd.choice(['http', 'ftp', ''])}{rnd.choice(['://', '://', ':/'])}{some(rnd.integers(1, 3), '.')}{rnd.choice(['', '.'])}{rnd.choice(['net', 'example.net', 'EXAMPLE.com', 'org', 'x'])}{rnd.choice(['', '/', '/', '/', '?', '#'])}{some(rnd.integers(1, 3), '/')}{rnd.choice(['', '/', '?q', '#/en/'])}" for _ in range(600)]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def judged(u):
        _, sign, rest = u.partition("://")
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end], rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        if not sign:
            return "", "", None, None
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.train(pages)).collect()}
    assert sum(judged(u)[2] is not None for u in urls) > 50
    for i, u in enumerate(urls):
        host, path, rule, verdict = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ([verdict] if verdict else ["allow", "block"]), u
