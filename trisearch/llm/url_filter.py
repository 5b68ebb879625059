"""URL filtering: listed rules first, then gradient-boosted trees on lexical features.

The trees are trained here from labelled URLs, which are those that a rule
decides, and judge the others by length, depth, digits, entropy, parameters and
by statistics of their host's suffixes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bound of the training sample: distinct labelled URLs, those with the smallest hashes.
MAX_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 40, 3, 0.2, 32, 10
#: What a suffix's rate is drawn to the whole rate by, in URLs.
PRIOR = 10


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null if none fits."""
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    pick = lambda value: F.coalesce(*(F.when(fits[i], F.lit(value(rules[i]))) for i in order))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def suffixes(url: str) -> list[str]:
    """The last label and the last two labels of the host."""
    host = url.split("://", 1)[-1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].lower()
    labels = host.rsplit(".", 2)
    return [labels[-1], ".".join(labels[-2:])]


def lexical(url: str) -> list[float]:
    n = max(len(url), 1)
    rest = url.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    path, _, query = path.partition("?")
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    return [len(url), len(host), len(path), path.count("/"), host.count("."), sum(map(str.isdigit, url)) / n, entropy, query.count("&") + bool(query), sum(not c.isalnum() for c in url) / n, url.startswith("https")]


@dataclass
class Trees:
    """Boosted trees of logistic loss. A tree is a full one of some depth: feature
    and cut of each inner node, in the order of levels, and values of its leaves."""

    base: float
    trees: list

    def margin(self, x):
        import numpy as np

        total = np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), features[at]] > cuts[at])
            total += leaves[at - len(features)]
        return total


def fit_trees(x, y) -> Trees:
    """Histogram boosting: each feature has BINS quantiles, a cut is what gains most."""
    import numpy as np

    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(math.log(mean / (1 - mean)), [])
    margin = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, features, cut = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            inside = np.flatnonzero(node == k)
            best = 1e-6
            for f, edges in enumerate(cuts):
                gs, hs, ns = (np.cumsum(np.bincount(binned[inside, f], w, len(edges) + 1))[:-1] for w in (g[inside], h[inside], None))
                if not len(gs):
                    continue
                tg, th, tn = g[inside].sum(), h[inside].sum(), len(inside)
                gain = gs**2 / (hs + 1) + (tg - gs) ** 2 / (th - hs + 1) - tg**2 / (th + 1)
                gain[(ns < LEAF) | (tn - ns < LEAF)] = 0
                if gain.max() > best:
                    best, features[k], cut[k] = gain.max(), f, edges[int(gain.argmax())]
            node[inside] = 2 * k + 1 + (x[inside, features[k]] > cut[k])
        at = node - inner
        leaves = RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + 1)
        model.trees.append((features, cut, leaves))
        margin += leaves[at]
    return model


class UrlModel:
    """score(): how likely to be blocked, 0 to 1. Without both labels among
    the URLs it is 1 if all are blocked, and else 0."""

    def __init__(self, urls: list[str], blocked: list[int]):
        import numpy as np

        y = np.array(blocked, float)
        self.rate = float(y.mean()) if len(y) else 0.0
        self.stats: dict[str, list] = {}
        self.trees = None
        if 0 < self.rate < 1:
            for u, b in zip(urls, blocked, strict=True):
                for s in suffixes(u):
                    at = self.stats.setdefault(s, [0, 0])
                    at[0] += b
                    at[1] += 1
            # Each URL's suffix statistics leave it out itself.
            self.trees = fit_trees(np.array([self.features(u, b) for u, b in zip(urls, blocked, strict=True)], float), y)

    def features(self, url: str, own: int | None = None) -> list[float]:
        found = lexical(url)
        for s in suffixes(url):
            b, n = self.stats.get(s, (0, 0))
            if own is not None:
                b, n = b - own, n - 1
            found += [(b + PRIOR * self.rate) / (n + PRIOR), math.log1p(n)]
        return found

    def score(self, urls: list[str]):
        import numpy as np

        if self.trees is None:
            return np.full(len(urls), float(self.rate == 1))
        if not urls:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self.trees.margin(np.array([self.features(u) for u in urls], float))))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, listed) of every row of pages; a null url is empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "listed": verdict})


def train(pages: DataFrame, rules=RULES) -> UrlModel:
    """Trees from at most MAX_ROWS of the distinct URLs that a rule decides, those with the smallest hashes.

    A null url is an empty one, which no rule decides; repeated rows count once; without labelled
    URLs the model allows all; other columns are ignored.
    """
    labelled = parsed(pages, rules).where("listed is not null").select("url", F.when(F.col("listed") == "block", 1).otherwise(0).alias("y"), F.xxhash64("url").alias("h"))
    smallest = lambda urls: urls.distinct().orderBy("h", "url").limit(MAX_ROWS).collect()
    rows, n = [], labelled.agg(F.approx_count_distinct("h")).first()[0]
    if n > 4 * MAX_ROWS:
        # Hashes below which about twice as many are: no others are shuffled.
        rows = smallest(labelled.where(F.col("h") < int(-(2**63) + 2**64 * (2 * MAX_ROWS / n))))
    if len(rows) < MAX_ROWS:
        rows = smallest(labelled)
    return UrlModel([r["url"] for r in rows], [r["y"] for r in rows])


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of pages (page_id, url).

    verdict: the rule's, else block if score >= 0.5 and else allow; score is the
    model's in either case. A null url is judged as an empty one; null ids and
    repeated rows are kept; an empty table gives an empty one; other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)  # bounded as the sample is

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            scores = sent.value.score(batch.column(1).to_pylist())
            verdicts = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(batch.column(5).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:5], pa.array(verdicts, pa.string()), pa.array(np.asarray(scores), pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return parsed(pages, rules).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
