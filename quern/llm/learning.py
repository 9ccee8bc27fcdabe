"""Small models fitted on the driver from bounded samples of labelled rows, and how those are drawn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most; the smallest hashes of doc_id are taken.
SAMPLE_ROWS = 6000


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (false for null); such rows never teach."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``rows`` labelled rows that are not held out.

    Conflicting labels of one doc_id count as their maximum; of several texts of one doc_id, the one with the least hash is taken.
    The ids are few by ``rows``, so they are broadcast. The rows of each label go to folds 0 and 1 by turns, in the order of a hash
    of doc_id, so both folds have both labels as soon as there are two rows of each, whatever the ids are.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")  # labels of no document teach nothing
    order = F.xxhash64("doc_id", F.lit(label))
    turn, drawn = [0, 0], []
    for r in known.orderBy(order, "doc_id").limit(rows).collect():
        drawn.append((r.doc_id, r.label, turn[r.label] % 2))
        turn[r.label] += 1
    ids = docs.sparkSession.createDataFrame(drawn, "doc_id long, label int, fold int")
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label", "fold")


class Isotonic:
    """Non-decreasing step function by pooling adjacent violators; ``prior`` pulls every step to the base rate."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float = 2.0):
        order = np.argsort(x, kind="stable")
        x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
        base = float(y.mean()) if len(y) else 0.5
        blocks: list[list[float]] = []  # [sum, count, highest x]
        for v in np.unique(x):
            own = y[x == v] if len(x) < 64 else y[np.searchsorted(x, v) : np.searchsorted(x, v, "right")]
            blocks.append([own.sum(), len(own), v])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                s, n, top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, top]
        self.at = np.array([b[2] for b in blocks] or [0.0])
        self.value = np.maximum.accumulate(np.array([(b[0] + prior * base) / (b[1] + prior) for b in blocks] or [base]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(np.asarray(x, float), self.at, self.value), 0.0, 1.0)


class BoostedTrees:
    """Gradient-boosted trees for the log-loss, with feature histograms; deterministic."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base, self.trees, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if not len(y):
            return self
        self.cuts = [self._cut(x[:, f]) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree, node = self._tree(b, y - q, q * (1 - q))
            self.trees.append(tree)
            score += self.rate * np.array([t[3] for t in tree])[node]
        return self

    def _cut(self, v: np.ndarray) -> np.ndarray:
        """Upper edges of bins: quantiles of the distinct values, so that rare large values have their own."""
        u = np.unique(v)
        return u[:-1] if len(u) <= self.bins else np.unique(np.quantile(u, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Nodes (feature, bin, first child, value); children are neighbours; rows' leaves."""
        tree, node, level = [[-1, 0, 0, 0.0]], np.zeros(len(g), int), [0]
        for depth in range(self.depth + 1):
            nxt = []
            for k in level:
                rows = np.flatnonzero(node == k)
                gs, hs = g[rows].sum(), h[rows].sum()
                tree[k][3] = gs / (hs + 1.0)
                if depth == self.depth or len(rows) < 8:
                    continue
                best = (1e-6, -1, 0)
                for f, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    gl = np.cumsum(np.bincount(b[rows, f], g[rows], len(cuts) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, f], h[rows], len(cuts) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < self.least) | (hs - hl < self.least)] = 0
                    if (top := gain.max()) > best[0]:
                        best = (top, f, int(gain.argmax()))
                if best[1] >= 0:
                    at = len(tree)
                    tree[k][:3] = [best[1], best[2], at]
                    tree += [[-1, 0, 0, 0.0], [-1, 0, 0, 0.0]]
                    node[rows] = at + (b[rows, best[1]] > best[2])
                    nxt += [at, at + 1]
            level = nxt
        return tree, node

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        out = np.full(len(x), self.base)
        if not self.trees:
            return out
        b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1)
        rows = np.arange(len(x))
        for tree in self.trees:
            f, cut, child, value = (np.array(c) for c in zip(*tree, strict=True))
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = f[node] >= 0
                node = np.where(inner, child[node] + (b[rows, np.maximum(f[node], 0)] > cut[node]), node)
            out += self.rate * value[node]
        return out
