"""Approximate nearest neighbours: balanced posting lists.

Centroids come from balanced splits of a bounded sample of the vectors. Every vector goes to its nearest list, and a
boundary vector also to the lists whose centroid is nearly as near (at most `replicas` in all). Lists are balanced: one
longer than `list_cap` is dealt over sub-lists, all of which a query reads, and the queries of a list over parts of about
`ask_cap`, so that a task holds a bounded part of both. A query finds its nearest centroids by a
best-first walk over an in-memory graph of them and searches the lists whose distance is at most `prune` times the
nearest one's, and at most `probe`. The walk starts from pivots, about the root of the number of centroids and far from
each other, and the graph is connected: each centroid is linked both ways with its nearest ones and its pivot, each
pivot with the nearest pivot before it. The walk's width, `probe` and `prune` are measured on the sample, by walking:
they are as large as its own nearest neighbours need for the target recall.

Cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
nor do rows without an id; equal vectors are ranked by id; repeated ids never answer each other; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen


@dataclass
class Index:
    centroids: np.ndarray
    links: list[np.ndarray]  # of each centroid, both ways
    pivots: np.ndarray  # where walks start

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to width centroids near q, nearest first, with their distances: a best-first walk over the graph."""
        n = len(self.centroids)
        starts = self.pivots
        seen = np.zeros(n, dtype=bool)
        seen[starts] = True
        d = np.sqrt(((self.centroids[starts] - q) ** 2).sum(axis=1))
        open_ = [(float(x), int(i)) for x, i in zip(d, starts)]
        heapq.heapify(open_)
        best = [(-x, i) for x, i in heapq.nsmallest(width, open_)]
        heapq.heapify(best)
        while open_:
            x, i = heapq.heappop(open_)
            if len(best) >= width and x > -best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for y, j in zip(np.sqrt(((self.centroids[new] - q) ** 2).sum(axis=1)).tolist(), new.tolist()):
                if len(best) < width or y < -best[0][0]:
                    heapq.heappush(open_, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > width:
                        heapq.heappop(best)
        got = sorted((-x, i) for x, i in best)
        return np.array([i for _, i in got]), np.array([x for x, _ in got])

    def lists_of(self, x: np.ndarray, replicas: int, closure: float) -> list[np.ndarray]:
        """Each vector's lists: the nearest ones, as far as closure times the nearest's distance."""
        d2 = (x * x).sum(axis=1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(axis=1)
        d = np.sqrt(np.maximum(d2, 0))
        k = min(replicas, d.shape[1])
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        far = np.take_along_axis(d, near, axis=1)
        return [own[row <= closure * row.min() + 1e-12] for own, row in zip(near, far)]


def calibrate(index: Index, sample: np.ndarray, k: int, replicas: int, closure: float, recall: float, asks: int = 200) -> tuple[int, float, int]:
    """(probe, prune, width): how many lists, how far beyond the nearest, and how wide a walk find the share `recall` of
    the k nearest neighbours that rows of the sample have in it. A walk as wide as the graph reaches every list."""
    n = len(index.centroids)
    if len(sample) < 2:
        return n, np.inf, n
    lists = [own for i in range(0, len(sample), 512) for own in index.lists_of(sample[i : i + 512], replicas, closure)]
    x = sample[:asks]
    near = []  # of each asking row: the lists of its nearest neighbours
    for i in range(len(x)):
        d = ((sample - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near.append([lists[j] for j in np.argsort(d, kind="stable")[: min(k, len(d) - 1)]])
    width = min(n, 32)
    while True:
        ranks, ratios = [], []
        for q, held in zip(x, near):
            own, d = index.nearest(q, width)
            place = np.full(n, n)
            place[own] = np.arange(len(own))
            for of in held:
                r = int(place[of].min())
                ranks.append(r)
                ratios.append(d[r] / max(d[0], 1e-12) if r < n else np.inf)
        ranks_, ratios_ = np.array(ranks), np.array(ratios)
        for level in np.linspace(recall, 1, 11):
            probe = int(np.quantile(ranks_, level, method="higher")) + 1
            prune = float(np.quantile(ratios_, min(1.0, level + 0.02), method="higher"))
            if ((ranks_ < min(probe, n)) & (ratios_ <= prune)).mean() >= recall:
                return min(probe, n), prune, width
        if width == n:
            return n, np.inf, n
        width = min(n, 2 * width)


def build(sample: np.ndarray, lists: int, *, degree: int = 24, rounds: int = 3) -> Index:
    """Centroids by halving: each half holds as many vectors as the other, cut across the line between two means."""
    rng = np.random.default_rng(5)
    parts = [np.arange(len(sample))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len)
        own = parts.pop()
        x = sample[own]
        a, b = x[rng.integers(len(x))], x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        for _ in range(rounds):
            order = np.argsort(x @ (b - a), kind="stable")
            half = len(order) // 2
            a, b = x[order[:half]].mean(axis=0), x[order[half:]].mean(axis=0)
        parts += [own[order[:half]], own[order[half:]]]
    centres = np.unique(np.array([sample[p].mean(axis=0) for p in parts]), axis=0)
    for _ in range(rounds):  # a few rounds of k-means settle the centroids
        d = (centres**2).sum(axis=1) - 2 * sample @ centres.T
        own = d.argmin(axis=1)
        many = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.unique(np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres), axis=0)
    return Index(centres, *_graph(centres, degree))


def _graph(centres: np.ndarray, degree: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(links, pivots) of a connected graph: see the module's docstring."""
    n = len(centres)
    near = min(degree, n - 1)
    pairs = []
    for i in range(0, n, 1024):
        d = (centres**2).sum(axis=1) - 2 * centres[i : i + 1024] @ centres.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        to = np.argsort(d, axis=1, kind="stable")[:, :near]
        pairs.append(np.stack([np.repeat(np.arange(i, i + len(d)), near), to.ravel()], axis=1))
    # Each pivot is the centroid farthest from those before it.
    pivots, far, own = [0], ((centres - centres[0]) ** 2).sum(axis=1), np.zeros(n, dtype=np.int64)
    tree = []
    while len(pivots) < np.sqrt(n):
        p = int(far.argmax())
        tree.append((p, own[p]))
        d = ((centres - centres[p]) ** 2).sum(axis=1)
        own[d < far] = p
        far = np.minimum(far, d)
        pivots.append(p)
    pairs += [np.array(tree, dtype=np.int64).reshape(-1, 2), np.stack([np.arange(n), own], axis=1)]
    a = np.concatenate(pairs)
    a = np.unique(np.concatenate([a, a[:, ::-1]]), axis=0)
    a = a[a[:, 0] != a[:, 1]]
    return np.split(a[:, 1], np.searchsorted(a[:, 0], np.arange(1, n))), np.array(pivots)


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, list_rows: int = 256, max_lists: int = 8192, replicas: int = 4, closure: float = 1.1, recall: float = 0.97, list_cap: int = 4096, ask_cap: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all other rows for each row that `queries` selects.

    sample_rows bounds the rows that the centroids are fitted on (those with the smallest hash of the id), max_lists
    the centroids that are sent to executors; every row is indexed.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    dims, total = sizes[0]["dims"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dims)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()["v"]
    sample = np.array(sample.tolist(), dtype=np.float64).reshape(-1, dims)
    index = build(sample, int(min(max_lists, max(1, total // list_rows))))
    probe, prune, width = calibrate(index, sample, k, replicas, closure, recall)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                lists = index.lists_of(np.array(part["v"].tolist()), replicas, closure)
                own = np.repeat(np.arange(len(part)), [len(x) for x in lists])
                yield pd.DataFrame({"list": np.concatenate(lists), "id": part["id"].to_numpy()[own], "v": part["v"].to_numpy()[own]})

    deals = rows.select("id", "v").mapInPandas(deal, "list bigint, id bigint, v array<double>")
    counts = deals.groupBy("list").count()
    # max_lists bounds the rows collected and broadcast.
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in counts.collect():
        sizes[r["list"]] = r["count"]

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, v in zip(b["id"], b["v"]):
                own, d = index.nearest(np.array(v), width)
                m = int((d[:probe] <= prune * d[0] + 1e-12).sum())
                enough = int(np.searchsorted(np.cumsum(sizes[own]), (k + 1) * replicas)) + 1
                own = own[: max(m, enough)]  # lists of few rows do not leave a query without k answers
                yield pd.DataFrame({"list": own, "q": q, "qv": [v] * len(own)})

    table = pa.table({"of": np.flatnonzero(sizes), "subs": -(-sizes[sizes > 0] // list_cap)})
    subs = vectors.sparkSession.createDataFrame(table)
    posted = deals.join(F.broadcast(subs), F.col("list") == F.col("of")).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs"))).drop("of", "subs")
    asked = frozen(rows.where("asks").select("id", "v").mapInPandas(probes, "list bigint, q bigint, qv array<double>"))
    # Likewise a row per list at most.
    parts = asked.groupBy(F.col("list").alias("of")).agg(F.ceil(F.count("*") / ask_cap).cast("long").alias("parts"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    posted = posted.join(F.broadcast(parts), F.col("list") == F.col("of")).withColumn("part", every("parts")).drop("of", "parts")
    asked = asked.join(F.broadcast(subs), F.col("list") == F.col("of")).withColumn("sub", every("subs")).drop("of", "subs")
    asked = asked.join(F.broadcast(parts), F.col("list") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).drop("of", "parts")

    def best(key, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asks.empty:
            return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64"})
        own = own.sort_values("id", kind="stable")
        x, ids = np.array(own["v"].tolist()), own["id"].to_numpy()
        out = []
        for q, v in zip(asks["q"], asks["qv"]):
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            d[ids == q] = np.inf
            at = np.argsort(d, kind="stable")[: k + 1]  # equal distances keep the smaller id first
            at = at[np.isfinite(d[at])][:k]
            out.append(pd.DataFrame({"q": q, "id": ids[at], "score": d[at]}))
        return pd.concat(out)

    found = posted.groupBy("list", "sub", "part").cogroup(asked.groupBy("list", "sub", "part")).applyInPandas(best, "q bigint, id bigint, score double")
    # A query's answers: at most k from each of at most `probe` lists' sub-lists.
    unique = found.groupBy("q", "id").agg(F.min("score").alias("score"))
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
