"""Trees over sparse vectors: a level's histograms hold what is not zero, so that work follows the entries of the vectors.

Spark's trees unroll each row to the number of features. Here values are binned by quantiles of each feature's entries;
a task puts its rows' entries in the order of features, deals rows to the nodes of every tree by the splits so far, and
counts (tree, node, feature, bin, class) of entries alone. A feature's zeros are the node's total less its entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a feature's entries, as many as Spark's trees have.
BINS = 32
#: Entries that a task holds, at most about.
TASK_ENTRIES = 16_000_000


@dataclass
class Tree:
    """splits: (slot, feature, bin, threshold, the side that zero takes is right, new slot) in the order they were made: rows
    on the other side than zero's go to the new slot, the others keep theirs. totals: each slot's weight by class."""

    totals: list = field(default_factory=list)
    splits: list = field(default_factory=list)
    gains: list = field(default_factory=list)

    def slots(self, entries: Entries, place: int) -> np.ndarray:
        """Each row's slot; entries hold bins (place 2) or values (place 3)."""
        own = np.zeros(entries.count, np.int32)
        low, high = entries.span(np.array([split[1] for split in self.splits], np.int64))
        for k in np.flatnonzero(high > low):
            slot, _, _, _, right, new = split = self.splits[k]
            at, x = entries.rows[low[k] : high[k]], entries.x[low[k] : high[k]]
            own[at[(own[at] == slot) & ((x > split[place]) != right)]] = new
        return own

    def probabilities(self) -> np.ndarray:
        t = np.array(self.totals)
        return t / np.maximum(t.sum(axis=1, keepdims=True), 1e-300)


@dataclass
class Shape:
    """How a tree is grown: features tried at a node (None: all), least weight of a child, seed, and whether rows are drawn."""

    features: int | None
    least: float
    depth: int
    seed: int
    drawn: bool = False


def entries(column: Column | str) -> Column:
    """struct i, x of a vector: its entries that are not zero."""

    def own(v) -> tuple[list, list]:
        if isinstance(v, DenseVector):
            i = np.flatnonzero(v.array)
            return i.tolist(), v.array[i].tolist()
        keep = v.values != 0
        return v.indices[keep].tolist(), v.values[keep].tolist()

    return F.udf(own, "i array<int>, x array<double>")(column)


class Entries:
    """Rows' lists of features f and values x, in the order of features."""

    def __init__(self, lists: pa.ListArray, values: pa.ListArray):
        sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
        f, x = lists.flatten().to_numpy(), values.flatten().to_numpy()
        order = np.argsort(f, kind="stable")
        self.count, self.f, self.x, self.rows = len(lists), f[order], x[order], np.repeat(np.arange(len(lists)), sizes)[order]

    def span(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each feature's entries begin and end."""
        return np.searchsorted(self.f, features), np.searchsorted(self.f, features, side="right")


class Binned:
    """Rows of features and label as binned entries, kept until release()."""

    def __init__(self, rows: DataFrame, features: str = "features", label: str = "label"):
        first = rows.select(features).first()
        self.size = len(first[0]) if first else 0
        own = rows.select(entries(features).alias("e"), F.col(label).cast("int").alias("y")).select("e.i", "e.x", "y").persist(StorageLevel.MEMORY_AND_DISK)
        self.classes = max(2, (own.agg(F.max("y")).first()[0] or 0) + 1)
        cuts = own.select(F.explode(F.arrays_zip("i", "x")).alias("e")).groupBy("e.i").agg(F.percentile_approx("e.x", [k / (BINS - 1) for k in range(1, BINS - 1)], F.lit(100)).alias("q"), F.max("e.x").alias("most"))
        found = cuts.select("i", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.filter("q", lambda q: q < F.col("most"))))).alias("q")).toArrow().sort_by("i")
        q = found["q"].combine_chunks()
        known, at, flat = found["i"].to_numpy(), np.asarray(q.offsets), q.flatten().to_numpy()
        self.cuts = {"known": known, "at": at, "flat": flat}
        self.shared = rows.sparkSession.sparkContext.broadcast((known, at, flat))
        shared = self.shared

        def bin_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, at, flat = shared.value
            for b in batches:
                i, x = b.column("i"), b.column("x")
                f = np.searchsorted(known, i.flatten().to_numpy())
                v, low, high = x.flatten().to_numpy(), at[f].astype(np.int64), at[f + 1].astype(np.int64)
                a, z = low.copy(), high.copy()
                for _ in range(6):  # a search by halves for all entries at once; BINS < 2 ** 6
                    mid = (a + z) // 2
                    less = (a < z) & (flat[np.minimum(mid, len(flat) - 1)] < v)
                    a, z = np.where(less, mid + 1, a), np.where((a < z) & ~less, mid, z)
                offsets = np.asarray(i.offsets, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(y)) for y in (i.flatten().to_numpy(), (a - low).astype(np.int8))]
                yield pa.RecordBatch.from_arrays([*lists, b.column("y")], ["i", "b", "y"])

        binned = own.mapInArrow(bin_entries, "i array<int>, b array<tinyint>, y int")
        entries_ = own.agg(F.sum(F.size("i"))).first()[0] or 0
        self.parts = max(rows.sparkSession.sparkContext.defaultParallelism, entries_ // TASK_ENTRIES)
        self.rows = binned.coalesce(self.parts).persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.count()
        own.unpersist()

    def release(self) -> None:
        self.rows.unpersist()
        self.shared.unpersist()

    def threshold(self, feature: int, b: int) -> float:
        k = np.searchsorted(self.cuts["known"], feature)
        return float(self.cuts["flat"][self.cuts["at"][k] + b])

    def grow(self, shapes: list[Shape], prior: list[tuple[Tree, float]] = ()) -> list[Tree]:
        """A tree of each shape, all level by level together; rows weigh exp(sum of votes of prior trees that err)."""
        classes, shared, trees = self.classes, self.shared, [Tree() for _ in shapes]
        sc = self.rows.sparkSession.sparkContext

        def task(batches, plan):
            table = pa.Table.from_batches(batches).combine_chunks()
            y = table["y"].to_numpy()
            all_ = Entries(table["i"].combine_chunks(), table["b"].combine_chunks())
            f, x, rows = all_.f, all_.x, all_.rows
            weight = np.zeros(len(y))
            for tree, vote in plan["prior"]:
                weight += vote * (tree.probabilities().argmax(axis=1)[tree.slots(all_, 2)] != y)
            weight = np.exp(weight)
            part = TaskContext.get().partitionId()
            for t, tree, drawn, seed, active in plan["trees"]:
                w = weight * np.random.default_rng([seed, part]).poisson(1.0, len(y)) if drawn else weight
                if not tree.totals:
                    yield [np.full(classes, t), np.zeros(classes, np.int64), np.full(classes, -1), np.zeros(classes, np.int64), np.arange(classes), np.bincount(y, w, classes)]
                    continue
                own = tree.slots(all_, 2)
                if active[0][1] is None:  # all features
                    keep = np.isin(own[rows], [s for s, _ in active])
                    r, fs, bs = rows[keep], f[keep], x[keep]
                    slots = own[r]
                else:
                    wanted = np.concatenate([c for _, c in active])
                    of = np.repeat([s for s, _ in active], [len(c) for _, c in active])
                    a, b = all_.span(wanted)
                    n = b - a
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    keep = own[rows[at]] == np.repeat(of, n)
                    at = at[keep]
                    r, fs, bs, slots = rows[at], f[at], x[at], own[rows[at]]
                if not len(r):
                    continue
                key = ((slots.astype(np.int64) << 38 | fs.astype(np.int64)) * BINS + bs) * classes + y[r]
                key, back = np.unique(key, return_inverse=True)
                rest, cls = np.divmod(key, classes)
                rest, bins = np.divmod(rest, BINS)
                yield [np.full(len(key), t), rest >> 38, rest & (1 << 38) - 1, bins, cls, np.bincount(back, w[r])]

        columns = "t bigint, s bigint, f bigint, b bigint, c bigint, w double"
        names = ["t", "s", "f", "b", "c", "w"]

        def counts(plan):
            said = sc.broadcast(plan)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held = [b for b in batches if b.num_rows]
                for out in task(held, said.value) if held else ():
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if k == "w" else pa.int64()) for k, v in zip(names, out)], names)

            return self.rows.mapInArrow(run, columns)

        def best(totals: dict, least: dict):
            """Of each (t, s) in a task the best split: gain, f, b, zero on the right, weights of the new slot."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known, at, flat = shared.value
                held = [b for b in batches if b.num_rows]
                if not held:
                    return
                d = pa.Table.from_batches(held)
                t, s, f, b, c, w = (d[k].to_numpy() for k in names)
                order = np.lexsort((b, f, s, t))
                t, s, f, b, c, w = (v[order] for v in (t, s, f, b, c, w))
                new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1]) | (f[1:] != f[:-1])])
                g = np.cumsum(new) - 1
                first = np.flatnonzero(new)
                gt, gs, gf = t[first], s[first], f[first]
                whole = np.array([totals[k] for k in zip(gt.tolist(), gs.tolist())])
                lower = np.array([least[k] for k in gt.tolist()])
                k = np.searchsorted(known, gf)
                zero = np.array([np.searchsorted(flat[i:j], 0.0) for i, j in zip(at[k], at[k + 1])])
                cells = np.zeros((len(first), BINS, classes))
                np.add.at(cells, (g, b, c), w)
                cells[np.arange(len(first)), zero] += whole - cells.sum(axis=1)
                left = cells.cumsum(axis=1)[:, :-1]
                right = whole[:, None, :] - left
                nl, nr, n = left.sum(axis=2), right.sum(axis=2), whole.sum(axis=1)[:, None]
                gini = lambda m, n: 1 - (m * m).sum(axis=-1) / np.maximum(n * n, 1e-300)
                gain = gini(whole[:, None, :], n) - (nl * gini(left, nl) + nr * gini(right, nr)) / n
                gain[(nl < lower[:, None]) | (nr < lower[:, None])] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(len(first)), top]
                pick = np.lexsort((gf, -value, gs, gt))
                own = pick[np.concatenate([[True], (gt[pick][1:] != gt[pick][:-1]) | (gs[pick][1:] != gs[pick][:-1])])]
                own = own[value[own] > 1e-12]
                right_zero = zero[own] > top[own]
                moved = np.where(right_zero[:, None], left[own, top[own]], right[own, top[own]])
                lists = pa.array(list(moved), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(gt[own]), pa.array(gs[own]), pa.array(value[own]), pa.array(gf[own]), pa.array(top[own]), pa.array(right_zero), lists], ["t", "s", "gain", "f", "b", "z", "moved"])

            return run

        def plan(active: dict) -> dict:
            return {"prior": list(prior), "trees": [(t, trees[t], shapes[t].drawn, shapes[t].seed, a) for t, a in active.items()]}

        roots = counts(plan({t: [(0, None)] for t in range(len(trees))})).groupBy("t", "c").agg(F.sum("w").alias("w")).collect()
        for tree in trees:
            tree.totals.append([0.0] * classes)
        for r in roots:
            trees[r["t"]].totals[0][r["c"]] = r["w"]
        open_slots = {t: [0] for t in range(len(trees))}
        for level in range(max((x.depth for x in shapes), default=0)):
            active, totals = {}, {}
            for t, slots in open_slots.items():
                shape, tree = shapes[t], trees[t]
                own = [s for s in slots if level < shape.depth and sum(v > 0 for v in tree.totals[s]) > 1 and sum(tree.totals[s]) >= 2 * shape.least]
                if own:
                    active[t] = [(s, self._drawn_features(shape, level, s)) for s in own]
                    totals |= {(t, s): tree.totals[s] for s in own}
            if not active:
                break
            least = {t: shapes[t].least for t in active}
            parted = counts(plan(active)).repartition(self.parts, "t", "s", "f")
            found = parted.mapInArrow(best(totals, least), "t bigint, s bigint, gain double, f bigint, b bigint, z boolean, moved array<double>").collect()
            tops: dict = {}
            for r in found:
                k = (r["t"], r["s"])
                if k not in tops or (-r["gain"], r["f"]) < (-tops[k]["gain"], tops[k]["f"]):
                    tops[k] = r
            open_slots = {}
            for (t, s), r in sorted(tops.items()):
                tree = trees[t]
                new, moved = len(tree.totals), r["moved"]
                tree.gains.append((r["f"], r["gain"] * sum(tree.totals[s])))
                tree.splits.append((s, r["f"], r["b"], self.threshold(r["f"], r["b"]), r["z"], new))
                tree.totals.append(list(moved))
                tree.totals[s] = [max(0.0, a - b) for a, b in zip(tree.totals[s], moved)]
                open_slots.setdefault(t, []).extend((s, new))
        return trees

    def _drawn_features(self, shape: Shape, level: int, slot: int) -> np.ndarray | None:
        k = shape.features
        if k is None or k >= self.size:
            return None
        draw = np.random.default_rng([shape.seed, level, slot])
        if k > self.size // 4:
            return np.sort(draw.permutation(self.size)[:k])
        got = np.unique(draw.integers(0, self.size, k))
        while len(got) < k:
            got = np.unique(np.concatenate([got, draw.integers(0, self.size, k - len(got))]))
        return got


def votes(trees: list[Tree], weights: list[np.ndarray], classes: int, features: str) -> Column:
    """array<double>: the sum over trees of weights (slots by classes) of a row's slot."""

    def run(i: pd.Series, x: pd.Series) -> pd.Series:
        kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()))
        own = Entries(*(pa.array(list(c), k) for c, k in zip((i, x), kinds)))
        out = np.zeros((len(i), classes))
        for tree, w in zip(trees, weights):
            out += w[tree.slots(own, 3)]
        return pd.Series(list(out), dtype=object)

    run.__annotations__ = {"i": pd.Series, "x": pd.Series, "return": pd.Series}
    e = entries(features)
    return F.pandas_udf(run, "array<double>")(e["i"], e["x"])


class SparseForest(Estimator, HasFeaturesCol, HasLabelCol, HasSeed):
    """A random forest with the names of Spark's parameters; bootstrap draws each tree's rows."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features tried at a node: all, sqrt, auto (sqrt) or a number", TypeConverters.toString)

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", numTrees: int = 20, seed: int = 0, bootstrap: bool = True):
        super().__init__()
        self._setDefault(maxDepth=5, minInstancesPerNode=1, featureSubsetStrategy="auto")
        self._set(featuresCol=featuresCol, labelCol=labelCol, numTrees=numTrees, seed=seed)
        self.bootstrap = bootstrap

    def _shapes(self, size: int) -> list[Shape]:
        said = self.getOrDefault(self.featureSubsetStrategy)
        k = {"all": size, "auto": int(np.ceil(np.sqrt(size))), "sqrt": int(np.ceil(np.sqrt(size)))}.get(said) or int(said)
        own = (min(k, size), float(self.getOrDefault(self.minInstancesPerNode)), self.getOrDefault(self.maxDepth))
        return [Shape(*own, seed=self.getSeed() * 100_003 + t, drawn=self.bootstrap) for t in range(self.getOrDefault(self.numTrees))]

    def fit_many(self, dataset: DataFrame, maps: list[dict]) -> list[SparseForestModel]:
        """The models of all settings, whose trees grow together."""
        binned = Binned(dataset, self.getFeaturesCol(), self.getLabelCol())
        each = [self.copy(m)._shapes(binned.size) for m in maps]
        trees = iter(binned.grow([s for shapes in each for s in shapes]))
        out = [SparseForestModel([next(trees) for _ in shapes], binned.classes, binned.size, self.getFeaturesCol()) for shapes in each]
        binned.release()
        return out

    def _fit(self, dataset: DataFrame) -> SparseForestModel:
        return self.fit_many(dataset, [{}])[0]


class SparseForestModel(Model):
    """rawPrediction (the sum of trees' class shares), probability, prediction."""

    def __init__(self, trees: list[Tree], classes: int, size: int, features: str):
        super().__init__()
        self.trees, self.classes, self.size, self.features = trees, classes, size, features

    def importances(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation over trees of each feature's share of a tree's gains, weighted by rows."""
        mean, square = np.zeros(self.size), np.zeros(self.size)
        for tree in self.trees:
            whole = sum(g for _, g in tree.gains)
            own: dict[int, float] = {}
            for f, g in tree.gains:
                own[f] = own.get(f, 0.0) + g / whole
            for f, g in own.items():
                mean[f] += g / len(self.trees)
                square[f] += g * g / len(self.trees)
        return mean, np.sqrt(np.maximum(square - mean * mean, 0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("__votes", votes(self.trees, [t.probabilities() for t in self.trees], self.classes, self.features))
        share = F.transform("__votes", lambda v: v / max(len(self.trees), 1))
        best = (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("__votes"), "probability": array_to_vector(share), "prediction": best}).drop("__votes")
