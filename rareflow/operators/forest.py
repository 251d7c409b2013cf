"""Impurity decreases of a forest without a depth limit, on tables of any size.

Features are cut into bins, and rows equal in bins and label are one row with a count: to a tree they are the same. A
tree's bootstrap draws a count for every such row. Nodes of more than ``LOCAL`` drawn rows are cut level by level, all
trees in one pass, from histograms that executors add up; every smaller node goes to one task, which grows the rest of
its tree. The driver holds the cuts of the large nodes and one row per small one.

The rules are those of Spark's forest: Poisson bootstrap, Gini impurity on weighted rows, a fresh draw of features for
every node, leaves at no gain, a pure node or ``MAX_DEPTH``, and sibling leaves of one prediction merged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, spread, stage_table
from .ordered import range_cuts, running_sums
from .repeats import COUNT, draw

# Workers get the functions of this module with the task; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Drawn distinct rows of a node from which it is cut by all tasks together.
LOCAL = 500_000
#: Tasks that small nodes are dealt to, for each of them and at most.
DEALT, MOST_TASKS = 4, 2_000

# ---------------------------------------------------------------- one task


def gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Impurity of weights of two classes."""
    total = a + b
    return 1.0 - (a * a + b * b) / (total * total)


def best_cuts(node: np.ndarray, x: np.ndarray, n: np.ndarray, cells: tuple, weights: tuple[float, float], bins: int):
    """(gain, bin) of the best cut of every node on one feature; the gain is -1 where there is none.

    ``n`` has the drawn rows of both classes per node, ``cells`` (key, drawn rows of either class) for every filled
    (node, bin), in order. A row goes left if its bin is at most the cut.
    """
    key, a, b = cells
    at = key // bins
    first = np.flatnonzero(np.diff(at, prepend=-1))
    sums = []
    for c in (a, b):
        run = np.cumsum(c)
        sums.append(run - (run - c)[first][at])
    left, right = sums, [n[0][at] - sums[0], n[1][at] - sums[1]]
    wl, wr = ([s * w for s, w in zip(side, weights)] for side in (left, right))
    whole = n[0][at] * weights[0], n[1][at] * weights[1]
    total = whole[0] + whole[1]
    open_ = right[0] + right[1] > 0
    gain = np.full(len(key), -1.0)
    o = open_
    share = (wl[0] + wl[1])[o] / total[o]
    gain[o] = gini(whole[0][o], whole[1][o]) - share * gini(wl[0][o], wl[1][o]) - (1.0 - share) * gini(wr[0][o], wr[1][o])
    best = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == best[at])
    hit = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
    return best, key[hit] % bins, (left[0][hit], left[1][hit])


def filled(key: np.ndarray, n_keys: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, sums of both) of the keys that rows have, in order."""
    if n_keys <= 4 * len(key) + 65_536:
        sums = np.bincount(key, a, n_keys), np.bincount(key, b, n_keys)
        some = np.flatnonzero(sums[0] + sums[1])
        return some, sums[0][some], sums[1][some]
    some, place = np.unique(key, return_inverse=True)
    return some, np.bincount(place, a), np.bincount(place, b)


def picked(rng: np.random.Generator, n_nodes: int, n_features: int, n_picked: int) -> np.ndarray:
    """The features of every node, in random order."""
    return np.argsort(rng.random((n_nodes, n_features)), axis=1)[:, :n_picked]


def grow(
    x: np.ndarray, a: np.ndarray, b: np.ndarray, weights: tuple[float, float], bins: int, n_picked: int, depth: int, seed: list[int]
) -> tuple[bool, bool, np.ndarray]:
    """(is a leaf, predicts class 1, weighted impurity decrease per feature) of the tree of these rows.

    ``x`` has the bins, ``a`` and ``b`` how often a row was drawn as of class 0 and 1; ``depth`` levels may follow.
    """
    rng, n_features = np.random.default_rng(seed), x.shape[1]
    node, levels = np.zeros(len(x), dtype=np.int64), []
    n_nodes = 1
    while True:
        n = np.bincount(node, a, n_nodes), np.bincount(node, b, n_nodes)
        says = n[1] * weights[1] > n[0] * weights[0]
        gain, feature, cut = np.zeros(n_nodes), np.zeros(n_nodes, dtype=np.int64), np.zeros(n_nodes, dtype=np.int64)
        mixed = (n[0] > 0) & (n[1] > 0) & (len(levels) < depth)
        chosen = picked(rng, n_nodes, n_features, n_picked)
        keep = mixed[node]
        x, a, b, node = x[keep], a[keep], b[keep], node[keep]
        if len(node):
            # Nodes that may be cut, numbered without gaps.
            named = np.flatnonzero(mixed)
            short = (np.cumsum(mixed) - 1)[node]
            sums = n[0][named], n[1][named]
            for slot in range(n_picked):
                f = chosen[named, slot]
                key = short * bins + x[np.arange(len(short)), f[short]]
                best, where, _ = best_cuts(short, x, sums, filled(key, len(named) * bins, a, b), weights, bins)
                better = best > gain[named]
                to = named[better]
                gain[to], feature[to], cut[to] = best[better], f[better], where[better]
        split = gain > 0
        child = 2 * (np.cumsum(split) - 1)
        levels.append((says, split, child, gain * (n[0] * weights[0] + n[1] * weights[1]), feature))
        if not split.any():
            break
        keep = split[node]
        x, a, b, node = x[keep], a[keep], b[keep], node[keep]
        node = child[node] + (x[np.arange(len(node)), feature[node]] > cut[node])
        n_nodes = 2 * int(split.sum())
    decrease, below = np.zeros(n_features), None
    for says, split, child, gained, feature in reversed(levels):
        leaf = ~split
        if below is not None:
            at = np.flatnonzero(split)
            l, r = child[at], child[at] + 1
            same = below[0][l] & below[0][r] & (below[1][l] == below[1][r])
            leaf[at[same]], says[at[same]] = True, below[1][l[same]]
            stay = at[~same]
            decrease += np.bincount(feature[stay], gained[stay], n_features)
        below = leaf, says
    return bool(below[0][0]), bool(below[1][0]), decrease


# ---------------------------------------------------------------- all tasks


class _Top:
    """The large nodes of one tree: every node has a cut, is open, or is left to one task."""

    def __init__(self):
        self.feature, self.cut, self.left = [-1], [0], [0]
        self.depth, self.gained, self.size = [0], [0.0], [(0.0, 0.0)]

    def split(self, at: int, feature: int, cut: int, gained: float, sizes: tuple) -> list[int]:
        self.feature[at], self.cut[at], self.gained[at], self.left[at] = feature, cut, gained, len(self.feature)
        for size in sizes:
            self.feature.append(-1), self.cut.append(0), self.left.append(0), self.gained.append(0.0)
            self.depth.append(self.depth[at] + 1), self.size.append(size)
        return [self.left[at], self.left[at] + 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)


def _node_of(x: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node without a cut that each row falls into."""
    feature, cut, left = top
    node = np.zeros(len(x), dtype=np.int64)
    rows = np.flatnonzero(feature[node] >= 0)
    while len(rows):
        at = node[rows]
        node[rows] = left[at] + (x[rows, feature[at]] > cut[at])
        rows = rows[feature[node[rows]] >= 0]
    return node


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Keys of one tree's draws: the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))).view(np.int64)


def _read(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    x = np.column_stack([column(c) for c in names])
    return x, column("y") > 0, column(COUNT).astype(np.int64), column("key")


def binned_rows(rows: DataFrame, n_features: int, bins: int) -> DataFrame:
    """Staged (x0…, y, count, key): distinct rows of bins from rows (_x, _y, _w, _n).

    A feature of at most ``bins`` values has a bin for each; others are cut where the running weight passes equal steps.
    """
    values = vector_to_array("_x")
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), (values[i] + F.lit(0.0)).alias("value")) for i in range(n_features)])
    # No value has a weight of nothing, so that the running weight tells the values in order.
    counts = stage_table(rows.select("_w", F.inline(cells)).groupBy("feature", "value").agg(F.sum("_w").alias("w")), "forest-values")
    sizes = {r.feature: r.n for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [f for f, n in sizes.items() if n <= bins]
    edges = counts.filter(F.col("feature").isin(few)).select("feature", "value")
    if len(few) < len(sizes):
        many = counts.filter(~F.col("feature").isin(few))
        run = running_sums(many, "value", ["w"], ["feature"], descending=False, cuts=range_cuts(many, "value"))
        step = F.floor((F.col("cum_w") - F.col("w")) / F.col("all_w") * F.lit(float(bins)))
        edges = edges.unionByName(run.groupBy("feature", step).agg(F.min("value").alias("value")).select("feature", "value"))
    found = edges.collect()
    lows = [np.sort([r.value for r in found if r.feature == i])[:bins] for i in range(n_features)]
    drop_stage(counts)
    names = [f"x{i}" for i in range(n_features)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [
                pa.array((np.searchsorted(low, batch.column(c).to_numpy(zero_copy_only=False) + 0.0, "right") - 1).astype(np.int16))
                for c, low in zip(names, lows)
            ]
            yield pa.RecordBatch.from_arrays([*held, batch.column("y"), batch.column(COUNT)], [*names, "y", COUNT])

    flat = rows.select(F.col("_y").cast("tinyint").alias("y"), COUNT, *[values[i].alias(c) for i, c in enumerate(names)])
    kinds = ", ".join([*[f"{c} smallint" for c in names], "y tinyint", f"{COUNT} bigint"])
    packed = flat.mapInArrow(cut, kinds).groupBy(*names, "y").agg(F.sum(COUNT).alias(COUNT))
    return stage_table(packed.withColumn("key", F.xxhash64(*names, "y")), "forest-bins")


def importances(
    rows: DataFrame, n_features: int, seeds: list[int], n_picked: list[int], bins: int, max_depth: int
) -> np.ndarray:
    """One row per tree: weighted impurity decrease by feature, over rows (_x, _y 0 or 1, _w, _n).

    ``seeds`` and ``n_picked`` have a tree's seed and how many features a node draws.
    """
    told = rows.groupBy("_y").agg((F.sum("_w") / F.sum(COUNT)).alias("w")).collect()
    by = {int(r["_y"]): float(r["w"]) for r in told}
    weights = by.get(0, 1.0), by.get(1, 1.0)
    staged = binned_rows(rows, n_features, bins)
    table = spread(staged)
    names = [f"x{i}" for i in range(n_features)]
    n_rows = staged.count()
    tops = [_Top() for _ in seeds]
    # A root is taken as large by its distinct rows: how many of them are drawn is not known yet.
    large = [[0] if n_rows > LOCAL and max_depth > 0 else [] for _ in seeds]
    while any(large):
        large = _cut_level(table, names, tops, large, seeds, n_picked, weights, bins, max_depth)
    found = _grow_rest(table, names, tops, seeds, n_picked, weights, bins, max_depth)
    drop_stage(staged)
    out = np.zeros((len(seeds), n_features))
    for t, top in enumerate(tops):
        ends: dict[int, tuple[bool, bool]] = {}
        # A node stands after its parent.
        for at in range(len(top.feature) - 1, -1, -1):
            if top.feature[at] < 0:
                size = top.size[at]
                leaf, says, decrease = found.get((t, at), (True, size[1] * weights[1] > size[0] * weights[0], None))
                ends[at] = leaf, says
                if decrease is not None:
                    out[t] += decrease
                continue
            l, r = ends[top.left[at]], ends[top.left[at] + 1]
            if l[0] and r[0] and l[1] == r[1]:
                ends[at] = l
            else:
                ends[at] = False, False
                out[t, top.feature[at]] += top.gained[at]
    return out


def _cut_level(table, names, tops, large, seeds, n_picked, weights, bins, max_depth) -> list[list[int]]:
    """Cuts every large node from the sums of all tasks; the large nodes of the next level."""
    shapes = [top.arrays() for top in tops]
    wanted = {t: nodes for t, nodes in enumerate(large) if nodes}
    drawn_of = {
        (t, at): picked(np.random.default_rng([seeds[t] & (2**63 - 1), at]), 1, len(names), n_picked[t])[0] for t, nodes in wanted.items() for at in nodes
    }

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, n, keys = _read(batch, names)
            for t, nodes in wanted.items():
                k, node = draw(n, _mixed(keys, seeds[t]), None), _node_of(x, shapes[t])
                for at in nodes:
                    mine = np.flatnonzero((node == at) & (k > 0))
                    if not len(mine):
                        continue
                    # Drawn rows of both classes by slot and bin, and distinct rows by bin of each slot.
                    told = sums.setdefault((t, at), np.zeros((n_picked[t], 3, bins)))
                    for slot, f in enumerate(drawn_of[t, at]):
                        b, taken = x[mine, f], k[mine].astype(float)
                        told[slot, 0] += np.bincount(b, np.where(y[mine], 0.0, taken), bins)
                        told[slot, 1] += np.bincount(b, np.where(y[mine], taken, 0.0), bins)
                        told[slot, 2] += np.bincount(b, minlength=bins)
        if sums:
            t, at = zip(*sums)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(at, pa.int64()), pa.array([s.ravel() for s in sums.values()])], ["t", "node", "told"])

    def choose(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        t, at = key
        told = np.sum(np.stack(lot["told"].to_numpy()), axis=0).reshape(-1, 3, bins)
        whole = np.array([told[0, 0].sum()]), np.array([told[0, 1].sum()])
        best = (0.0, -1, 0, (0.0, 0.0), 0.0)
        for slot, f in enumerate(drawn_of[t, at]):
            a, b, rows = told[slot]
            some = np.flatnonzero(a + b)
            gain, where, (la, lb) = best_cuts(None, None, whole, (some, a[some], b[some]), weights, bins)
            if whole[0][0] and whole[1][0] and gain[0] > best[0]:
                best = (gain[0], int(f), int(where[0]), (la[0], lb[0]), rows[: where[0] + 1].sum())
        gain, f, cut, left, rows = best
        total = told[0, 2].sum()
        return pd.DataFrame([[t, at, f, cut, gain, whole[0][0], whole[1][0], left[0], left[1], rows, total - rows]])

    schema = "t int, node long, feature int, cut int, gain double, a double, b double, la double, lb double, l double, r double"
    sums = table.mapInArrow(partial, "t int, node long, told array<double>")
    lots = sums.groupBy("t", "node").applyInPandas(choose, schema)
    following: list[list[int]] = [[] for _ in tops]
    for r in sorted(lots.collect(), key=lambda r: (r["t"], r["node"])):
        top = tops[r["t"]]
        top.size[r["node"]] = r["a"], r["b"]
        if r["feature"] < 0:
            # A leaf: nothing is left to grow.
            top.depth[r["node"]] = max_depth
            continue
        gained = r["gain"] * (r["a"] * weights[0] + r["b"] * weights[1])
        sizes = (r["la"], r["lb"]), (r["a"] - r["la"], r["b"] - r["lb"])
        for at, n, size in zip(top.split(r["node"], r["feature"], r["cut"], gained, sizes), (r["l"], r["r"]), sizes):
            if n > LOCAL and all(size) and top.depth[at] < max_depth:
                following[r["t"]].append(at)
    return following


def _grow_rest(table, names, tops, seeds, n_picked, weights, bins, max_depth) -> dict[tuple[int, int], tuple]:
    """(tree, node) -> (leaf, prediction, decrease) of the nodes that one task grows. The others are leaves."""
    shapes, depths = [top.arrays() for top in tops], [np.array(top.depth) for top in tops]
    # A root that was never large has no sizes.
    grown = [
        np.array([f < 0 and d < max_depth and (len(top.feature) == 1 or all(s)) for f, d, s in zip(top.feature, top.depth, top.size)])
        for top in tops
    ]
    n_groups = int(sum(g.sum() for g in grown))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, n, keys = _read(batch, names)
            for t, seed in enumerate(seeds):
                k, node = draw(n, _mixed(keys, seed), None), _node_of(x, shapes[t])
                mine = np.flatnonzero((k > 0) & grown[t][node])
                if len(mine):
                    cells = [pa.array(x[mine, i]) for i in range(len(names))]
                    told = [pa.array(np.full(len(mine), t, dtype=np.int32)), pa.array(node[mine]), pa.array(y[mine]), pa.array(k[mine])]
                    yield pa.RecordBatch.from_arrays([*told, *cells], ["t", "node", "y", "k", *names])

    def rest(key: tuple, lot: pd.DataFrame) -> pd.DataFrame:
        t, at = key
        x, y, k = np.column_stack([lot[c].to_numpy() for c in names]), lot["y"].to_numpy(), lot["k"].to_numpy().astype(float)
        told = grow(x, np.where(y, 0.0, k), np.where(y, k, 0.0), weights, bins, n_picked[t], max_depth - int(depths[t][at]), [seeds[t] & (2**63 - 1), at, 1])
        return pd.DataFrame({"t": [t], "node": [at], "leaf": [told[0]], "says": [told[1]], "decrease": [told[2]]})

    kinds = ", ".join(["t int, node long, y boolean, k long", *[f"{c} smallint" for c in names]])
    parts = max(table.sparkSession.sparkContext.defaultParallelism, min(DEALT * n_groups, MOST_TASKS))
    lots = table.mapInArrow(deal, kinds).repartition(parts, "t", "node").groupBy("t", "node")
    schema = "t int, node long, leaf boolean, says boolean, decrease array<double>"
    return {(r["t"], r["node"]): (r["leaf"], r["says"], np.array(r["decrease"])) for r in lots.applyInPandas(rest, schema).collect()}
