"""Gradient-boosted trees, grown level by level. Instances: id columns, label, features array<double>, and node, which a row is in.

A level's splits come from sums by (node, feature, value): rows are exploded by feature and summed on the map side, so
what is sorted is distinct values, not rows. Rows go to a child by an expression over the level's splits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTINUOUS = 0
GREEDY_OVER = 10


def gain(gl: Column, nl: Column, gr: Column, nr: Column, lam: float, gamma: float) -> Column:
    g, n = gl + gr, nl + nr
    part = lambda s, c: s * s / (2 * c + lam)
    return part(gl, nl) + part(gr, nr) - (part(g, n) + gamma)


def value_sums(rows: DataFrame, features: list[int]) -> DataFrame:
    """rows (node, g, features) to (node, feature, value, g, n)."""
    picked = F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("feature"), F.get("features", F.lit(j)).alias("value")) for j in features)))
    return rows.select("node", "g", picked.alias("f")).groupBy("node", "f.feature", "f.value").agg(F.sum("g").alias("g"), F.count("*").alias("n"))


def continuous_splits(sums: DataFrame, lam: float, gamma: float) -> DataFrame:
    """(node, feature, split, gain, g, n) of each cut between distinct values: value <= split goes left."""
    w = Window.partitionBy("node", "feature")
    run = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    d = sums.select("node", "feature", "value", F.sum("g").over(run).alias("gl"), F.sum("n").over(run).alias("nl"), F.sum("g").over(w).alias("g"), F.sum("n").over(w).alias("n"))
    score = gain(F.col("gl"), F.col("nl"), F.col("g") - F.col("gl"), F.col("n") - F.col("nl"), lam, gamma)
    return d.where("nl < n").select("node", "feature", F.col("value").alias("split"), score.alias("gain"), "g", "n")


def subset_splits(sums: DataFrame, categories: int, lam: float, gamma: float) -> DataFrame:
    """The same for features of few categories 0..categories-1: split is a mask whose bits go right; all subsets are tried."""
    if categories > 20:
        raise ValueError("too many categories for all subsets")
    per = sums.groupBy("node", "feature").agg(F.map_from_entries(F.collect_list(F.struct(F.col("value").cast("long").alias("value"), F.struct("g", "n")))).alias("m"), F.sum("g").alias("g"), F.sum("n").alias("n"))  # few categories
    d = per.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2**categories - 2).cast("long"))))
    bits = F.filter(F.map_entries("m"), lambda e: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), e["key"].cast("int"))) != 0)
    right = F.aggregate(bits, F.struct(F.lit(0.0).alias("g"), F.lit(0).cast("long").alias("n")), lambda a, e: F.struct((a["g"] + e["value"]["g"]).alias("g"), (a["n"] + e["value"]["n"]).alias("n")))
    d = d.withColumn("r", right).where("r.n > 0 and r.n < n")
    score = gain(F.col("g") - F.col("r.g"), F.col("n") - F.col("r.n"), F.col("r.g"), F.col("r.n"), lam, gamma)
    return d.select("node", "feature", F.col("mask").cast("double").alias("split"), score.alias("gain"), "g", "n")


def greedy_mask(values: list[int], g: list[float], n: list[int], lam: float, gamma: float) -> tuple[int, float]:
    """(mask, gain): categories go right one at a time, each time the one that gains most, while it gains."""
    total_g, total_n = sum(g), sum(n)
    part = lambda s, c: s * s / (2 * c + lam)
    mask, gr, nr, best = 0, 0.0, 0, 0.0
    left = dict(zip(values, zip(g, n)))
    while len(left) > 1:
        score = lambda x: part(total_g - gr - x[0], total_n - nr - x[1]) + part(gr + x[0], nr + x[1]) - (part(total_g, total_n) + gamma)
        value = max(sorted(left), key=lambda v: score(left[v]))
        if score(left[value]) <= best:
            break
        best = score(left[value])
        gr, nr = gr + left[value][0], nr + left[value][1]
        mask |= 1 << value
        del left[value]
    return mask, best


def greedy_splits(sums: DataFrame, lam: float, gamma: float) -> DataFrame:
    """(node, feature, mask, gain) for features of many categories; a group is a node's categories."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value")
        mask, best = greedy_mask(group["value"].astype(int).tolist(), group["g"].tolist(), group["n"].tolist(), lam, gamma)
        return pd.DataFrame({"node": [group["node"].iloc[0]], "feature": [group["feature"].iloc[0]], "mask": [mask], "gain": [best]})

    return sums.groupBy("node", "feature").applyInPandas(run, "node long, feature long, mask long, gain double")


def best_splits(splits: DataFrame) -> DataFrame:
    """The best split of each node; of equals the least feature, then the least split."""
    first = F.max(F.struct(F.round("gain", 9).alias("r"), (-F.col("feature")).alias("f"), (-F.col("split")).alias("s"), "gain", "feature", "split", "g", "n")).alias("b")
    return splits.groupBy("node").agg(first).select("node", "b.feature", "b.split", "b.gain", "b.g", "b.n")


def grow(rows: DataFrame, types: dict[int, int], depth: int, leaf_rows: int = 1, lam: float = 0.0, gamma: float = 0.0) -> dict[int, tuple[int, float]]:
    """node -> (feature, split), or (-1, value) for a leaf. rows (g, features); types: 0 continuous, else a number of categories. A tree of so many levels comes to the driver, never rows."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    tree: dict[int, tuple[int, float]] = {}
    plain = [j for j, t in types.items() if t == CONTINUOUS]
    for level in range(depth):
        sums = {r["node"]: (r["g"], r["n"]) for r in rows.groupBy("node").agg(F.sum("g").alias("g"), F.count("*").alias("n")).collect()}
        found = {}
        if level < depth - 1:
            splits = [continuous_splits(value_sums(rows, plain), lam, gamma)] if plain else []
            splits += [subset_splits(value_sums(rows, [j]), t, lam, gamma) for j, t in types.items() if 0 < t <= GREEDY_OVER]
            splits += [greedy_splits(value_sums(rows, [j]), lam, gamma).select("node", "feature", F.col("mask").cast("double").alias("split"), "gain", F.lit(0.0).alias("g"), F.lit(0).cast("long").alias("n")) for j, t in types.items() if t > GREEDY_OVER]
            every = splits[0]
            for s in splits[1:]:
                every = every.unionByName(s)
            found = {r["node"]: r for r in best_splits(every).collect()}
        grown = {}
        for node, (g, n) in sums.items():
            best = found.get(node)
            if best is None or n <= leaf_rows or best["gain"] <= 0:
                tree[node] = (-1, -g / (2 * n + lam))
            else:
                tree[node] = grown[node] = (best["feature"], best["split"])
        if not grown:
            break
        rows = rows.where(F.col("node").isin(*grown)).withColumn("node", _child(F.col("node"), grown, types))
    return tree


def _child(node: Column, splits: dict[int, tuple[int, float]], types: dict[int, int]) -> Column:
    out = None
    for k, (feature, split) in splits.items():
        x = F.get("features", F.lit(feature))
        if types.get(feature, CONTINUOUS) == CONTINUOUS:
            right = x > split
        else:
            right = F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int")).bitwiseAND(F.lit(int(split))) != 0
        step = F.lit(2 * k + 1).cast("long") + right.cast("long")
        out = F.when(node == k, step) if out is None else out.when(node == k, step)
    return out.otherwise(node) if out is not None else node


def predict(rows: DataFrame, tree: dict[int, tuple[int, float]], types: dict[int, int], name: str = "prediction") -> DataFrame:
    """rows with the value of their leaf: one expression, nested by level."""

    def value(k: int) -> Column:
        feature, split = tree[k]
        if feature < 0:
            return F.lit(float(split))
        right = _child(F.lit(k), {k: (feature, split)}, types) == 2 * k + 2
        return F.when(right, value(2 * k + 2)).otherwise(value(2 * k + 1))

    return rows.withColumn(name, value(0))


def residuals(rows: DataFrame, trees: list[dict], types: dict[int, int], step: float, label: Column) -> DataFrame:
    """rows with residual = label - step * the sum of the trees, and g = -2 * residual."""
    d = rows
    total = F.lit(0.0)
    for i, t in enumerate(trees):
        d = predict(d, t, types, f"_t{i}")
        total = total + F.col(f"_t{i}")
    d = d.withColumn("residual", label - F.lit(step) * total).drop(*(f"_t{i}" for i in range(len(trees))))
    return d.withColumn("g", -2 * F.col("residual"))


def boost(rows: DataFrame, types: dict[int, int], rounds: int, depth: int, step: float, label: Column, **rules) -> list[dict]:
    """Trees, each grown on what those before leave."""
    trees: list[dict] = []
    for _ in range(rounds):
        trees.append(grow(residuals(rows, trees, types, step, label).select("g", "features"), types, depth, **rules))
    return trees


def boost_classes(rows: DataFrame, types: dict[int, int], classes: int, rounds: int, depth: int, step: float, **rules) -> list[list[dict]]:
    """One-vs-all trees of each class."""
    return [boost(rows, types, rounds, depth, step, (F.col("label") == c).cast("double"), **rules) for c in range(classes)]


def evaluate_classes(rows: DataFrame, models: list[list[dict]], types: dict[int, int], step: float) -> DataFrame:
    """(rows, wrong, error_rate): the class of the largest sum, the first of equals."""
    d = rows
    for c, trees in enumerate(models):
        for i, t in enumerate(trees):
            d = predict(d, t, types, f"_c{c}_{i}")
    score = [sum((F.col(f"_c{c}_{i}") for i in range(1, len(trees))), F.col(f"_c{c}_0")) for c, trees in enumerate(models)]
    from quern.functions.vectors import argmax

    wrong = (argmax(F.array(*(F.lit(step) * s for s in score))) != F.col("label")).cast("long")
    return d.agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"), F.avg(wrong.cast("double")).alias("error_rate"))
