"""Near-duplicate vectors: all pairs of cosine >= a threshold, by a dual traversal of cover trees.

On unit vectors a cosine is a chord length, a metric. The tree's levels have halving radii: the root (2: the whole
sphere), cells around at most `cells` centres, and in each block of a cell nets of radius 1/2, 1/4 and 1/8, nested. Every
node keeps its true covering radius R, the distance to its farthest member. Two nodes are pruned when the
distance of their centres exceeds threshold + R + R'; when it is at most threshold - R - R', all their pairs are
links; otherwise their children are compared. So pairs are exact whatever the centres. The pruning of pairs of
cells happens before anything is shuffled; then each pair of blocks that is left is one task's bounded work.

Equal vectors are one representative with a weight, before anything is compared. A cell of many vectors is split into
blocks by hash, so a hot cell is many tasks. Pairs are not written out: a task adds up links a vector and emits, of its
links, a spanning forest, which connects what the links connect.

Null, zero and non-finite vectors, and vectors with such components, link with nothing. Shorter vectors count as padded
with zeros. Repeated ids are separate vectors; an empty table gives an empty result; labels and other columns are not read.
The centres come from a bounded sample (`sample` rows of least hash): they decide how much is pruned, never what is found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graphs import components, lookup

RADII = (0.5, 0.25, 0.125)
SLACK = 1e-9


def units(data: list[bytes]) -> np.ndarray:
    """Raw vectors of doubles as rows of unit length."""
    width = max(map(len, data), default=8)
    x = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data)).reshape(len(data), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def nets(x: np.ndarray) -> np.ndarray:
    """(rows, levels): of each vector its centre at each radius, a place among the rows; each net refines the one before."""
    out = np.zeros((len(x), len(RADII)), np.int32)
    groups = [np.arange(len(x))]
    for level, radius in enumerate(RADII):
        least, finer = 1 - radius * radius / 2, []
        for rest in groups:
            while len(rest):
                near = x[rest] @ x[rest[0]] >= least
                near[0] = True
                out[rest[near], level] = rest[0]
                finer.append(rest[near])
                rest = rest[~near]
        groups = finer
    return out


class Tree:
    """The nets of a block; a node at level i is a centre, its children the centres of level i + 1 in it, at last the vectors."""

    def __init__(self, x: np.ndarray, centres: np.ndarray):
        self.x = x
        levels = [*centres.T, np.arange(len(x))]
        self.top = np.unique(levels[0])
        self.radius, self.members, self.children = [], [], []
        for i, c in enumerate(levels):
            r = np.zeros(len(x))
            np.maximum.at(r, c, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x * x[c]).sum(1))))
            self.radius.append(r)
            order = np.argsort(c, kind="stable")
            starts = np.searchsorted(c[order], np.arange(len(x) + 1))
            self.members.append((order, starts))
            if i + 1 < len(levels):
                below = np.unique(levels[i + 1])
                order = below[np.argsort(c[below], kind="stable")]
                self.children.append((order, np.searchsorted(c[order], np.arange(len(x) + 1))))


def spread(lists: tuple, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `nodes`, and what the list of each holds, in a row each."""
    order, starts = lists
    n = starts[nodes + 1] - starts[nodes]
    place = np.repeat(np.arange(len(nodes)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return place, order[starts[nodes][place] + at]


def products(lists_a: tuple, a: np.ndarray, lists_b: tuple, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (of a's list, of b's list) for each pair of nodes."""
    place, left = spread(lists_a, a)
    inner, right = spread(lists_b, b[place])
    return left[inner], right


def dual(a: Tree, b: Tree, threshold: float, same: bool, chunk: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of places (in a, in b); of one block with itself each pair in both orders, no vector with itself."""
    reach = math.sqrt(2 - 2 * threshold)
    last = len(RADII)

    def split(level: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        near = d <= reach + a.radius[level][i] + b.radius[level][j] + SLACK
        i, j, d = i[near], j[near], d[near]
        if level == last:
            link = (a.x[i] * b.x[j]).sum(1) >= threshold
            yield i[link], j[link]
            return
        sure = d <= reach - a.radius[level][i] - b.radius[level][j] - SLACK
        sure &= (a.radius[level][i] > 0) | (b.radius[level][j] > 0)
        for kind, lists_a, lists_b in ((sure, a.members[level], b.members[level]), (~sure, a.children[level], b.children[level])):
            p, q = i[kind], j[kind]
            sizes = (lists_a[1][p + 1] - lists_a[1][p]).astype(np.int64) * (lists_b[1][q + 1] - lists_b[1][q])
            groups = np.cumsum(sizes) // chunk if len(sizes) else sizes
            for g in np.unique(groups):
                own = groups == g
                left, right = products(lists_a, p[own], lists_b, q[own])
                if kind is sure:
                    yield left, right
                else:
                    dist = np.concatenate([np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[left[s : s + chunk]] * b.x[right[s : s + chunk]]).sum(1))) for s in range(0, len(left), chunk)]) if len(left) else np.zeros(0)
                    yield from split(level + 1, left, right, dist)

    rows = max(1, 4_000_000 // max(1, len(b.top)))
    for at in range(0, len(a.top), rows):
        part = a.top[at : at + rows]
        d = chord(a.x[part], b.x[b.top])
        near = d <= reach + a.radius[0][part][:, None] + b.radius[0][b.top][None] + SLACK
        i, j = np.nonzero(near)
        for left, right in split(0, part[i], b.top[j], d[i, j]):
            if same and len(left):
                other = left != right
                left, right = left[other], right[other]
            if len(left):
                yield left, right


class Forest:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Least places win; rounds of pointer jumping over whole arrays."""
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def root(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (r != (s := self.up[r])).any():
            r = s
        return r


def _compare(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """All rows of a pair of blocks; `side` 0 and 1, or 0 alone for a block with itself."""
        parts = [g.sort_values("rep") for _, g in sorted(group.groupby("side"))]
        if len(parts) == 1 and group["lo"].iloc[0] != group["hi"].iloc[0]:
            return pd.DataFrame({"id": [], "links": [], "other": []}, dtype="int64")
        x = units([bytes(v) for g in parts for v in g["vector"]])
        n = len(parts[0])
        trees = [Tree(x[:n] if i == 0 else x[n:], np.stack(g["nets"].to_numpy())) for i, g in enumerate(parts)]
        weight = np.concatenate([g["weight"].to_numpy() for g in parts])
        ids = np.concatenate([g["rep"].to_numpy() for g in parts])
        links, forest, shift = np.zeros(len(ids), np.int64), Forest(len(ids)), n if len(parts) == 2 else 0
        for i, j in dual(trees[0], trees[-1], threshold, shift == 0):
            np.add.at(links, i, weight[j + shift])
            if shift:
                np.add.at(links, j + shift, weight[i])
            forest.join(i, j + shift)
        some = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[some], "links": links[some], "other": ids[forest.root(some)] if len(some) else some})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", cells: int = 256, sample: int = 4096, block: int = 4096) -> DataFrame:
    """Rows of key, n_links, component_id, kept - one for each row of `vectors`."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list = []
            for v in batch.column(1).to_pylist():
                x = np.array([], float) if v is None or None in v else np.array(v, float)
                x = np.trim_zeros(x, "b") + 0.0  # padding with zeros changes nothing; -0 is 0
                with np.errstate(over="ignore"):
                    fine = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
                if fine:
                    x = x / 2.0 ** math.frexp(np.abs(x).max())[1]  # so that squares neither overflow nor vanish
                data.append(x.tobytes() if fine else None)
            digests = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], names=["id", "digest", "vector"])

    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(prepare, "id long, digest binary, vector binary")
    rows = checkpoint(rows)
    fine = rows.where("digest is not null")
    reps = checkpoint(fine.groupBy("digest").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("rep"), F.count("*").alias("weight"), F.min("vector").alias("vector")))
    total = reps.count()
    if total == 0:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    block = min(block, max(256, total // 16))
    picked = units([bytes(r[0]) for r in reps.select("vector", "digest").orderBy("digest").limit(sample).select("vector").collect()])
    centres = _centres(picked, min(cells, max(1, total // block // 2)))
    shared = spark.sparkContext.broadcast(centres)  # at most `cells` vectors

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = units([v.ljust(c.shape[1] * 8, b"\0") for v in batch.column(2).to_pylist()]) if batch.num_rows else np.zeros(c.shape)
            x, y = _same_width(x, c)
            cell = np.empty(len(x), np.int32)
            far = np.empty(len(x))
            for at in range(0, len(x), 4096):
                d = chord(x[at : at + 4096], y)
                cell[at : at + 4096], far[at : at + 4096] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell[: batch.num_rows]), pa.array(far[: batch.num_rows])], names=["rep", "weight", "vector", "cell", "far"])

    placed = checkpoint(reps.select("rep", "weight", "vector").mapInArrow(locate, "rep long, weight long, vector binary, cell int, far double"))
    sizes = {r[0]: (r[1], r[2]) for r in placed.groupBy("cell").agg(F.count("*"), F.max("far")).collect()}  # at most `cells` rows
    blocks = {c: math.ceil(n / block) for c, (n, _) in sizes.items()}
    reach = math.sqrt(2 - 2 * threshold)
    gap = chord(centres, centres)
    near = [(a, b, blocks[b]) for a in sizes for b in sizes if gap[a, b] <= reach + sizes[a][1] + sizes[b][1] + 1e-6]

    count = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]), F.col("cell"))
    placed = placed.withColumn("at", F.col("cell").cast("long") * 2**32 + F.pmod(F.xxhash64("rep"), count))

    def net(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        return pd.DataFrame({"rep": group["rep"], "weight": group["weight"], "vector": group["vector"], "cell": group["cell"], "at": group["at"], "nets": list(nets(units([bytes(v) for v in group["vector"]])))})

    treed = checkpoint(placed.groupBy("at").applyInPandas(net, "rep long, weight long, vector binary, cell int, at long, nets array<int>"))
    pairs = spark.createDataFrame(near, "cell int, other int, n int")
    other = F.col("other").cast("long") * 2**32 + F.col("j")
    sides = treed.join(F.broadcast(pairs), "cell").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("o", other)
    sides = sides.select(F.least("at", "o").alias("lo"), F.greatest("at", "o").alias("hi"), (F.col("at") > F.col("o")).cast("int").alias("side"), "rep", "weight", "vector", "nets")
    found = checkpoint(sides.groupBy("lo", "hi").applyInPandas(_compare(threshold), "id long, links long, other long"))

    linked = components(found, "id", "other")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    state = reps.select("digest", "rep", "weight").join(counts, F.col("rep") == counts["id"], "left").drop("id").join(linked.withColumnRenamed("id", "_id"), F.col("rep") == F.col("_id"), "left")
    state = state.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = lookup(fine.select("id", "digest"), state, "digest", "id", total <= 1_000_000).select("id", "n_links", "component_id")
    out = out.union(rows.where("digest is null").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _same_width(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(x.shape[1], y.shape[1])
    return tuple(np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (x, y))


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """n rows far apart: each next one is the farthest from those before."""
    out = [0]
    far = chord(x, x[:1])[:, 0]
    while len(out) < min(n, len(x)):
        out.append(int(far.argmax()))
        far = np.minimum(far, chord(x, x[out[-1] :][:1])[:, 0])
    return x[out]
