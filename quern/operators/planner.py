"""The cost model of servers and workers, and plans that move blocks between them. Tables here have a row an executor."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


RATIO, TERMS, CLASSES = 1.25, 18, 64  # a series' relative error is under 9 ** -TERMS; bandwidths that are summed apart


def cost_model(executors: DataFrame, batch: float, pull: float) -> DataFrame:
    """(workers, cost) for each number of workers 1..N-1. executors (id, throughput, bandwidth), a batch of `batch` items and `pull` bytes pulled an item.

    The fastest executors work and the others serve: cost(W) = batch / sum over workers of
    1 / (1 / throughput + pull * max(1 / bandwidth, c)), c = W / bandwidth of all servers. c grows with W, so each worker's own bandwidth binds up to some W
    and c from there on. Both sets are running sums over W; in the second, workers whose 1 / throughput = m (1 + t), |t| <= 1/9, share one centre m, and
    the sum of 1 / (m (1 + t) + pull c) is a series in the sums of powers of t. So the work grows as N log N, in one task: a row an executor.
    """
    order = Window.orderBy(F.desc("thr"), "id")
    plain = executors.select("id", F.col("throughput").cast("double").alias("thr"), F.col("bandwidth").cast("double").alias("bw"))
    ranked = plain.select(F.row_number().over(order).cast("long").alias("rank"), F.lit(0).alias("_one"), (1 / F.col("thr")).alias("own"), (1 / F.col("bw")).alias("least"), "bw")

    def costs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        own, least, bw = (rows[c].to_numpy("float64", na_value=np.nan) for c in ("own", "least", "bw"))
        n, w = len(rows), np.arange(1, len(rows))
        known = np.nan_to_num(bw[::-1])  # a null bandwidth serves nothing and never binds
        servers = np.cumsum(known)[::-1][1:]
        if (servers == 0).any():
            raise ValueError("servers have no bandwidth")
        c = w / servers
        least = np.where(np.isnan(least), -np.inf, least)
        counts = ~np.isnan(own)  # a null throughput adds nothing
        even = counts & (own > 0) & np.isfinite(own) & bool((np.diff(c) >= 0).all() and (c > 0).all() and pull >= 0)
        first = np.arange(n)  # places in w where a worker counts
        bound = np.maximum(first, np.searchsorted(c, least, "left")) if even.any() else first
        rate = np.zeros(n - 1)

        e = np.flatnonzero(even)
        own_rate = np.zeros(len(e))
        use = bound[e] > first[e]
        own_rate[use] = 1 / (own[e][use] + pull * least[e][use])
        for value in np.unique(least[e][use]) if len(np.unique(least[e][use])) <= CLASSES else [None]:  # workers of one bandwidth leave together
            g = e[use] if value is None else e[use][least[e][use] == value]
            r = own_rate[use] if value is None else own_rate[use][least[e][use] == value]
            begin = np.bincount(first[g], r, n).astype(np.longdouble).cumsum()[: n - 1]
            if value is None:
                rate += (begin - np.bincount(bound[g], r, n).astype(np.longdouble).cumsum()[: n - 1]).astype(float)
            else:
                rate += np.where(c < value, begin.astype(float), 0.0)
        block = np.floor(np.log(own[e]) / np.log(RATIO)).astype(int)
        for k in np.unique(block):
            g = e[block == k]
            g = g[np.argsort(bound[g], kind="stable")]
            m = RATIO**k * (1 + RATIO) / 2
            t = own[g] / m - 1
            here = slice(bound[g[0]], n - 1)
            many = np.searchsorted(bound[g], np.arange(n - 1)[here], "right")
            y, total, power = 1 / (1 + pull * c[here] / m), 0.0, np.ones(len(g))
            sums = []
            for _ in range(TERMS):
                sums.append(np.r_[0.0, np.cumsum(power)])
                power = power * -t
            for s in reversed(sums):
                total = total * y + s[many]
            rate[here] += total * y / m
        for i in np.flatnonzero(counts & ~even):  # not positive: one at a time
            rate[i:] += 1 / (own[i] + pull * np.maximum(least[i], c[i:]))
        some = counts.cumsum()[: n - 1] > 0
        return pd.DataFrame({"workers": w, "cost": np.divide(batch, rate, out=np.full(n - 1, np.nan), where=some)})  # no worker that counts: null

    return ranked.groupBy("_one").applyInPandas(costs, "workers long, cost double")


def best_plan(costs: DataFrame, now: int, threshold: float) -> DataFrame:
    """(workers, cost, benefit, act): the least cost, the fewest workers of equals, and whether it gains enough on what there is now."""
    least = costs.agg(F.min(F.struct("cost", "workers")).alias("b"), F.max(F.when(F.col("workers") == now, F.col("cost"))).alias("now"))
    gain = (F.col("now") - F.col("b.cost")) / F.col("now")
    return least.select(F.col("b.workers").alias("workers"), F.col("b.cost").alias("cost"), gain.alias("benefit"), (gain >= threshold).alias("act"))


def allocate_blocks(executors: DataFrame, total: int) -> DataFrame:
    """executors (id, share) with `blocks`: the floor of each one's share of all blocks, what is left dealt one each by id."""
    everyone = Window.partitionBy()
    base = F.floor(F.lit(total) * F.col("share") / F.sum("share").over(everyone)).cast("long")
    d = executors.withColumn("base", base).withColumn("rank", F.row_number().over(Window.orderBy("id")))
    left = F.lit(total) - F.sum("base").over(everyone)
    return d.withColumn("left", left).select("id", "share", (F.col("base") + (F.col("rank") <= F.col("left")).cast("long")).alias("blocks"))


def transfers(now: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target, blocks): senders' surplus and receivers' need laid out on one line by id, each overlap a transfer. now, wanted: (id, blocks) of the same executors."""
    d = now.select("id", F.col("blocks").alias("a")).join(wanted.select("id", F.col("blocks").alias("b")), "id")
    line = Window.orderBy("id")

    def laid(side: DataFrame) -> DataFrame:
        end = F.sum("n").over(line)
        return side.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))

    send = laid(d.where("a > b").select("id", (F.col("a") - F.col("b")).alias("n"))).select(F.col("id").alias("source"), F.col("start").alias("s0"), F.col("end").alias("s1"))
    take = laid(d.where("b > a").select("id", (F.col("b") - F.col("a")).alias("n"))).select(F.col("id").alias("target"), F.col("start").alias("t0"), F.col("end").alias("t1"))
    met = send.join(take, (F.col("s0") < F.col("t1")) & (F.col("t0") < F.col("s1")))
    return met.select("source", "target", (F.least("s1", "t1") - F.greatest("s0", "t0")).cast("long").alias("blocks"))


def assign_roles(throughputs: list[float], bandwidths: list[float], pull: float, most: int = 14) -> tuple[list[int], float]:
    """Servers among a few unequal executors, for the least cost of a unit of work: all subsets are tried, so at most `most` executors."""
    n = len(throughputs)
    if n > most:
        raise ValueError(f"at most {most} executors")
    best = ([], float("inf"))
    for k in range(1, n):
        for servers in combinations(range(n), k):
            bw = sum(bandwidths[i] for i in servers)
            rate = sum(1 / (1 / throughputs[i] + pull * max(1 / bandwidths[i], (n - k) / bw)) for i in range(n) if i not in servers)
            if 1 / rate < best[1]:
                best = (list(servers), 1 / rate)
    return best


# plans of operations

#: Which kinds of operation wait for which, on one executor: fixed rules of a reconfiguration.
AFTER = {"associate": ("allocate", "create"), "subscribe": ("allocate", "create"), "move": ("associate",), "start": ("allocate", "subscribe", "move"), "unassociate": ("move",), "unsubscribe": ("stop",), "deallocate": ("unassociate", "unsubscribe", "stop")}


def dependencies(operations: DataFrame) -> DataFrame:
    """operations (op_id, kind, executor) to (before, after): pairs of operations on one executor of which one waits for the other."""
    rules = operations.sparkSession.createDataFrame([(a, b) for b, earlier in AFTER.items() for a in earlier], "k1 string, k2 string")
    a = operations.select(F.col("op_id").alias("before"), F.col("kind").alias("k1"), "executor")
    b = operations.select(F.col("op_id").alias("after"), F.col("kind").alias("k2"), "executor")
    return a.join(F.broadcast(rules), "k1").join(b, ["k2", "executor"]).select("before", "after")


def run_plan(operations: dict, waits: dict[object, set]) -> list[list]:
    """Operations in rounds: each round's operations wait only for those of rounds before. operations: id -> a function to call."""
    left, done, rounds = set(operations), set(), []
    while left:
        ready = sorted(o for o in left if waits.get(o, set()) <= done)
        if not ready:
            raise ValueError("operations wait for each other")
        for o in ready:
            operations[o]()
        done.update(ready)
        left.difference_update(ready)
        rounds.append(ready)
    return rounds


def fifo_schedule(jobs: list[tuple], executors: int) -> list[tuple]:
    """(job, start) of jobs (job, arrival, executors needed, duration), admitted in the order they arrive as executors are free."""
    running: list[tuple] = []
    out, clock, free = [], 0.0, executors
    for job, arrival, need, duration in sorted(jobs, key=lambda j: (j[1], j[0])):
        if need > executors:
            raise ValueError(f"{job} needs more executors than there are")
        clock = max(clock, arrival)
        while True:
            for end, n in [r for r in running if r[0] <= clock]:
                running.remove((end, n))
                free += n
            if free >= need:
                break
            clock = min(end for end, _ in running)
        out.append((job, clock))
        running.append((clock + duration, need))
        free -= need
    return out
