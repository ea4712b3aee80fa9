"""Latent Dirichlet allocation. Tokens (doc_id, pos, word, topic); counts (word, topic, n)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import log_gamma

from .tables import cut

#: Words whose counts every worker has: so many at most, and counts of them all. Tokens a task and tokens drawn at a time.
HOT, CELLS, TASK, TOGETHER = 1 << 16, 1 << 22, 1_000_000, 1 << 18


def first_topics(tokens: DataFrame, topics: int) -> DataFrame:
    """tokens (doc_id, pos, word) with a topic that depends on document and place alone."""
    return tokens.withColumn("topic", F.pmod(F.col("doc_id") + F.col("pos"), F.lit(topics)).cast("long"))


def word_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word", "topic").agg(F.count("*").alias("n"))


def with_totals(counts: DataFrame) -> DataFrame:
    """counts with the totals of topics, whose word is null."""
    rolled = counts.rollup("topic", "word").agg(F.sum("n").alias("n"), F.grouping_id().alias("_level"))
    return rolled.where(F.col("_level") <= 1).select("word", "topic", "n")  # not the total of all


def topic_changes(tokens: DataFrame) -> DataFrame:
    """tokens with new_topic: (word, topic, delta), where it is not 0."""
    moved = tokens.where("topic <> new_topic")
    each = moved.select("word", F.explode(F.array(F.struct(F.col("topic"), F.lit(-1).cast("long").alias("d")), F.struct(F.col("new_topic").alias("topic"), F.lit(1).cast("long").alias("d")))).alias("c"))
    return each.groupBy("word", F.col("c.topic").alias("topic")).agg(F.sum("c.d").alias("delta")).where("delta <> 0")


def apply_changes(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """counts after the changes, not under 0."""
    joined = counts.join(changes, ["word", "topic"], "full")
    return joined.select("word", "topic", F.greatest(F.coalesce("n", F.lit(0)) + F.coalesce("delta", F.lit(0)), F.lit(0)).alias("n"))


def active_topics(counts: DataFrame) -> DataFrame:
    """(word, active): topics that the word has."""
    return counts.groupBy("word").agg(F.count(F.when(F.col("n") > 0, 1)).alias("active"))


def sparse(counts: DataFrame) -> DataFrame:
    """(word, pairs): the word's (topic, n) that are not 0, by topic."""
    return counts.where("n > 0").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("topic", "n"))).alias("pairs"))  # at most as many as topics


def document_likelihood(tokens: DataFrame, topics: int, alpha: float) -> DataFrame:
    """(doc_id, llh) of each document's topics."""
    n = tokens.groupBy("doc_id", "topic").agg(F.count("*").alias("n"))
    some = log_gamma(F.lit(alpha))
    d = n.groupBy("doc_id").agg(F.sum(log_gamma(F.col("n") + alpha) - some).alias("s"), F.sum("n").alias("n"))
    return d.select("doc_id", (log_gamma(F.lit(topics * alpha)) + F.col("s") - log_gamma(F.col("n") + topics * alpha)).alias("llh"))


def word_likelihood(counts: DataFrame, beta: float) -> DataFrame:
    """One row: llh of the words given topics."""
    c = counts.where("n > 0")
    some, vocabulary = c.agg(F.sum(log_gamma(F.col("n") + beta) - log_gamma(F.lit(beta))), F.count_distinct("word")).first()
    all_beta = F.lit(float((vocabulary or 1) * beta))
    totals = c.groupBy("topic").agg(F.sum("n").alias("n"))  # a topic without words adds nothing
    return totals.agg((F.sum(log_gamma(all_beta) - log_gamma(F.col("n") + all_beta)) + F.lit(some or 0.0)).alias("llh"))


def gibbs(tokens: DataFrame, topics: int, alpha: float, beta: float, seed: int = 0) -> DataFrame:
    """tokens with new_topic, drawn anew token after token within each document. Counts of words and totals of topics are those before the sweep, less the token itself; documents' own counts follow each draw.

    Words that make up more than one token in `most` are fewer than `most`: their counts go to the workers as one matrix, and their tokens
    carry its row. The other words meet their tokens in a shuffle join. Tokens are dealt by document and sorted; a worker takes
    some documents at a time and draws their first tokens together, then their second ones, and so on.
    """
    spark = tokens.sparkSession
    dense = F.array(*(F.sum(F.when(F.col("topic") == k, F.col("n")).otherwise(0)) for k in range(topics)))
    words = cut(word_counts(tokens).where(F.col("word").isNotNull()).groupBy("word").agg(dense.alias("nw"), F.sum("n").alias("n")))
    nulls = tokens.where("word is null").groupBy("topic").count()  # tokens without a word count in the totals alone
    vocabulary, *sums = words.agg(F.count("*"), *(F.sum(F.get("nw", F.lit(k))) for k in range(topics))).first()
    total = np.array([x or 0 for x in sums], float)
    for k, n in nulls.collect():  # as many rows as topics
        total[k] += n
    most = max(1, min(HOT, CELLS // topics))
    least = int(total.sum()) // most
    often = words.where(F.col("n") > least).select("word", "nw").toArrow().sort_by("word")  # fewer than `most`
    matrix = often["nw"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, topics)
    hot = F.broadcast(spark.createDataFrame(pa.table({"word": often["word"].cast(pa.string()), "_hot": pa.array(np.arange(len(matrix)), pa.int32())}), "word string, _hot int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total.sum() / TASK))
    t = tokens.select("doc_id", "pos", "word", "topic")
    near = t.join(hot, "word").select(*t.columns, "_hot", F.lit(None).cast("array<long>").alias("nw"))
    rest = words.where(F.col("n") <= least).select("word", "nw")
    far = t.join(hot, "word", "left_anti").join(rest, "word").select(*t.columns, F.lit(None).cast("int").alias("_hot"), "nw")
    dealt = near.union(far).repartition(parts, "doc_id").sortWithinPartitions("doc_id", "pos", "word", "topic")
    smooth = vocabulary * beta

    def draw(block: pa.Table) -> pa.Table:
        """new_topic of whole documents, tokens in order."""
        doc, old = (block[c].to_numpy() for c in ("doc_id", "topic"))
        n = np.empty((len(doc), topics))
        row = block["_hot"].fill_null(-1).to_numpy()
        n[row >= 0] = matrix[row[row >= 0]]
        n[row < 0] = block["nw"].drop_null().combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, topics)
        n[np.arange(len(doc)), old] -= 1
        n += beta
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        sizes = np.diff(np.r_[starts, len(doc)])
        u = np.concatenate([np.random.default_rng([seed, int(d) & 0x7FFFFFFF]).random(k) for d, k in zip(doc[starts], sizes)])
        own = np.zeros((len(starts), topics))
        np.add.at(own, (np.repeat(np.arange(len(starts)), sizes), old), 1)
        order = np.argsort(-sizes, kind="stable")  # those that go on come first
        starts, sizes, own = starts[order], sizes[order], own[order]
        going = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
        new, each, all_below = np.empty_like(old), np.arange(len(starts)), np.tile(total + smooth, (len(starts), 1))
        for step, k in enumerate(going):
            at, i = starts[:k] + step, each[:k]
            was, below = old[at], all_below[:k].copy()
            below[i, was] = total[was] - 1 + smooth
            own[i, was] -= 1
            p = np.cumsum((own[:k] + alpha) * n[at] / below, axis=1)
            now = np.minimum((p <= (u[at] * p[:, -1])[:, None]).sum(axis=1), topics - 1)
            own[i, now] += 1
            new[at] = now
        return block.select(["doc_id", "pos", "word", "topic"]).append_column("new_topic", pa.array(new, pa.int64()))

    def sweep(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < TOGETHER:
                continue
            block = pa.Table.from_batches(held)
            doc = block["doc_id"].to_numpy()
            whole = int(np.searchsorted(doc, doc[-1], "left"))  # the last document may go on
            if whole:
                yield from draw(block.slice(0, whole)).to_batches()
            held = block.slice(whole).to_batches()
            n = n - whole
        if n:
            yield from draw(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(sweep, "doc_id long, pos long, word string, topic long, new_topic long")
