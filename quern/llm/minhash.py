"""Near-duplicate documents: a set-similarity join by chosen paths.

Documents are sets of word shingles, of which a document keeps `LANES` minwise tokens. A node of a tree is a path of
chosen lanes and the tokens that its documents have there. Each of `trees` trees starts with a lane of its own; a node of
more than `leaf` documents branches by `fan` further lanes, drawn by a hash of the node, so that documents alike stay
together on some branch; small nodes are compared exhaustively. Documents of similarity s miss each other in a tree's first
branching with probability 1 - s, so 8 trees miss 0.2**8 of the pairs at 0.8; further branchings keep a pair with
probability 1 - (1 - s)**2 each. From `depth` branchings on only loose nodes branch, those whose documents agree with one of
them, drawn by hash, on less than `tight` of the lanes in the mean: unrelated documents need more branchings the more of them there are.

Large nodes that are tight, or left when a branching lessens the mean size of a row's loose node by under a tenth, after `deepest` of them, or with FEW_ROWS rows at most or more than one for each document and tree, hold documents that mostly agree nearly everywhere, of which few pairs are needed to
connect them: each is compared with the node's pivot; then those that links do not yet connect with most of the others
that share large nodes are compared with all of these, in blocks, on their full sets, in as many passes as keep a pass's shuffle under half the bytes of all sets. Other pairs are compared first by the share of
equal minwise tokens, 4.5 standard deviations below the threshold, then by their full sets, so that each link is exact. Equal sets are one representative
throughout, found by a digest with partial aggregation. Links, components and sets stay on the executors.

Texts without words, null among them, have the empty set and link with nothing. With fewer words than a shingle takes, the
whole sequence is one shingle. Only A-Z are lower-cased; words are split at ASCII white space. Repeated rows each get a row.
Inside, a row is named by a hash of its id and text, so that different texts of one id are documents of their own; ids are only reported.
Of a component the rows of the least id are kept, and if these have different sets, those of one set; null ids count as the least id and are never
reported as a component; an empty table gives an empty result. Very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, inf

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release, slices, texts
from .graphs import components, lookup

LANES = 64
BLOCK = 4096
FEW_ROWS = 2**17  # of large nodes: up to so many meet in blocks without further branchings
PASS_BYTES = 2**26
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, LANES, dtype=np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    take = min(words, len(h))
    mixed = np.full(n, np.uint64(take))
    for j in range(take):
        mixed = (mixed ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of each lane's hash over the set."""
    out = np.full(LANES, np.uint64(2**64 - 1))
    for at in range(0, len(s), 16384):
        v = s[None, at : at + 16384] * _A[:, None] + _B[:, None]
        out = np.minimum(out, v.min(1))
    return out


def _prepare(docs: DataFrame, words: int, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sizes, keys, roots, sigs = [], [], [], []
            for t in texts(batch, "_text"):
                s = shingle_set(t, words)
                m = minwise(s)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                roots.append((m[:trees] >> np.uint64(1)).astype(np.int64).tolist())
                sigs.append(((m >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["id", "doc", "n", "key", "roots", "sig"])

    return docs.mapInArrow(run, "id long, doc long, n long, key binary, roots array<long>, sig binary")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return (a == b).mean(-1) >= least


def _leaf_pairs(leaves: DataFrame, leaf: int, least: float, threshold: float) -> DataFrame:
    """Pairs within small nodes. Rows come sorted by node; a node's rows are held, at most `leaf` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(rows) -> tuple[np.ndarray, np.ndarray]:
            ids, n, sig = rows
            i, j = np.triu_indices(len(ids), 1)
            fine = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & _alike(sig[i], sig[j], least)
            i, j = ids[i[fine]], ids[j[fine]]
            return np.minimum(i, j), np.maximum(i, j)

        held_node, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            ids, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(-1, LANES)
            starts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            found = []
            for s, e in zip(starts, starts[1:]):
                rows = (ids[s:e], n[s:e], sig[s:e])
                if node[s] == held_node:
                    held = tuple(np.concatenate(x) for x in zip(held, rows))
                else:
                    if held is not None and len(held[0]) > 1:
                        found.append(compare(held))
                    held_node, held = node[s], rows
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held is not None and len(held[0]) > 1:
            a, b = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return leaves.select("node", "rep", "n", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _filter_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """Of rows (a, b, sig_a, sig_b) those with enough equal lanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, LANES) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(_alike(a, b, least)))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sameness(large: DataFrame, few_nodes: bool) -> DataFrame:
    """(node, same): the share of lanes on which its documents agree, in the mean, with one of them, drawn by hash."""
    drawn = large.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "rep").alias("o"), "rep", F.col("sig").alias("sig_b"))).alias("p")).select("node", F.col("p.sig_b").alias("sig_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, LANES) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((a == b).mean(-1))], names=["node", "same"])

    same = lookup(large, checkpoint(drawn), "node", "rep", few_nodes).select("node", "sig", "sig_b").mapInArrow(run, "node long, same double")
    return checkpoint(same.groupBy("node").agg(F.avg("same").alias("same")))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets have percent * union <= 100 * intersection. The sets of texts that no pair names are never made."""
    ids = checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = ids.count() <= broadcast_rows
    wanted = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in texts(batch, "_text")], pa.binary())], names=["id", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            fine = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    made = wanted.mapInArrow(sets, "id long, set binary").dropDuplicates(["id"]) if not few else wanted.mapInArrow(sets, "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))
    made = checkpoint(made)
    left = pairs.join(made.withColumnRenamed("set", "set_a"), pairs["a"] == made["id"]).select("a", "b", "set_a")
    both = left.join(made.withColumnRenamed("set", "set_b"), F.col("b") == F.col("id")).select("a", "b", "set_a", "set_b")
    return checkpoint(both.mapInArrow(check, "a long, b long"))


def _rest(mixed: DataFrame, docs: DataFrame, words: int, percent: int, few: bool, few_nodes: bool, most_bytes: int, block: int = BLOCK, block_bytes: int = 32_000_000, least: int = 3) -> DataFrame:
    """Links between documents of different labels that share a large node. mixed: node, rep, label, n.

    Documents that nodes connect are a family. Those outside the family's main label, in blocks, meet all of the family, in blocks: a pair of
    blocks is one task's bounded work, on full sets, and gives at most one link for a document and a label. A block has about so many documents and
    bytes of sets at most; each set is sent to as many tasks as the other side has blocks. Smaller families get up to `least` blocks, to be shared out.
    Pairs of blocks are dealt to passes that send about `most_bytes` of sets each, whose shuffle files go before the next.
    """
    lowest = mixed.groupBy("node").agg(F.min("rep").alias("m"))
    family = components(lookup(mixed, lowest, "node", "rep", few_nodes).select("rep", "m").distinct(), "rep", "m").withColumnRenamed("component_id", "family")
    members = checkpoint(mixed.select("rep", "label", "n").distinct().join(family, F.col("rep") == F.col("id")).select("rep", "label", "family", "n"))
    by_label = members.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / block), F.ceil(s * 8 / block_bytes), F.least(F.lit(least), F.ceil(c * 4 / block)))
    sizes = by_label.groupBy("family").agg(F.max(F.struct("c", "label", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    odd_c, odd_s = F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")
    sizes = checkpoint(sizes.where(odd_c > 0).select("family", F.col("m.label").alias("main"), blocks(F.col("c"), F.col("s")).alias("nb"), blocks(odd_c, odd_s).alias("mb"), "s", odd_s.alias("odd_s")))
    passes = max(1, ceil((sizes.agg(F.sum(8.0 * (F.col("s") * F.col("mb") + F.col("odd_s") * F.col("nb")))).first()[0] or 0) / most_bytes))
    ids = checkpoint(lookup(members.drop("n"), sizes.drop("s", "odd_s"), "family", "rep", few_nodes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, words).tobytes() for t in texts(batch, "_text")], pa.binary())], names=["rep", "set"])

    wanted = docs.join(F.broadcast(ids.select(F.col("rep").alias("id"))) if few else ids.select(F.col("rep").alias("id")), "id", "left_semi")
    made = wanted.mapInArrow(sets, "rep long, set binary").groupBy("rep").agg(F.first("set").alias("set"))
    full = checkpoint(made.join(F.broadcast(ids) if few else ids, "rep"))
    release(docs)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = full.select("family", own("nb").alias("i"), upto("mb").alias("j"), F.lit(0).alias("side"), "rep", "label", "set")
    odd = full.where("label <> main").select("family", upto("nb").alias("i"), own("mb").alias("j"), F.lit(1).alias("side"), "rep", "label", "set")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 1], group[group["side"] == 0]
        out = []
        if len(a) and len(b):
            parts = [np.frombuffer(bytes(x), np.uint64) for x in b["set"]]
            size = np.array([len(x) for x in parts])
            known, code = np.unique(np.concatenate(parts), return_inverse=True)
            starts = np.cumsum(size) - size
            ids_b, labels = b["rep"].to_numpy(), b["label"].to_numpy()
            for rep, mine, data in zip(a["rep"], a["label"], a["set"]):
                x = np.frombuffer(bytes(data), np.uint64)
                at = np.searchsorted(known, x)
                at = at[at < len(known)]
                mark = np.zeros(len(known), np.int32)
                mark[at[np.isin(known[at], x)]] = 1
                both = np.add.reduceat(mark[code], starts)
                link = (labels != mine) & (100 * both >= percent * (size + len(x) - both))
                _, first = np.unique(labels[link], return_index=True)
                out += [(rep, other) for other in ids_b[link][first]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    found = []
    for k in range(passes):
        turn = every.union(odd).where(F.pmod(F.xxhash64("family", "i", "j"), F.lit(passes)) == k) if passes > 1 else every.union(odd)
        found.append(checkpoint(turn.groupBy("family", "i", "j").applyInPandas(meet, "a long, b long")))
        release(docs)
    return reduce(DataFrame.union, found)


NULL = -(2**63)


def _named(docs: DataFrame, key: str, text: str) -> tuple:
    """The key, a null one least, the text, and the row's name: a hash of both."""
    doc, value = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL)), F.col(f"`{text}`").cast("string")
    return doc, value, F.xxhash64(doc, value)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 8, leaf: int = 32, depth: int = 2, fan: int = 2, key: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, tight: float = 0.65, deepest: int = 10) -> DataFrame:
    """Rows of key, n_shingles, component_id, kept - one for each row of `docs`."""
    judged = _judged(docs, words, percent, trees, leaf, depth, fan, key, text, broadcast_rows, tight, deepest)
    back = lambda c: F.nullif(F.col(c), F.lit(NULL))
    return judged.select(back("doc").alias(key), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"), "kept")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 8, leaf: int = 32, depth: int = 2, fan: int = 2, key: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, tight: float = 0.65, deepest: int = 10) -> DataFrame:
    """The rows of `docs` that are kept; a verdict is joined back by key and text."""
    gone = checkpoint(_judged(docs, words, percent, trees, leaf, depth, fan, key, text, broadcast_rows, tight, deepest).where("not kept").select(F.col("doc").alias("_doc"), F.col("id").alias("_name")).distinct())
    doc, _, name = _named(docs, key, text)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), doc.alias("_doc"), name.alias("_name"))
    kept = rows.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, ["_name", "_doc"], "left_anti")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _judged(docs: DataFrame, words: int, percent: int, trees: int, leaf: int, depth: int, fan: int, key: str, text: str, broadcast_rows: int, tight: float, deepest: int) -> DataFrame:
    """(id, doc, n, component_id, kept) for each row: its name, key, set size, the least key of its component, and whether it stands for that."""
    threshold = percent / 100
    least = threshold - 4.5 * (threshold * (1 - threshold) / LANES) ** 0.5
    doc, value, name = _named(docs, key, text)
    source = docs.select(name.alias("id"), value.alias("_text"), doc.alias("doc"))
    every = checkpoint(_prepare(source, words, trees))
    reps = checkpoint(every.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sig").alias("sig")))
    count, shingles = reps.agg(F.count("*"), F.sum("n")).first()
    few = count * trees <= 8 * broadcast_rows

    members = reps.select("rep", "n", "sig", F.posexplode("roots").alias("tree", "root")).select(F.xxhash64("tree", "root").alias("node"), "rep", "n", "sig")
    pairs, ended, left = [], [], inf
    for level in range(max(depth, deepest) + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
        sizes = checkpoint(sizes)
        members = lookup(members, sizes, "node", "rep", sizes.count() <= broadcast_rows)
        pairs.append(_leaf_pairs(members.where(F.col("c") <= leaf), leaf, least, threshold))
        large = members.where(F.col("c") > leaf).select("node", "rep", "n", "sig", "c")
        nodes, rows = sizes.where(F.col("c") > leaf).agg(F.count("*"), F.sum("c")).first()
        if not nodes:
            break
        if level >= depth:
            large = checkpoint(large)
            if level >= deepest or rows <= FEW_ROWS or level > depth and rows > trees * count:
                ended.append(large.drop("c"))
                break
            large = checkpoint(lookup(large, _sameness(large, nodes <= broadcast_rows // 10), "node", "rep", nodes <= broadcast_rows))
            before, left = left, large.where(F.col("same") < tight).agg(F.avg("c")).first()[0]
            if left and left > 0.9 * before:  # these share so much that branching no longer parts them
                ended.append(large.drop("c", "same"))
                break
            ended.append(large.where(F.col("same") >= tight).drop("c", "same"))
            large = large.where(F.col("same") < tight)
            if not left:
                break
        lanes = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(LANES)).cast("int") for j in range(fan)]
        token = lambda lane: F.substring(F.col("sig"), lane * 2 + 1, F.lit(2))
        branch = F.array(*(F.xxhash64("node", lane, token(lane)) for lane in lanes))
        members = checkpoint(large.select(F.explode(branch).alias("node"), "rep", "n", "sig"))
        release(docs)
    large = checkpoint(reduce(DataFrame.union, ended or [members.where("false").select("node", "rep", "n", "sig")]))

    # large nodes: each document with the pivot, the one that is in most large nodes: it has most of the common tokens
    central = large.groupBy("rep").agg(F.count("*").alias("d"))
    large = checkpoint(lookup(large, central, "rep", "node", few))
    order = F.struct((-F.col("d")).alias("d"), F.xxhash64("rep").alias("o"), F.col("rep").alias("p"))
    pivots = checkpoint(large.groupBy("node").agg(F.min(order).getField("p").alias("p")).join(reps.select(F.col("rep").alias("p"), F.col("sig").alias("sig_b")), "p"))
    few_nodes = pivots.count() <= broadcast_rows // 10
    stars = lookup(large, pivots, "node", "rep", few_nodes).where("rep <> p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b"), F.col("sig").alias("sig_a"), "sig_b").dropDuplicates(["a", "b"])
    pairs.append(_filter_pairs(stars, least))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.union(p)
    found = checkpoint(found.distinct())
    del pairs, p, members, sizes, ended, central, pivots, stars
    release(docs)
    links = _verified(found, source, words, percent, broadcast_rows)
    del found
    linked = components(links)
    release(docs)

    # of large nodes, what links do not connect with most of the others meets all of them
    label = lookup_left(large, linked, few)
    counts = label.groupBy("node", "label").agg(F.count("*").alias("c"))
    mixed_nodes = checkpoint(counts.groupBy("node").agg(F.count("*").alias("labels")).where("labels > 1").select("node"))
    if not mixed_nodes.isEmpty():
        mixed = checkpoint(lookup(label.select("node", "rep", "label", "n"), mixed_nodes, "node", "rep", few_nodes))
        more = checkpoint(_rest(mixed, source, words, percent, few, few_nodes, max(PASS_BYTES, 4 * shingles)))
        release(docs)
        if not more.isEmpty():
            linked = components(links.union(more))

    # of a component, the least key is reported, and of that key the set of the least digest stands for it
    state = reps.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("key", "doc", F.coalesce("component_id", "rep").alias("c"))
    shared = state.groupBy("c").agg(F.min(F.struct("doc", "key")).alias("first"))
    state = lookup(checkpoint(state), checkpoint(shared), "c", "key", few).select("key", F.col("first.doc").alias("component_id"), (F.col("key") == F.col("first.key")).alias("own"))
    full = lookup(every.where("n > 0").select("id", "doc", "n", "key"), state, "key", "id", few)
    full = full.select("id", "doc", "n", "component_id", (F.col("own") & (F.col("doc") == F.col("component_id"))).alias("kept"))
    return full.union(every.where("n = 0").select("id", "doc", "n", F.col("doc").alias("component_id"), F.lit(True).alias("kept")))


def lookup_left(large: DataFrame, linked: DataFrame, few: bool) -> DataFrame:
    """large with `label`: the component so far, or the document itself."""
    joined = large.join(F.broadcast(linked) if few else linked, large["rep"] == linked["id"], "left")
    return joined.select("node", "rep", "n", "sig", F.coalesce("component_id", "rep").alias("label"))
