"""Byte-level BPE encoding and decoding with a given table of ranks.

Encoding folds ranked merges over the byte arrays of distinct words. Words are the matches of the split pattern; a
worker keeps the ids of words it has met in a bounded memo and folds the new ones of a batch together, a round of merges
at a time for all of them: the least rank among a word's adjacent pairs is merged, until no pair has a rank. Decoding
concatenates the binary pieces of the ids with built-in functions. Nothing is shuffled.

`fold_column` is the same fold as a Spark higher-order function over a literal rank map.

Null texts count as empty (no ids); whole texts are encoded however long; repeated rows, empty tables and further
columns need no care, as rows stand alone and only key and text are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

NONE = np.int32(2**31 - 1)
_LONE = re.compile(r"\S++(?:[ \n]\S++)*+")  # no white space but lone spaces and lone line feeds, none at the ends


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class PairRanks:
    """The rank of the token that two tokens make, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        made = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    made[a << 32 | b] = rank
        self.keys = np.array(sorted(made), np.int64)
        self.ranks = np.array([made[k] for k in self.keys.tolist()], np.int32)
        self.keys, self.ranks = np.append(self.keys, np.int64(2**62)), np.append(self.ranks, NONE)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


class BpeEncoder:
    """text -> ids as little-endian unsigned 32-bit bytes, with a memo of at most `memo` stretches of text."""

    WIDTHS = (6, 10, 16, 32)

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 200_000):
        self.ranks, self.limit = ranks, memo
        self.pairs = PairRanks(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word: merges by rank, all words a round at a time."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > self.WIDTHS[-1]:
                out[i] = self.fold_long(w)
            else:
                by_width.setdefault(next(x for x in self.WIDTHS if x >= len(w)), []).append(i)
        for width, at in by_width.items():
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in at), np.uint8).reshape(-1, width)
            size = np.array([len(words[i]) for i in at])
            cols = np.arange(width)
            ids = np.where(cols < size[:, None], self.bytes[flat], -1)
            rank = np.full(ids.shape, NONE)
            rank[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(at), -1)
            done, live = ids.copy(), np.arange(len(at))
            while len(live):
                best = rank.argmin(1)
                new = rank[np.arange(len(live)), best]
                go = new < NONE
                if not go.all():
                    done[live[~go]] = ids[~go]
                    live, ids, rank, best, new = live[go], ids[go], rank[go], best[go], new[go]
                    if not len(live):
                        break
                row = np.arange(len(live))
                after = np.minimum(cols + (cols > best[:, None]), width - 1)
                ids, rank = np.take_along_axis(ids, after, 1), np.take_along_axis(rank, after, 1)
                ids[:, -1], rank[:, -1] = -1, NONE
                ids[row, best] = new
                rank[row, best] = self.pairs(new, ids[row, np.minimum(best + 1, width - 1)])
                left = np.flatnonzero(best)
                rank[left, best[left] - 1] = self.pairs(ids[left, best[left] - 1], new[left])
            for i, ids_of in zip(at, done):
                out[i] = ids_of[ids_of >= 0].astype("<u4").tobytes()
        return out

    def fold_long(self, word: bytes) -> bytes:
        """The same for one long word: a heap of pairs over a linked list."""
        from heapq import heapify, heappop, heappush

        n = len(word)
        token: list = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, token[i] + token[i + 1]) for i in range(n - 1) if (r := self.ranks.get(token[i] + token[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, made = heappop(heap)
            j = after[i]
            if token[i] is None or j >= n or token[i] + token[j] != made:
                continue
            token[i], token[j], after[i] = made, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(made + token[after[i]])) is not None:
                    heappush(heap, (r, i, made + token[after[i]]))
            if (h := before[i]) >= 0 and (r := self.ranks.get(token[h] + made)) is not None:
                heappush(heap, (r, h, token[h] + made))
        return np.array([self.ranks[t] for t in token if t is not None], "<u4").tobytes()

    @staticmethod
    def stretches(text: str) -> list[str]:
        """The text cut where a match of a byte-level BPE pattern surely starts: at a lone space before a word, around a lone line feed."""
        if "\0" in text or not _LONE.fullmatch(text):
            return regex.split(r"(?<=\S)(?= \S)", text) if text else []
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def words(self, stretch: str) -> list[str]:
        body = stretch[1:] if stretch[0] == " " else stretch
        if body.isalpha():
            return [stretch]
        if body[-1:] in ".,!?" and body[:-1].isalpha():
            return [stretch[:-1], stretch[-1]]
        return self.find(stretch)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.stretches(t) for t in texts]
        new = list({s for c in cut for s in c}.difference(self.memo))
        if len(self.memo) + len(new) > self.limit:
            self.memo = {}
            new = list({s for c in cut for s in c})
        found = [self.words(s) for s in new]
        distinct = list({w for f in found for w in f})
        folded = dict(zip(distinct, self.fold([w.encode() for w in distinct])))
        self.memo.update((s, b"".join([folded[w] for w in f])) for s, f in zip(new, found))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]


_encoders: dict[tuple, BpeEncoder] = {}


def encode(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `key` and `ids`, an array of int."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (len(shared.value), hash(shared.value), pattern)
        if at not in _encoders:  # a worker that is used again keeps its memo
            _encoders.clear()
            _encoders[at] = BpeEncoder(read_ranks(shared.value), pattern)
        encoder = _encoders[at]
        for batch in slices(batches, "_text", 1_000_000):
            ids = encoder.encode(texts(batch, "_text"))
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), np.int32))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids; ids outside the table have none."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")  # folded to one literal when the query is planned
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""))


def fold_column(word: Column, rank_map: Column) -> Column:
    """The tokens of a binary word as array<binary>: merges folded by aggregate() over a map of token to rank."""
    none = F.lit(2**31 - 1)

    def rank(parts, i):
        return F.coalesce(F.try_element_at(rank_map, F.concat(F.get(parts, i), F.get(parts, i + 1))), none)

    def merge(parts, _):
        found = F.array_min(F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(rank(parts, i).alias("r"), i.alias("i"))))
        i = found.getField("i")
        merged = F.concat(F.slice(parts, F.lit(1), i), F.array(F.concat(F.get(parts, i), F.get(parts, i + 1))), F.slice(parts, i + 3, F.size(parts)))
        return F.when(F.size(parts) < 2, parts).when(found.getField("r") == none, parts).otherwise(merged)

    n = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(F.aggregate(F.sequence(F.lit(1), n), single, merge))
