"""Packing token sequences by a harmonic rule.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than C/(k+1) and at most C/k, and a bin
of class k is closed once it has k pieces. A document's ids are cut at powers of two down to `least` - pieces of exactly
C/1, C/2, C/4, ... tokens, whose bins are full to the last token - and the short tail, under `least`, stays whole in its
class. When a worker's rows end, the tails of unfinished bins are cut at the powers of two below `least`, and the exact
pieces left over are joined into sequences whose length is a power of two, which need no padding. So padding occurs only
in finished bins of tails, under `least` tokens each. Workers fill their bins independently: nothing is shuffled, and a
worker holds less than one bin of each class.

A null text is the empty text: its ids are the end id alone. Repeated rows are packed each by itself; an empty table
gives an empty result. Sequence ids are (partition << 33) + a counter, the same again when a lost task is redone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class HarmonicPacker:
    """Pieces (doc_id, start, length, crc, doc_tokens) in; the same with (sequence, offset) out, bin by bin."""

    def __init__(self, capacity: int = 1024, least: int = 32):
        if capacity & (capacity - 1) or least & (least - 1):
            raise ValueError("capacity and least must be powers of two")
        self.capacity, self.least = capacity, least
        self.open: dict[int, list] = {}
        self.next = 0

    def cuts(self, start: int, length: int, least: int) -> list[tuple[int, int]]:
        """Exact pieces of powers of two down to `least`, then what is left."""
        out, size = [], self.capacity
        while length >= size:
            out.append((start, size))
            start, length = start + size, length - size
        while length and size >= least:
            if length >= size:
                out.append((start, size))
                start, length = start + size, length - size
            size //= 2
        return out + [(start, length)] * bool(length)

    def close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield (*p, self.next, at)
            at += p[2]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        k = self.capacity // piece[2]
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) == k:
            del self.open[k]
            yield from self.close(waiting)

    def finish(self, recut) -> Iterator[tuple]:
        """recut(piece, [(start, length)]) gives the parts of a tail."""
        tails = [p for w in self.open.values() for p in w if p[2] < self.least]
        self.open = {k: w for k, w in self.open.items() if w[0][2] >= self.least}
        for p in tails:
            for q in recut(p, self.cuts(p[1], p[2], 1)):
                yield from self.add(q)
        for _, pieces in sorted(self.open.items()):
            n, at = len(pieces), 0
            while at < n:  # exact pieces: as many as the largest power of two that is left
                take = 1 << ((n - at).bit_length() - 1)
                yield from self.close(pieces[at : at + take])
                at += take
        self.open = {}


def byte_bpe_encoder(ranks: bytes, pattern: str, end: str = "<|endoftext|>"):
    """text -> ids. `ranks`: lines of base64 token and rank; `end` takes the id after them, wherever a text has it."""
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={end: len(table)})
    return lambda text: encoding.encode(text, allowed_special="all")


def pack(docs: DataFrame, ranks: bytes, pattern: str, capacity: int = 1024, least: int = 32, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece (SCHEMA): its document's ids [start, start + length) lie at `offset` in sequence `sequence_id`."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_bpe_encoder(shared.value, pattern), HarmonicPacker(capacity, least)
        base = TaskContext.get().partitionId() << 33
        last = np.array([end_id], "<u4").tobytes()
        kept: dict[tuple, bytes] = {}  # the ids of tails that wait

        def out(rows: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*rows)) or [[]] * 7
            c[5] = [base + s for s in c[5]]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=[x.split()[0].strip("`") for x in SCHEMA.split(", ")])

        for batch in slices(batches, "text"):
            rows = []
            for doc, words in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                ids = np.array(encode(words), "<u4").tobytes() + last
                n = len(ids) // 4
                for start, length in packer.cuts(0, n, least):
                    part = ids[4 * start : 4 * (start + length)]
                    piece = (doc, start, length, zlib.crc32(part), n)
                    if length < least:
                        kept.setdefault(piece, part)
                    for p in packer.add(piece):
                        rows.append(p)
            if len(kept) > 4096:
                waiting = {p for w in packer.open.values() for p in w}
                kept = {p: x for p, x in kept.items() if p in waiting}
            if rows:
                yield out(rows)

        def recut(piece, cuts):
            whole = kept[piece]
            for start, length in cuts:
                at = start - piece[1]
                yield (piece[0], start, length, zlib.crc32(whole[4 * at : 4 * (at + length)]), piece[4])

        if rows := list(packer.finish(recut)):
            yield out(rows)

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, SCHEMA)
