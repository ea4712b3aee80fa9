"""Token counts under a unigram model, by dynamic programming shared over a trie.

The distinct words of a worker's texts go into a trie. A node holds the forward score of its prefix - the best sum of
piece log-probabilities over all ways to cut it - and that cut's number of pieces, so a prefix that many words share is
scored once; a word's last node gives its count, which is kept for the next time that the word occurs. Pieces that end at
a place are found backwards in a set of all ends of pieces, so the search stops where no piece can be longer. The trie is
dropped and begun anew when it reaches `nodes` nodes: results stay the same, and memory is bounded. Nothing is shuffled.

A piece's log-probability is Zipf's, from its place in the vocabulary. A character that no piece covers counts as its
UTF-8 bytes. Among equal scores the cut of fewer pieces counts. Words are split at white space and begin with the
vocabulary's word mark. Null and empty texts have no words and no tokens; very long words run past the trie's
depth without being stored; rows stand alone, so ties, repeated rows and empty tables need no care.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

MARK = "▁"


def unigram_scores(model: bytes) -> dict[str, float]:
    """Log-probabilities of the ordinary pieces of a sentencepiece model: Zipf's law over their order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class TrieCounter(dict):
    """word -> number of tokens. A node is [children or None, (score, tokens)]."""

    DEPTH = 48

    def __init__(self, scores: dict[str, float], nodes: int = 800_000):
        super().__init__()
        self.limit = nodes
        ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.scores = ends | scores  # None: no piece, but the end of one
        self.byte = min(scores.values(), default=0.0) - 1.0
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.root, self.size = [{}, (0.0, 0)], 1

    def step(self, s: str, path: list[tuple[float, int]]) -> tuple[float, int]:
        """The forward score of s[:len(path)] from those of its shorter prefixes."""
        end, get = len(path), self.scores.get
        best, count = -math.inf, 0
        start = end - 1
        p = get(s[start:end], 0)  # 0: not even the end of a piece
        while p != 0:
            if p is not None:
                score, tokens = path[start]
                score += p
                if score > best or score == best and tokens + 1 < count:
                    best, count = score, tokens + 1
            start -= 1
            if start < 0:
                break
            p = get(s[start:end], 0)
        n = len(s[end - 1].encode("utf-8", "surrogatepass"))
        score, tokens = path[-1]
        score += n * self.byte
        if score > best or score == best and tokens + n < count:
            return score, tokens + n
        return best, count

    def __missing__(self, word: str) -> int:
        if self.size >= self.limit:
            self.reset()
        s, node, path = MARK + word, self.root, [(0.0, 0)]
        for c in s[: self.DEPTH]:
            children = node[0]
            if children is None:
                children = node[0] = {}
            child = children.get(c)
            if child is None:
                child = children[c] = [None, self.step(s, path)]
                self.size += 1
            node = child
            path.append(child[1])
        while len(path) <= len(s):
            path.append(self.step(s, path))
        if len(word) <= self.DEPTH:
            self[word] = path[-1][1]
        return path[-1][1]


_counters: dict[int, TrieCounter] = {}


def count_tokens(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of `key`, n_words and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = hash(shared.value)
        if at not in _counters:  # a worker that is used again keeps its trie
            _counters.clear()
            _counters[at] = TrieCounter(unigram_scores(shared.value))
        get = _counters[at].__getitem__
        gc.disable()  # a trie is many objects without cycles
        for batch in slices(batches, "_text"):
            words, tokens = [], []
            for t in texts(batch, "_text"):
                w = t.split()
                words.append(len(w))
                tokens.append(sum(map(get, w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long")
