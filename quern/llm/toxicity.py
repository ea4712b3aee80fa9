"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A token with signs of disguise - leetspeak, separators between letters, letters drawn out, letters spaced apart - becomes
a lattice: at each place the letters that may have been meant, each with a channel cost. Viterbi decoding under a
character trigram model takes the cheapest path; all other tokens are taken as they stand. The trigram counts come from
all texts, and words that mark toxic texts get a share of them, so that the model holds both. The score is a logistic
function of how many markers, and how many different ones, the restored text has. A marker is a word, or the beginning
of words (written "begin*"), as endings vary in some languages.

`learn` fits everything from (text, label) rows: marker words by the number of distinct toxic and other texts that hold
them (at most `markers` words: the model is bounded, the counts cover every row), and the logistic weights by Newton steps
on a table of feature counts, whose size does not depend on the rows.

Null and empty texts have no markers and get the score of a text without any. Rows without a label (null) teach nothing.
Repeated texts count once for the markers. With no labelled rows, or one class only, there are no markers and every score
is the share of toxic rows (0.5 without rows). Very long texts are processed whole. Only the named columns are read.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

# What a sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "aeiou"}
SEPARATORS = "-._~'`^/\\"
EDGE = ".,;:?!\"'()[]{}<>«»“”…-"
VOWELLESS = 1.5  # cost of a sign that could be any vowel
COST = {"leet": 0.7, "separator": 0.2, "sign": 4.0, "single": 0.4, "double": 0.6, "undouble": 2.0, "gap": 1.0}

A = 28  # edge, a..z, other
_CLASS = np.full(256, 27, np.uint16)
_CLASS[list(b" \t\n\r\x0b\x0c")] = 0
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)


def classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(f" {text} ".lower().encode("latin-1", "replace"), np.uint8)]


def trigrams(text: str) -> np.ndarray:
    c = classes(text).astype(np.int32)
    return np.bincount(c[:-2] * (A * A) + c[1:-1] * A + c[2:], minlength=A**3)


@dataclass
class Model:
    markers: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    cost: np.ndarray | None = None  # of the third class after the first two

    def probability(self, types: int, hits: int) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * min(types, TYPES) + c * math.log1p(min(hits, HITS))))))


TYPES, HITS = 6, 12
BEGINNINGS = (4, 5)


def costs(counts: np.ndarray, words: dict[str, float], share: float = 0.1) -> np.ndarray:
    """-ln P(c | a, b), smoothed by the bigram; the given words have `share` of all trigrams."""
    counts = counts.astype(float).reshape(A, A, A).copy()
    counts[:, :, 27] *= 0.1  # other scripts' letters are no guide for restored ones
    own = np.zeros((A, A, A))
    for w in words:
        own += trigrams(w.rstrip("*")).reshape(A, A, A)
    if own.sum():
        counts += own * (max(counts.sum(), 1.0) * share / own.sum())
    two = counts.sum(0) + 0.5
    two /= two.sum(1, keepdims=True)
    return -np.log((counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20))


class Restorer:
    """Tokens to words, with a memo of at most `memo` tokens."""

    def __init__(self, model: Model, memo: int = 200_000):
        self.model, self.limit = model, memo
        self.cost = model.cost.tolist() if model.cost is not None else None
        self.memo: dict[str, str] = {}
        self.hits: dict[str, tuple[str, ...]] = {}
        begins = {n: {m[:-1] for m in model.markers if len(m) == n + 1 and m[-1] == "*"} for n in BEGINNINGS}
        self.begins = [(n, b) for n, b in begins.items() if b]

    def options(self, run: str, n: int) -> list[tuple[str, float]]:
        """What n times the character `run` may stand for."""
        if run == " ":
            return [("", 0.0), (" ", COST["gap"])]
        if run.isalpha():
            if n == 1:
                return [(run, 0.0)]
            if n == 2:
                return [(run * 2, 0.0), (run, COST["undouble"])]
            return [(run, COST["single"]), (run * 2, COST["double"])]
        out = [("", COST["separator"] if run in SEPARATORS else COST["sign"])]
        for c in LEET.get(run, ""):
            cost = VOWELLESS if run in "*#" else COST["leet"]
            out += [(c, cost)] if n == 1 else [(c * 2, cost), (c, cost + COST["undouble"])] if n == 2 else [(c, cost + COST["single"]), (c * 2, cost + COST["double"])]
        return out

    def decode(self, token: str) -> str:
        """Viterbi: the cheapest way through the lattice of a token; a state is the last two classes."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        done: list[str] = []
        for at, m in enumerate(re.finditer(r"(.)\1*", token, re.S), 1):
            new: dict = {}
            for letters, extra in self.options(m[1], len(m[0])):
                steps = [0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27 for c in letters]
                for (a, b), (cost, text) in states.items():
                    cost += extra
                    for c in steps:
                        cost += self.cost[a][b][c]
                        a, b = b, c
                    if (a, b) not in new or cost < new[a, b][0]:
                        new[a, b] = (cost, text + letters)
            states = new
            if at % 64 == 0:  # what all ways have in common is settled, so that a long token takes little memory
                done.append(common := os.path.commonprefix([text for _, text in states.values()]))
                states = {k: (cost, text[len(common) :]) for k, (cost, text) in states.items()}
        return "".join(done) + min((cost + self.cost[a][b][0], text) for (a, b), (cost, text) in states.items())[1]

    def word(self, token: str) -> str:
        """A token (lower case, no white space) as the word or words it stands for."""
        if token.isalpha() and not _DRAWN.search(token):
            return token
        body = token.strip(EDGE)
        if not body or body.isalpha() and not _DRAWN.search(body):
            return body
        if self.cost is None or not _LETTER.search(body):
            return body
        parts = [p for p in _CLAUSE.split(body) if p]  # a sign between two long words is no disguise
        if len(parts) > 1:
            return " ".join(self.word(p) for p in parts)
        inner = token.lstrip("\"'([{<«“-").rstrip(".,;:?\"')]}>»”-")
        return min((self.decode(x) for x in {body, inner} if x), key=lambda w: (self.marker(w) is None, len(w)))

    def marker(self, word: str) -> str | None:
        """The marker that a word has."""
        if word in self.model.markers:
            return word
        if word[-1:] == "s" and word[:-1] in self.model.markers:
            return word[:-1]
        for n, begins in self.begins:
            if word[:n] in begins and len(word) > n:
                return word[:n] + "*"
        return None

    def words(self, text: str) -> list[str]:
        tokens = text.lower().split()
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        for t in set(tokens).difference(memo):
            memo[t] = self.word(t)
        out = [memo[t] for t in tokens]
        if self.cost is not None and _SPACED.search(text):
            out += self.spaced(tokens)
        return out

    def spaced(self, tokens: list[str]) -> list[str]:
        """The words that runs of three or more single characters stand for."""
        if self.cost is None:
            return []
        out, run = [], []
        for t in [*tokens, ""]:
            body = t.strip(EDGE) or t
            if len(body) == 1 and (body.isalpha() or body in LEET):
                run.append(body)
                continue
            if len(run) >= 3 and len(set(run)) > 2:
                for at in range(0, len(run), 40):
                    letters = self.decode(" ".join(run[at : at + 60])).split()
                    out += letters
                    joined = "".join(letters)
                    out += [w for w in self.model.markers if len(w) > 3 and w[-1] != "*" and w in joined and w not in letters]
            run = []
        return out

    def features(self, text: str) -> tuple[int, int]:
        """How many different markers the restored text has, and how many in all."""
        tokens = text.lower().split()
        if len(self.hits) > self.limit:
            self.hits = {}
        for t in set(tokens).difference(self.hits):
            w = self.word(t)
            m = self.marker(w)
            self.hits[t] = tuple(m for x in w.split() if (m := self.marker(x))) if " " in w else (m,) if m else ()
        found = [m for ms in filter(None, map(self.hits.__getitem__, tokens)) for m in ms]
        if _SPACED.search(text):
            found += [m for w in self.spaced(tokens) if (m := self.marker(w))]
        return len(set(found)), len(found)


_DRAWN = re.compile(r"(.)\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_CLAUSE = re.compile(r"(?<=[^\W\d_]{3})[-/.,;:_](?=[^\W\d_]{3})")
_SPACED = re.compile(r"(?:(?:^|\s)\S\W?(?=\s|$)){3}")


def _map(df: DataFrame, run, schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Character trigrams of all texts: 28**3 counts, summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, np.int64)
        for batch in slices(batches, "_text"):
            for t in texts(batch, "_text"):
                total += trigrams(t) if len(t) > 20_000 else 0
            short = [t for t in texts(batch, "_text") if len(t) <= 20_000]
            total += trigrams("  ".join(short)) if short else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    rows = _map(docs.select(F.col(text).cast("string").alias("_text")), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 28**3 rows at most
    out = np.zeros(A**3)
    for gram, n in rows:
        out[gram] = n
    return out


def _distinct(rows: DataFrame, text: Column) -> DataFrame:
    """(_text, _label): each distinct text once, toxic if any of its rows is."""
    return rows.groupBy(text.alias("_text")).agg(F.max("_label").alias("_label"))


def count_texts(rows: DataFrame) -> dict[int, int]:
    """The number of distinct texts of each label, as count_words() takes them; texts are told apart by their MD5, so that they are not shuffled again."""
    return {r[0]: r[1] for r in _distinct(rows, F.md5(F.col("_text").cast("binary"))).groupBy("_label").count().collect()}


def count_words(rows: DataFrame) -> DataFrame:
    """(word, toxic, other): in how many distinct texts of either label a word or beginning occurs. rows: _text, _label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Restorer(Model())
        begins: dict[str, tuple[str, ...]] = {}
        for batch in slices(batches, "_text"):
            sides = Counter(), Counter()
            for t, label in zip(texts(batch, "_text"), batch.column(1).to_pylist()):
                words = set(plain.words(t))
                if len(begins) > plain.limit:
                    begins.clear()
                begins.update((w, tuple(w[:n] + "*" for n in BEGINNINGS if len(w) > n)) for w in words.difference(begins))
                sides[label].update(words)
                sides[label].update(set(chain.from_iterable(map(begins.__getitem__, words))))
            both = list(sides[1] | sides[0])
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([sides[1][w] for w in both], pa.int64()), pa.array([sides[0][w] for w in both], pa.int64())], names=["word", "toxic", "other"])

    return _map(_distinct(rows, F.col("_text")), run, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose_markers(counts: DataFrame, toxic: int, other: int, markers: int = 500, odds: float = 20.0) -> dict[str, float]:
    """Words whose share of toxic texts is `odds` times that of other texts, in enough toxic texts to tell."""
    if not toxic or not other:
        return {}
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    least = 2 + 0.004 * toxic
    rows = counts.where((F.col("toxic") >= least) & (F.length("word") > 2) & (ratio >= odds)).select("word", F.ln(ratio).alias("w"), "toxic").orderBy(F.desc("toxic"), "word").limit(markers).collect()
    return {r["word"]: r["w"] for r in rows}


def fit(table: dict[tuple[int, int, int], int]) -> tuple[float, float, float]:
    """Logistic weights for (types, hits) from counts of (types, hits, label), with a weak ridge."""
    if not table:
        return (0.0, 0.0, 0.0)
    x = np.array([[1.0, min(t, TYPES), math.log1p(min(h, HITS))] for t, h, _ in table])
    y = np.array([float(k[2]) for k in table])
    n = np.array(list(table.values()), float)
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-3, 0.02, 0.02])
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n * (y - p)) - ridge * w)
        w = w + step * min(1.0, 3.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _features(docs: DataFrame, keep: list[str], model: Model, restored: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `markers` words and 28**3 costs
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in slices(batches, "_text"):
            all_texts = texts(batch, "_text")
            found = [restorer.features(t) for t in all_texts]
            more = [pa.array([" ".join(restorer.words(t)) for t in all_texts], pa.string())] if restored else []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32()), pa.array([shared.value.probability(a, b) for a, b in found], pa.float64()), *more], names=[*keep, "types", "hits", "score", *["restored"] * restored])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "types int, hits int, score double" + ", restored string" * restored
    return _map(docs.select(*(F.col(f"`{c}`") for c in keep), "_text"), run, schema)


def learn(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "label", markers: int = 500) -> Model:
    """docs: all texts, for the character model; labelled: rows of text and label (0 or 1; others are passed over)."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("int").alias("_label"))
    counts = count_trigrams(docs, text)
    sizes = count_texts(rows)
    words = choose_markers(count_words(rows), sizes.get(1, 0), sizes.get(0, 0), markers)
    model = Model(words, cost=costs(counts, words))
    table = _features(rows, ["_label"], model).groupBy(F.least("types", F.lit(TYPES)).alias("types"), F.least("hits", F.lit(HITS)).alias("hits"), "_label").count().collect()
    model.weights = fit({(r[0], r[1], r[2]): r[3] for r in table})
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", restored: bool = False, others: list[str] | None = None) -> DataFrame:
    """Rows of `key`, the columns `others`, types, hits, score, and the restored text if asked for."""
    keep = [key, *(c for c in others or () if c != key)]
    return _features(docs.select(*(F.col(f"`{c}`").alias(c) for c in keep), F.col(f"`{text}`").cast("string").alias("_text")), keep, model, restored)


def learn_by_key(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", broadcast_rows: int = 2_000_000) -> Model:
    """learn() from the labels of rows that are not held out. The labels are broadcast up to a number of rows; beyond it they are joined by shuffling."""
    train = labels.where(~held_out(F.col(key))).groupBy(key).agg(F.max(label).alias("label")).where("label is not null")
    small = train.count() <= broadcast_rows
    return learn(docs, docs.select(key, text).join(F.broadcast(train) if small else train, key), text)


def held_out(key):
    """The rows whose labels are not learned from: a CRC of the key's digits modulo 3 is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
