"""Text operators against plain versions, and their behaviour on nulls, empty texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, fingerprint, linededup, minhash, packing, sharding, tokencount, toxicity

RANKS = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
ODD = [None, "", " ", "\n\n", "  a  b\n c\t d ", "don't  stop!!! 123abc", "日本語 テスト ñandú", "x" * 3000, "<|endoftext|> end", "a b  c", "a\0b c"]


def docs(spark, texts, more=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_bpe_is_tiktoken_and_round_trips(spark, words):
    texts = ODD + [words(80) for _ in range(20)] + [words(30)] * 2
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs(spark, texts), RANKS, P.PATTERN).withColumn("back", bpe.decode(F.col("ids"), ranks)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(t) and bytes(r["back"]) == t.encode()
    assert bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_bpe_fold_as_column(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260}
    table = F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (bytearray(k), v)])
    rows = spark.createDataFrame([("abcd",), ("bcd",), ("",), ("xab",)], "w string")
    got = [b"|".join(bytes(p) for p in r[0]) for r in rows.select(bpe.fold_column(F.col("w").cast("binary"), table)).collect()]
    encoder = bpe.BpeEncoder(ranks, P.PATTERN)
    want = [b"|".join(next(t for t, k in ranks.items() if k == i) for i in np.frombuffer(encoder.fold([w])[0], "<u4")) if w else b"" for w in (b"abcd", b"bcd", b"", b"xab")]
    assert got == want


def test_token_counts_by_plain_viterbi(spark, words):
    model = open(P.path("piece_bpe_32k.model"), "rb").read()
    scores = tokencount.unigram_scores(model)
    low, longest = min(scores.values()) - 1, max(map(len, scores))

    def plain(word):
        s, best = tokencount.MARK + word, [(0.0, 0)]
        for e in range(1, len(s) + 1):
            k = len(s[e - 1].encode())
            options = [(best[-1][0] + k * low, -best[-1][1] - k)]
            options += [(best[b][0] + scores[s[b:e]], -best[b][1] - 1) for b in range(max(0, e - longest), e) if s[b:e] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    texts = ODD + [words(40) for _ in range(10)]
    for r in tokencount.count_tokens(docs(spark, texts), model).collect():
        w = (texts[r["doc_id"]] or "").split()
        assert (r["n_words"], r["n_tokens"]) == (len(w), sum(map(plain, w)))
    small = tokencount.TrieCounter(scores, nodes=5)  # the trie begins anew again and again
    assert [small[w] for w in ("hello", "help", "hello")] == [plain("hello"), plain("help"), plain("hello")]


def test_packing(spark, words):
    texts = ODD + [words(n) for n in (1, 5, 300, 1500, 700, 20, 31, 33)]
    got = packing.pack(docs(spark, texts).repartition(3), open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN).collect()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, rows in by_doc.items():
        ids = own.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * sum(r["length"] for r in got)


def test_fingerprints(spark, words):
    texts = ["", None, "one two", "one two"] + [words(60) for _ in range(30)] + [words(900)]
    rows = {r["doc_id"]: r for r in fingerprint.compare_edited(docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t) and 0 <= rows[i]["near_edited"] <= 1
    assert rows[2]["sketch"] == rows[3]["sketch"] and rows[2]["near_next"] == 1.0 and rows[0]["near_next"] == 1.0 and rows[1]["near_next"] == 0.0
    assert fingerprint.compare_edited(docs(spark, [])).count() == 0
    a, b = words(2000), words(1000)
    pair = spark.createDataFrame([(a, a + " " + b, b)], "a string, ab string, b string").select(*(fingerprint.sketch(F.col(c)).alias(c) for c in ("a", "ab", "b")))
    r = pair.select(fingerprint.resemblance(F.col("a"), F.col("ab")).alias("j"), fingerprint.containment(F.col("a"), F.col("ab")).alias("c"), fingerprint.distinct_count(F.col("a")).alias("n"), fingerprint.merge(F.col("a"), F.col("b")).alias("m"), "ab").first()
    assert abs(r["j"] - 2 / 3) < 0.15 and r["c"] > 0.85 and abs(r["n"] - 1996) < 500
    merged = fingerprint.merge_groups(pair.select(F.lit(1).alias("g"), "a").union(pair.select(F.lit(1), "b")), "g", "a").first()["a"]
    assert merged == r["m"]


def test_sharding(spark):
    d = docs(spark, ["text %d" % i for i in range(3000)] + [None, "", "é"])
    rows = sharding.shard_documents(d).collect()
    assert {r["shard"] for r in rows} == set(range(24))
    for s in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {24}
    by = {r["doc_id"]: r for r in rows}
    assert by[3000]["size"] == 8 and by[3002]["size"] == 10 and by[3002]["text_crc32"] == zlib.crc32("é".encode())
    heavy = sharding.assign(d, "doc_id", sharding.regular_topology(8, 4, 2, {3: 5.0})).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 3003 for r in heavy}
    assert abs(share[3] - 5 / 12) < 0.05
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def near_copies(words, rng):
    base = [words(60).split() for _ in range(12)]
    out = [None, "", "one", "one", "two words"]
    for b in base:
        for _ in range(rng.randint(1, 60)):
            copy = list(b)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "w%d" % rng.randint(0, 9)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_components_by_brute_force(spark, words, size):
    texts = near_copies(words, random.Random(size))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    d = docs(spark, texts).withColumn("sig", F.lit(1)).withColumn("node", F.lit(2)).withColumn("id", F.lit(3))
    for r in minhash.near_duplicates(d, words=size, leaf=8).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), find(i), find(i) == i)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_line_dedup_by_brute_force(spark, words, monkeypatch):
    rng = random.Random(3)
    pool = [words(rng.randint(1, 25)) for _ in range(40)] + [words(rng.randint(66, 90)) for _ in range(3)]
    texts = [None, "", "\n", "short line\nshort line", "line short\tline", "one\rone", " \t\n\t"]
    for _ in range(70):
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 12])):
                w[rng.randrange(len(w))] = rng.choice(["the", "new%d" % rng.randint(0, 99)])
            lines.append(rng.choice([" ", " ", "  ", "\t"]).join(w + ["the"] * rng.randint(0, 1)))
        texts.append("\n".join(lines))
    keys = [None if i % 9 == 0 else 7 if i % 9 == 1 else i for i in range(len(texts))]
    rows = list(zip(keys, texts))
    rows += [rows[9], rows[10], rows[20]]  # equal rows stay or go together
    d = spark.createDataFrame([(k, t, "en", "s", 0, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, place int")
    d = d.withColumn("key", F.lit("x")).withColumn("line", F.lit("y")).withColumn("at", F.lit("z"))
    ids = d.select("place", *linededup.identity(F.col("doc_id"), F.col("text"))).collect()
    order = sorted({(r["key"], r["of_text"]): r["place"] for r in ids}.items())
    want, seen = {}, []
    for ident, place in order:
        kept = []
        for line in (rows[place][1] or "").split("\n"):
            s = frozenset(line.lower().split())
            if not s or not any(len(s & x) >= 0.8 * len(s | x) - 1e-9 for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        want[ident] = None if rows[place][1] is None else "\n".join(kept)
    want = {r["place"]: want[r["key"], r["of_text"]] for r in ids}
    assert sum(t is not None and t != want[i] for i, (_, t) in enumerate(rows)) > 20
    for hot, most in ((2**20, linededup.BROADCAST_BYTES), (4, 0)):  # with words posted by bands of length, and without broadcasts
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", most)
        out = linededup.dedup_lines(d, hot=hot)
        got = out.collect()
        assert out.columns == [*d.columns, "_removed"] and len(got) == len(rows) and {r["place"]: r["text"] for r in got} == want
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    assert [r["_removed"] for r in linededup.dedup_lines(docs(spark, ["a b c\na b c", "a b c\na b c d e f\na b c d e f"]), least_words=5).collect()] == [0, 1]


def test_toxicity(spark, words):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        w = words(30).split()
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["grobnak", "zilpert", "hadrosh", "mukelten"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    rows = spark.createDataFrame([(i, t, y, None) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, label int, extra string")
    model = toxicity.learn(rows, rows)
    assert {"grobnak", "zilpert", "hadrosh", "mukelten"} <= set(model.markers)
    disguised = ["you gr0bn4k there", "a z i l p e r t here", "h.a.d.r.o.s.h", "muuuukelten", None, "", "plain words here", "1 2 3 4"]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, disguised), model).collect()}
    assert [got[i] >= 0.7 for i in range(8)] == [True] * 4 + [False] * 4
    assert "grobnak" in toxicity.score(docs(spark, disguised), model, restored=True).where("doc_id = 0").first()["restored"]
    nothing = toxicity.learn(rows, rows.where("label = 5"))
    assert toxicity.score(docs(spark, ["x"]), nothing).first()["score"] == 0.5
    held = [r[0] for r in spark.range(30).select(toxicity.held_out(F.col("id"))).collect()]
    assert held == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(30)]
