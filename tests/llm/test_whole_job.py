"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import public_tokenizers as P
import tiktoken

from quern.llm import bpe, graphs, htmltext, linededup, minhash, toxicity

RANKS = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def word(rng):
    return "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))


def test_bpe_runs_of_white_space_balanced_by_other_kinds(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = ["a\n\nb\tc", "a b\tc\td", "a  b\rc", "a \tb", " a", "a\n", "a b  c", "a\x1cb  c"]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark, enumerate(texts)), RANKS, P.PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == [own.encode_ordinary(t) for t in texts]


def test_markers_do_not_depend_on_copies(spark):
    rng = random.Random(1)
    names = ["grobnak", "zilpert", "hadrosh", "mukelten"]
    rows = [(" ".join([*(word(rng) for _ in range(20)), *[names[i // 4 % 4]] * (i % 4 == 0)]), int(i % 4 == 0)) for i in range(400)]
    learned = lambda more: toxicity.learn(*[spark.createDataFrame(rows + more, "text string, label int")] * 2).markers
    plain = learned([])
    assert set(names) <= set(plain)
    assert learned([rows[0]] * 12_000) == plain and learned([rows[1]] * 12_000) == plain


def test_paragraphs_with_a_common_beginning_are_not_template(spark):
    intro = "A standing introduction of the series. " * 8
    page = "<html><body><div>Welcome</div><div><p>{intro}Own text {n}</p></div></body></html>"
    pages = spark.createDataFrame([(i, "http://a.example.com/", page.format(intro=intro, n=i)) for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in htmltext.extract(pages).collect()} == {f"{intro}Own text {i}" for i in range(6)}


def test_line_dedup_tells_rows_of_one_key_apart(spark):
    rng = random.Random(2)
    line = lambda: " ".join(word(rng) + str(rng.randint(0, 999)) for _ in range(10))
    common, near = line(), line()
    rows = []
    for k in (None, None, None, 7, 7, 7, 8):
        rows.append((k, "\n".join([line(), rng.choice([common, near + " tail", near]), line()])))
    rows += [(k, "\n".join(line() for _ in range(3))) for k in (None, None, 7)] + [rows[0], rows[3]]
    got = linededup.dedup_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = {(r["doc_id"], x) for r in got for x in r["text"].split("\n")}
    own = {x for _, t in rows for x in t.split("\n")} - {common, near, near + " tail"}
    assert own <= {x for _, x in kept}  # no line without a match goes
    left = [x for r in {(r["doc_id"], r["text"]) for r in got} for x in r[1].split("\n") if x not in own]
    assert sorted(x[: len(near)] for x in left) == sorted({common[: len(near)], near})


def test_line_dedup_takes_lines_of_any_length(spark, tmp_path):
    from quern.llm.queries import QUERIES

    rng = random.Random(4)
    pool = [" ".join(word(rng) for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["日本語の長い文です", "a", "a a", "b a", "a b c d", "a b c d e", "A b c", "a b c d f"]
    texts = [None, "", "\n\n", "a\n\na\n", *("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(80))]
    seen, want = [], {}
    for k, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            s = frozenset(x.lower().split())
            if not any(s and len(s & y) >= 0.8 * len(s | y) - 1e-9 for y in seen):
                kept.append(x)
            seen.append(s)
        want[k] = None if t is None else "\n".join(kept)
    docs(spark, enumerate(texts)).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and sum(r["n_removed"] for r in got) > 200


def test_near_copies_and_verdicts_by_row_not_by_id(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(6)
    text = lambda: " ".join(word(rng) + str(rng.randint(0, 999)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(None, a), (None, b), (5, a + " more"), (6, b + " more"), (6, c), (7, text()), (7, c + " more"), (None, None), (None, a + " again")]
    got = minhash.near_duplicates(docs(spark, rows), words=5).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got if r["n_shingles"]) == sorted(
        [("5", "None", False), ("6", "None", False), ("6", "6", True), ("7", "7", True), ("7", "6", False)] + [("None", "None", k) for k in (True, True, False)]
    )
    left = {(r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    first = left & {(None, a), (None, a + " again")}
    assert len(first) == 1 and left - first == {(None, b), (6, c), rows[5], (None, None)}

    rows = [(i, text() + " grobnak zilpert" * (i % 4 == 0)) for i in range(200)]
    rows += [(None, "a clean text"), (None, "some grobnak and zilpert too"), (300, "another clean text"), (300, "with zilpert and grobnak")]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = pipeline.toxicity(spark, docs(spark, rows), str(tmp_path))
    assert left.columns == docs(spark, rows).columns
    assert {(r["doc_id"], r["text"]) for r in left.collect()} == {*(r for r in rows[:200] if r[0] % 4), rows[200], rows[202]}


def test_long_tokens_are_restored(spark):
    rng = random.Random(8)
    names = ["grobnak", "zilpert", "hadrosh", "mukelten"]
    rows = spark.createDataFrame([(" ".join([*(word(rng) for _ in range(20)), *[names[i // 4 % 4]] * (i % 4 == 0)]), int(i % 4 == 0)) for i in range(400)], "text string, label int")
    restorer = toxicity.Restorer(toxicity.learn(rows, rows))
    assert restorer.words("gr" + "o" * 80 + "bnak") == ["grobnak"]
    assert restorer.features("/".join(["plain", "words", "grobnak", "zilpert"] * 10)) == (2, 20)
    long = "gr0bn4k" * 60  # decoded in stretches as in one
    once = restorer.decode(long)
    assert once == "grobnak" * 60


def test_unrelated_documents_branch_until_they_part(spark, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(60)) for _ in range(2500)]
    rows = [*enumerate(texts), *((5000 + i, texts[i] + " tail") for i in range(0, 2500, 50))]
    whole, sent = minhash._rest, []
    monkeypatch.setattr(minhash, "_rest", lambda mixed, *a, **k: sent.append(mixed.count()) or whole(mixed, *a, **k))
    monkeypatch.setattr(minhash, "FEW_ROWS", 1, raising=False)
    for deepest in (2, 10):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), words=2, deepest=deepest).collect()}
        assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
        sent.append(0)
    assert sent[0] > 4 * max(sent[1:])  # rows of nodes that stay large


def test_lookup_of_hot_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(graphs, "HOT", 100, raising=False)
    rows = spark.range(2000).selectExpr("id", "if(id < 500, 0, id) as k")
    joined = graphs.lookup(rows, rows.select("k").distinct().selectExpr("k", "k + 1 as v"), "k", "id", False)
    assert joined.count() == 2000 and joined.where("v <> k + 1").isEmpty()


def test_lines_of_a_large_group_make_few_pairs(spark, monkeypatch):
    rng = random.Random(13)
    bases = [[word(rng) + str(i) for i in range(25)] for _ in range(3)]
    texts = []
    for k in range(900):
        w = list(bases[k % 3])
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(25)] = "new%d" % rng.randint(0, 10**6)
        texts.append(" ".join(w))
    d = docs(spark, enumerate(texts)).selectExpr("doc_id as key", "0L as of_text", "text")
    whole, pairs = linededup._verified, []
    monkeypatch.setattr(linededup, "_verified", lambda p, *a: pairs.append(p.count()) or whole(p, *a))
    found = {r["key"] for r in linededup.find_repeats(d).collect()}
    few = sum(pairs)
    monkeypatch.setattr(linededup, "ROUNDS", (64,))  # all earlier lines at once
    pairs.clear()
    assert {r["key"] for r in linededup.find_repeats(d).collect()} == found and few < 0.8 * sum(pairs)


def pages_of(spark, pages, host="a"):
    return spark.createDataFrame([(i, f"http://{host}.example.com/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")


def test_template_boxes_inside_articles_go_and_authors_may_repeat_themselves(spark):
    page = "<html><body><article><h1>Title {n}</h1><p>Own text {n}</p><p>The same sentence</p><div class='app'><p>Get our app</p><span>now</span> free</div>{more}</article></body></html>"
    more = ["", "<div class='app2'>Own {n}, see</div>", "<div>Get our app</div>"]
    got = htmltext.extract(pages_of(spark, [page.format(n=i, more=more[i % 3].format(n=i)) for i in range(9)])).collect()
    want = [["", f"\nOwn {i}, see", "\nGet our app"][i % 3] for i in range(9)]
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Title {i}\nOwn text {i}\nThe same sentence{want[i]}" for i in range(9)}
    # copies of a page, and pages that differ outside their texts only, are no evidence
    copies = [f"<html><body><nav>{i}</nav><article><h1>T</h1><div class='app'>Body</div></article></body></html>" for i in range(5)]
    assert {r["text"] for r in htmltext.extract(pages_of(spark, copies)).collect()} == {"T\nBody"}
    # an article of which nothing would be left
    alike = [f"<html><body><article><div class='a'>Body</div></article><article class='comment'>{i}</article><article>{'x' * (i == 9)}</article></body></html>" for i in range(6)]
    assert {r["text"] for r in htmltext.extract(pages_of(spark, alike)).collect()} == {"Body"}


def test_classes_by_their_order_and_nesting_decide_outside_articles(spark):
    # equal to `Welcome` in how many pages have it, `Alone` is of a class without tags: it is no template
    page = "<html><body><div class='w'>Welcome</div>{alone}<div>Story {n}</div><div>Word <b>and</b> place</div></body></html>"
    got = htmltext.extract(pages_of(spark, [page.format(n=i, alone="<div>Alone</div>" if i < 4 else "<div>Else %d</div>" % i) for i in range(6)])).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"{'Alone' if i < 4 else 'Else %d' % i}\nStory {i}" for i in range(6)}
    t = htmltext.Template([(5, -1, 9, (1, 2, 3, 4)), (6, 5, 9, (7, 8, 9))])
    kinds = {1: 0, 2: 1, 3: 1, 4: 0, 7: 0, 8: 1, 9: 0}
    held = lambda *tokens: sorted(tokens[p] for p in t.held([(x, kinds.get(x, 1)) for x in tokens]))
    assert held(1, 2, 3, 4) == [1, 2, 3, 4]
    assert held(1, 3, 50, 2, 4) in ([1, 2, 4], [1, 3, 4])  # out of order: the longest part in order
    assert held(1, 2, 7, 8, 9, 3, 4) == [1, 2, 3, 4, 7, 8, 9]
    assert held(1, 2, 7, 8, 3, 9, 4) == [1, 2, 3, 4]  # straddles the class around it: a tag on one side only
    assert held(7, 8, 9, 7, 8, 9) == [7, 7, 8, 8, 9, 9] and held(7, 8, 9, 7, 8) == []


def test_classes_by_plain_deduction(spark):
    rng = random.Random(4)
    html = []
    for i in range(20):
        parts = [f"<p>Own {i}</p>"] + [f"<div class='c{j}'>Text {j}<p>more</p></div>" * rng.randint(1, 2) for j in range(6) if rng.random() < 0.8]
        rng.shuffle(parts)
        html.append(f"<html><body>{''.join(parts)}<article><h2>Part</h2><p>{i}</p></article></body></html>")
    html += html[:3]  # copies count once
    plain = {}
    for i, h in enumerate(html[:20]):
        for token, _ in htmltext.Page(h).tokens:
            plain.setdefault(token, [0] * 20)[i] += 1
    classes = {}
    for token, vector in plain.items():
        if sum(n > 0 for n in vector) >= 10:
            classes.setdefault(tuple(vector), set()).add(token)
    got = htmltext.deduce(pages_of(spark, html)).collect()
    assert sorted(sorted(t["token"] for t in c["tokens"]) for c in got) == sorted(sorted(c) for c in classes.values())
    assert len(got) > 5 and all(t["label"] for c in got for t in c["tokens"])


def test_words_counted_in_a_sample_find_the_same_lines(spark):
    rng = random.Random(5)
    vocabulary = [word(rng) + str(i) for i in range(300)]
    some = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 12, 30, 90]))] for _ in range(60)]
    line = lambda: " ".join(rng.choice(vocabulary) if rng.random() < 0.07 else w for w in rng.choice(some))
    d = docs(spark, [(i, "\n".join(line() for _ in range(3))) for i in range(120)])
    d = d.select(*linededup.identity(d["doc_id"], d["text"]), "text")
    n = lambda classes: sum(k > 1 for k in classes)
    whole, part = linededup.bucket_classes(d, sample=1), linededup.bucket_classes(d, sample=8, enough=1)
    assert 0 < n(part) < n(whole) and linededup.bucket_classes(d) == whole  # too few words in the sample: all are counted
    sets = {}
    for k, h, text in d.collect():
        for i, x in enumerate(text.split("\n")):
            sets[k, h, i] = set(x.split(" "))
    plain = {x for x in sets if any(y < x and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]) for y in sets)}
    # none, a few and all of the words known
    for sample, enough in ((10**6, 0), (8, 1), (1, 0)):
        found = [tuple(r) for r in linededup.find_repeats(d, sample=sample, enough=enough).collect()]
        assert set(found) == plain and len(found) == len(plain)


def test_line_tokens_are_plain_longs_made_once(spark):
    odd = ["", " ", "\t \x0b", "\x01", " \x01 ", "\xa0", "!", "a", " a", "\ta", "b  a b ", "日本 é a", "\r\x0c", *(" ".join(f"w{i % 70}" for i in range(n)) for n in (5, 64, 65, 90))]
    d = spark.createDataFrame([(i, 0, 0, x) for i, x in enumerate(odd)], "key long, of_text long, line int, value string")
    for least in (1, 2):
        got = {r["key"] for r in d.where(linededup._worded(d["value"], least)).collect()}
        assert got == {i for i, x in enumerate(odd) if len(set(x.translate({ord(c): " " for c in "\t\x0b\x0c\r"}).split(" ")) - {""}) >= least}
    classes = bytearray(random.Random(1).choice(range(1, 127)) for _ in range(2**10))
    made = d.select("key", linededup.tokens(linededup._plain(d["value"]), classes).alias("t"))
    assert not made.schema["t"].dataType.containsNull  # else Spark sorts objects
    plain = d.selectExpr("key", "explode(split(translate(lower(value), '\t\x0b\x0c\r', '    '), ' ')) as w").where("w <> ''").selectExpr("key", "xxhash64(w) as h").distinct()
    want = {i: [] for i in range(len(odd))}
    for r in plain.collect():
        want[r["key"]].append(classes[r["h"] & 1023] << 56 | (r["h"] & (2**64 - 1)) >> 8)
    assert {r["key"]: r["t"] for r in made.collect()} == {i: sorted(x) for i, x in want.items()}
    # once, and in a projection: a generator's input is interpreted
    plan = linededup._prefixes(linededup._signed(d, classes), 0.8)._jdf.queryExecution().executedPlan().toString()
    lines = [x.split("[")[0] for x in plan.split("\n") if "sort_array" in x]
    assert len(lines) == 1 and "Project" in lines[0]
