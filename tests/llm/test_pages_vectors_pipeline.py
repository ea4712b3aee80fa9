"""Pages, vectors, components and the pipeline."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import covertree, graphs, htmltext

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div>
<article><h1>Title {n}</h1><p><b>First   line &amp;amp; more<br><p>Second &eacute; line</p><form><input>name</form><aside>see also</aside>
<div class="comments"><p>a comment</p></div></article><div class="sidebar">side</div><footer>&copy; foot {n}</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(n=i)) for i in range(12)]
    rows += [(100, None, None), (101, "http://one.example.com", ""), (102, "http://two.example.com/", "<p>Only <b>this</b>\n text</p><p>and &lt;this&gt;<p>cut <a hre"), (0, "http://h0.example.com/0", PAGE.format(n=0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("token", F.lit(1))
    got = htmltext.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] < 100:
            assert r["text"] == f"Title {r['page_id']}\nFirst line &amp; more\nSecond é line" and r["template_size"] > 5
    by = {r["page_id"]: r["text"] for r in got}
    assert (by[100], by[101], by[102]) == ("", "", "Only this text\nand <this>\ncut")
    assert htmltext.extract(pages.where("false")).count() == 0


def test_template_text_outside_articles_goes(spark):
    page = "<html><body><div>Welcome to the site</div><div><p>Story number {n}</p></div></body></html>"
    pages = spark.createDataFrame([(i, "http://a.example.com/", page.format(n=i)) for i in range(6)], "page_id long, url string, html string")
    assert {r["text"] for r in htmltext.extract(pages).collect()} == {f"Story number {i}" for i in range(6)}
    classes = htmltext.deduce(pages).collect()
    assert any(len(c["tokens"]) >= 4 for c in classes) and any(c["parent"] != -1 for c in classes) or len(classes) == 1


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = [b + rng.normal(size=16) * 0.12 for b in base for _ in range(rng.integers(1, 25))]
    x += [x[0]] * 30 + [2 * x[1]]
    values = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1e300] * 16]
    u = np.array(values[: len(x)] + [values[-1]])
    u /= np.abs(u).max(1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    n = len(values)
    place = [*range(len(x)), n - 1]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(u @ u.T >= 0.95)):
        if i != j:
            links[place[i]] += 1
            a, b = find(place[i]), find(place[j])
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(values)], "vec_id long, embedding array<double>, label int").withColumn("digest", F.lit(1))
    for block in (4096, 64):
        got = covertree.near_duplicates(df, block=block).collect()
        assert len(got) == n
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"], r["kept"]) == (links[i], find(i), find(i) == i)
    assert covertree.near_duplicates(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    for rows in (1_000_000, 0):  # broadcast and salted
        got = {r["id"]: r["component_id"] for r in graphs.components(df, broadcast_rows=rows).collect()}
        assert got == {i: find(i) for i in root}
    assert graphs.components(df.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(i, text(5), "en", "s", 0) for i in range(60)]
    passage = " ".join(word() for _ in range(55))
    for i in (5, 6, 7):
        rows[i] = (i, rows[i][1] + "\n" + passage, "en", "s", 0)
    for i in range(20, 40):
        rows[i] = (i, rows[i][1] + " grobnak zilpert", "en", "s", 0)
    rows += [(60, None, "en", "s", 0), (61, "", "en", "s", 0), (62, rows[1][1].replace("\n", " "), None, None, None), (63, rows[1][1].replace("\n", " ") + " tail", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(20 <= i < 40)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["toxicity"]) == set(range(64)) - set(range(20, 40))
    with_passage = [i for i in (5, 6, 7) if passage in kept["line_dedup"][i]["text"]]
    assert with_passage == [5] and set(kept["line_dedup"]) == set(kept["toxicity"])
    assert kept["line_dedup"][6]["n_chars"] == len(kept["line_dedup"][6]["text"])
    assert kept["line_dedup"][63]["text"] == ""  # its one line is nearly that of 62, which is nearly the words of 1
    assert set(kept["line_dedup"]) - set(kept["near_dedup"]) == {62}
    assert set(kept["packing"]) == set(kept["near_dedup"])
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()
