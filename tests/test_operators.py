"""Operators on small inputs with known results."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import gbt, graph, lasso, lda, mlr, nmf, planner, ranges
from quern.operators import tables as K
from quern.operators.training import step_size
from quern.sources import loading, parsers


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_add_integer_closed_form(spark):
    keys, workers, updates = 8, 2, 128
    t = K.KeyedTable(spark.range(keys).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("value")))
    deltas = spark.range(workers * updates).select((F.col("id") % keys).alias("key"), F.lit(1).cast("long").alias("delta"))
    assert {v for _, v in pairs(t.update(deltas).scan())} == {workers * updates // keys}


def test_get_or_init_and_prefix_fold(spark):
    base = spark.createDataFrame([(1, "a")], "key long, value string")
    f = K.UpdateFunction(init=lambda k: F.concat(F.lit("INIT_"), k), combine=F.max, apply=F.concat)
    t = K.KeyedTable(base, f)
    assert pairs(t.multi_get_or_init(spark.createDataFrame([(1,), (2,), (2,)], "key long"))) == [(1, "a"), (2, "INIT_2")]
    deltas = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (3, 1, "z")], "key long, seq long, delta string")
    assert pairs(t.fold(deltas, lambda v, d: F.concat(d, v)).scan()) == [(1, "yxa"), (3, "zINIT_3")]


def test_put_and_previous(spark):
    t = K.KeyedTable(spark.createDataFrame([(1, 10), (2, 20)], "key long, value long"))
    rows = spark.createDataFrame([(2, 1, 5), (2, 2, 6), (3, 1, 7)], "key long, seq long, value long")
    assert pairs(t.multi_put(rows).scan()) == [(1, 10), (2, 6), (3, 7)]
    assert pairs(t.previous(rows.select("key").distinct())) == [(2, 20), (3, None)]
    assert pairs(t.put_if_absent(rows.where("seq = 1").select("key", "value")).scan()) == [(1, 10), (2, 20), (3, 7)]
    assert pairs(t.remove(rows.select("key").distinct()).scan()) == [(1, 10)]


def test_catalog(spark):
    c = K.Catalog()
    c.create("a", K.KeyedTable(spark.createDataFrame([], "key long, value long")))
    with pytest.raises(ValueError):
        c.create("a", c.get("a"))
    c.drop("a")
    with pytest.raises(KeyError):
        c.get("a")


def test_blocks(spark):
    keys = spark.createDataFrame([(0,), (2**53,), (2**63 - 1,)], "key long")
    assert [r[0] for r in keys.select(K.ordered_block(F.col("key"), 1024)).collect()] == [0, 1, 1023]
    with pytest.raises(Exception, match="not negative"):
        spark.createDataFrame([(-1,)], "key long").select(K.ordered_block(F.col("key"), 4)).collect()
    with pytest.raises(ValueError):
        K.checkpoint_sample(keys.withColumn("block_id", F.lit(0)), 0)
    whole = K.checkpoint_sample(keys.withColumn("block_id", F.lit(0)), 1.0)
    assert whole.count() == 3


def test_parsers(spark, tmp_path):
    assert pairs(parsers.content(lines(spark, "# c", "", "  ", "x"))) == [("x",)]
    svm = parsers.libsvm(lines(spark, "3 178:0.25 200:1", "# no"))
    assert [tuple(r) for r in svm.collect()] == [(3, [178, 200], [0.25, 1.0])]
    with pytest.raises(Exception, match="labels"):
        parsers.libsvm(lines(spark, "10 1:1"), classes=10).collect()
    assert pairs(parsers.ratings(lines(spark, "1: 1,3 2,1"))) == [(1, 1, 3.0), (1, 2, 1.0)]
    with pytest.raises(Exception, match="at least"):
        parsers.ratings(lines(spark, "0: 1,3")).collect()
    v, e = parsers.adjacency(lines(spark, "2 227 228 ", "5"))
    assert pairs(v) == [(2,), (5,)] and pairs(e) == [(2, 227), (2, 228)]
    v, e = parsers.weighted_adjacency(lines(spark, "0 1 2 2 3", "7"))
    assert pairs(v) == [(0,)] and pairs(e) == [(0, 1, 2), (0, 2, 3)]
    assert pairs(parsers.key_values(lines(spark, "4 some text"))) == [(4, "some text")]
    assert pairs(parsers.feature_types(lines(spark, "0:0 1:3"))) == [(0, 0), (1, 3)]
    (tmp_path / "a.txt").write_text("1\n2\n")
    assert [r["lines"] for r in loading.count_lines(spark, str(tmp_path)).collect()] == [2]


def test_save_and_restore(spark, tmp_path):
    df = spark.range(20).withColumn("block_id", F.col("id") % 4)
    loading.save(df, str(tmp_path / "t"))
    assert pairs(loading.restore(spark, str(tmp_path / "t")).select("id")) == pairs(df.select("id"))


def test_sparse_vectors(spark):
    s = V.sparse(F.lit(4), F.array(F.lit(1), F.lit(3)), F.array(F.lit(2.0), F.lit(5.0)))
    row = spark.range(1).select(V.to_dense(s).alias("d"), V.to_sparse(V.to_dense(s)).alias("s"), V.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a")).first()
    assert row["d"] == [0.0, 2.0, 0.0, 5.0] and row["s"]["idx"] == [1, 3] and row["a"] == 1


def test_shortest_paths_and_pagerank(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 2, 9), (1, 2, 3), (2, 3, 1), (9, 0, 1), (3, 77, 1)], "src long, dst long, weight long")
    vertices = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "id long")
    got, steps = graph.shortest_paths(vertices, edges, 0)
    assert pairs(got) == [(0, 0), (1, 2), (2, 5), (3, 6), (9, graph.UNREACHED)] and steps >= 4
    v = {i: 1.0 for i in (0, 1, 2, 3, 9)}
    e = [(a, b) for a, b, _ in map(tuple, edges.collect())]
    for _ in range(10):
        m = dict.fromkeys(v, 0.0)
        for a, b in e:
            if b in m:
                m[b] += v[a] / sum(x == a for x, _ in e)
        v = {i: 1 - graph.DAMPING + graph.DAMPING * m[i] for i in v}
    assert dict(pairs(graph.pagerank(vertices, edges))) == pytest.approx(v)


def test_supersteps_leave_edges_in_place(spark):
    rows = [(a, (a * 7 + k) % 50, a % 5 + k) for a in range(50) for k in range(1 + a % 9)] + [(3, d, 2) for d in range(200, 230)] + [(None, 1, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    lists = graph.packed(edges)
    again = lists.select("src", F.explode(F.arrays_zip("dst", "weight")).alias("e")).select("src", "e.*")
    assert pairs(again) == sorted(r for r in rows if r[0] is not None)
    v = graph.cut(graph.sources(lists).select("id", F.lit(1).alias("n_edges"), F.lit(1.0).alias("value"), F.lit(True).alias("active")), placed=True)
    program = graph.Computation(None, None, None, F.col("value") + F.col("weight"), None, F.min)
    plan = v.join(graph._deliver(v, lists, program).hint("shuffle_hash"), "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange ") == 1  # the combined messages alone
    dist = {v: 0 if v == 3 else graph.UNREACHED for v in range(50)}
    for _ in range(60):
        for a, b, w in rows[:-1]:
            if b in dist and dist[a] < graph.UNREACHED:
                dist[b] = min(dist[b], dist[a] + w)
    vertices = spark.range(50)
    for e in (edges, lists):
        assert dict(pairs(graph.shortest_paths(vertices, e, 3)[0])) == dist


def test_mlr_learns(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, float(i % 2)]) for i in range(20)], "id long, label int, features array<double>")
    w, history = mlr.Trainer(2, 2).train(rows, 20, 0.5, 0.9, 5)
    assert mlr.evaluate(rows, w).first()["accuracy"] == 1.0 and len(history) == 20
    assert step_size(0.1, 0.9, 5, 10) == pytest.approx(0.081)
    with pytest.raises(ValueError):
        step_size(0.1, 1.5, 5, 0)


def test_nmf_loss_falls(spark):
    r = spark.createDataFrame([(i, j, float(i * j)) for i in range(1, 6) for j in range(1, 6)], "i long, j long, v double")
    first = nmf.train(r, 2, 0)
    assert nmf.loss(r, *nmf.train(r, 2, 15, 0.01, 0.0)).first()[0] < 0.5 * nmf.loss(r, *first).first()[0]


def test_factors_by_function_or_by_table(spark):
    r = spark.createDataFrame([(i, j, float(i * j % 5)) for i in range(1, 4) for j in range(1, 5) if (i + j) % 4], "i long, j long, v double")
    f = nmf.hashed(2)
    tables = [nmf.hashed_factors(r.select(F.col(c).alias("id")).distinct(), 2) for c in "ij"]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(nmf.loss(r, f, f)) and "Join" in plan(nmf.loss(r, *tables))
    assert nmf.loss(r, f, f).first()[0] == pytest.approx(nmf.loss(r, *tables).first()[0])
    value = lambda i, k: (i * 31 + k * 17) % 100 / 100
    want = {1: {}, 0: {}}
    for i, j, v in map(tuple, r.collect()):
        e = sum(value(i, k) * value(j, k) for k in range(2)) - v
        for side, own, other in ((0, i, j), (1, j, i)):
            g = want[side].setdefault(own, [0.2 * value(own, k) for k in range(2)])
            want[side][own] = [g[k] + 2 * e * value(other, k) for k in range(2)]
    for factors in ((f, f), tables, (f, tables[1])):
        for side, g in enumerate(nmf.gradients(r, *factors, 2, 0.1)):
            got = dict(map(tuple, g.collect()))
            assert got.keys() == want[side].keys() and all(got[k] == pytest.approx(want[side][k]) for k in got)
    mixed = r.select(F.col("i").cast("int").alias("i"), "j", "v")  # the hash of an int is not that of a long
    start = nmf.random_factors(mixed.select(F.col("i").alias("id")).distinct(), 2, 7), nmf.random_factors(nmf.keys(mixed), 2, 8)
    by_table, by_function = ([dict(map(tuple, g.collect())) for g in nmf.gradients(mixed, *x, 2, 0.1)] for x in (start, (nmf.random(2, 7), nmf.random(2, 8))))
    assert all(a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a) for a, b in zip(by_table, by_function))


def test_ratings_come_in_parts_by_lines(spark, monkeypatch):
    from quern.plans import learning_queries as Q

    sizes = []
    for most in (10**6, 100):
        monkeypatch.setattr(Q, "LINES_A_TASK", most)
        sizes.append(Q.ratings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions())
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert sizes == [8, -(-lines // 100)]


def test_gibbs_keeps_tokens_and_repeats(spark):
    t = lda.first_topics(spark.createDataFrame([(d, p, f"w{(d + p) % 3}") for d in range(4) for p in range(9)], "doc_id long, pos long, word string"), 3)
    a, b = lda.gibbs(t, 3, 0.1, 0.01, 1), lda.gibbs(t, 3, 0.1, 0.01, 1)
    assert pairs(a) == pairs(b) and a.select("doc_id", "pos", "word", "topic").exceptAll(t.select("doc_id", "pos", "word", "topic")).isEmpty()
    assert {r["new_topic"] for r in a.collect()} <= {0, 1, 2}


def test_gibbs_against_one_token_at_a_time(spark, monkeypatch):
    import numpy as np

    rows = [(d, p, f"w{(d * d + p * p) % 23}", (d + p) % 4) for d in range(-2, 30) for p in range(1 + d * d % 37)]
    n, total = {}, np.zeros(4)
    for _, _, w, k in rows:
        n.setdefault(w, np.zeros(4))[k] += 1
        total[k] += 1
    want = []
    for d in range(-2, 30):
        doc = sorted(r for r in rows if r[0] == d)
        own = np.bincount([r[3] for r in doc], minlength=4).astype(float)
        for r, u in zip(doc, np.random.default_rng([5, d & 0x7FFFFFFF]).random(len(doc))):
            less = np.eye(4)[r[3]]
            own -= less
            p = np.cumsum((own + 0.1) * (n[r[2]] - less + 0.01) / (total - less + len(n) * 0.01))
            k = int(np.searchsorted(p, u * p[-1], "right"))
            own[k] += 1
            want.append((*r, k))
    tokens = spark.createDataFrame(rows, "doc_id long, pos long, word string, topic long").repartition(3)
    frame = lda.gibbs(tokens, 4, 0.1, 0.01, 5)
    assert pairs(frame) == want and "MapInArrow" in frame._jdf.queryExecution().executedPlan().toString()  # not a group a document
    monkeypatch.setattr(lda, "HOT", 8)  # some words by the matrix, others by the join
    monkeypatch.setattr(lda, "TASK", 50)
    monkeypatch.setattr(lda, "TOGETHER", 20)
    assert pairs(lda.gibbs(tokens, 4, 0.1, 0.01, 5)) == want
    assert lda.gibbs(tokens.where("doc_id > 99"), 4, 0.1, 0.01, 5).count() == 0


def test_greedy_categories_against_every_subset():
    values, g, n = list(range(5)), [5.0, -3.0, 1.0, -8.0, 2.0], [3, 2, 4, 1, 2]
    part = lambda s, c: s * s / (2 * c + 1.0)
    score = lambda m: part(sum(g[i] for i in values if i not in m), sum(n[i] for i in values if i not in m)) + part(sum(g[i] for i in m), sum(n[i] for i in m)) - part(sum(g), sum(n))
    best = max(score(m) for k in range(1, 5) for m in itertools.combinations(values, k))
    mask, gain = gbt.greedy_mask(values, g, n, 1.0, 0.0)
    assert gain == pytest.approx(score([i for i in values if mask >> i & 1])) and gain <= best + 1e-9 and gain > 0


def test_boosting_classes(spark):
    rows = spark.createDataFrame([(i % 2, [float(i % 2), float(i % 5)]) for i in range(40)], "label int, features array<double>")
    models = gbt.boost_classes(rows, {0: 0, 1: 5}, 2, 2, 3, 0.5)
    assert gbt.evaluate_classes(rows, models, {0: 0, 1: 5}, 0.5).first()["wrong"] == 0


def test_lasso_finds_weights(spark):
    rows = spark.createDataFrame([([float(i), float(i * i % 7)], 3.0 * i - 2.0 * (i * i % 7)) for i in range(30)], "features array<double>, label double")
    w = lasso.train(rows, [1.0, 1.0], 0.0, sweeps=200)
    assert w == pytest.approx([3.0, -2.0], abs=1e-6) and lasso.loss(rows, w).first()[0] < 1e-6
    assert lasso.descend([[4.0, 8.0], [8.0, 0.0]], [0.0], 0.0) == [0.0] and lasso.descend([[4.0, 8.0], [8.0, 0.0]], [0.0], 0.0, skip_zero=False) == [2.0]


def test_ranges(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 8, 10, 15, 16, 17)], "key long")
    runs = ranges.dense_ranges(keys, 4)
    assert pairs(runs) == [(1, 3), (7, 8), (10, 10), (15, 17)]
    assert pairs(ranges.complement(runs, 0, 20)) == [(0, 0), (4, 6), (9, 9), (11, 14), (18, 20)]
    other = spark.createDataFrame([(2, 7), (16, 30)], "first long, last long")
    assert pairs(ranges.intersection(runs, other, 4)) == [(2, 3), (7, 7), (16, 17)]


def test_ranges_meet_without_pairs(spark):
    a = [(-9, -5), (-3, 4), (6, 6), (10, 30), (12, 14), (40, 40), (10, 30)]  # some overlap or repeat in one set
    b = [(-7, -2), (0, 0), (4, 11), (10, 12), (29, 50), (60, 61)]
    want = sorted({(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if x[0] <= y[1] and y[0] <= x[1]})
    frame = lambda r: spark.createDataFrame(r, "first long, last long")
    for span in (1, 4, 1 << 16):
        assert pairs(ranges.intersection(frame(a), frame(b), span)) == want
    assert ranges.intersection(frame(a), frame([])).count() == 0
    odd = spark.range(120_000).select((F.col("id") * 2).alias("first"), (F.col("id") * 2).alias("last"))
    met = ranges.intersection(odd, odd)
    assert met.count() == 120_000 and "Join" not in met._jdf.queryExecution().executedPlan().toString()


def test_plans():
    assert planner.fifo_schedule([("a", 0, 2, 5), ("b", 1, 2, 2), ("c", 2, 1, 1)], 3) == [("a", 0), ("b", 5), ("c", 5)]
    assert planner.run_plan({1: lambda: 0, 2: lambda: 0, 3: lambda: 0}, {2: {1}, 3: {1}}) == [[1], [2, 3]]
    with pytest.raises(ValueError):
        planner.run_plan({1: lambda: 0, 2: lambda: 0}, {1: {2}, 2: {1}})
    servers, cost = planner.assign_roles([10.0, 1.0, 10.0], [5.0, 9.0, 5.0], 0.1)
    assert servers == [1] and cost > 0


def test_costs_without_pairs(spark):
    import random

    rng = random.Random(3)
    for some in (None, 5):  # any bandwidth, or few
        x = [(i, rng.choice([0.5, 7.0, 100.0, 11_000.0]) * rng.uniform(1, 2), float(rng.randrange(some) + 1) if some else rng.uniform(1, 4000)) for i in range(300)] + [(300, None, 5.0), (301, 9.0, None)]
        frame = planner.cost_model(spark.createDataFrame(x, "id long, throughput double, bandwidth double"), 500.0, 3.0)
        order = sorted(x, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        for w, cost in pairs(frame):
            c = w / sum(r[2] or 0 for r in order[w:])
            assert cost == pytest.approx(500 / sum(1 / (1 / t + 3 * max(1 / b if b else c, c)) for _, t, b in order[:w] if t), rel=1e-12)
        assert frame.count() == 301 and "Join" not in frame._jdf.queryExecution().executedPlan().toString()
    same = planner.cost_model(spark.createDataFrame([(i, 4.0, 1.0) for i in range(4)], "id long, throughput double, bandwidth double"), 8.0, 1.0)
    assert dict(pairs(same)) == pytest.approx({1: 10.0, 2: 5.0, 3: 26 / 3})  # at 2 both bounds are 1
    assert planner.cost_model(spark.createDataFrame([(1, 2.0, 3.0)], "id long, throughput double, bandwidth double"), 5.0, 3.0).count() == 0


def test_states_layers_and_hosts(spark, tmp_path):
    from quern.operators.states import StateMachine

    m = StateMachine(["new", "running", "closed"], "new", [("new", "running", "started"), ("running", "closed", "ended")])
    assert m.to("running") == "started" and not m.compare_and_set("new", "closed") and m.compare_and_set("running", "closed")
    for act in (lambda: m.to("new"), lambda: m.check("new"), lambda: m.to("nowhere"), lambda: StateMachine(["a"], "b", [])):
        with pytest.raises((RuntimeError, ValueError)):
            act()
    vertices = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = [(0, 1), (0, 2), (1, 3), (2, 3), (1, 2)]
    got = ranges.layers(vertices, spark.createDataFrame(edges, "src long, dst long")).collect()
    assert dict(map(tuple, got)) == {0: 0, 4: 0, 1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError, match="cycle"):
        ranges.layers(vertices, spark.createDataFrame([*edges, (3, 1)], "src long, dst long"))
    (tmp_path / "hosts").write_text("# host cores\na 4\nb 8\n\na 2\n")
    assert dict(map(tuple, loading.host_values(loading.read_lines(spark, str(tmp_path / "hosts")), "int").collect())) == {"a": 2, "b": 8}
    (tmp_path / "test").write_text("1 0:2.5 3:1\n# none\n2\n")
    rows = loading.read_test_data(spark, str(tmp_path / "test"), parsers.libsvm).collect()
    assert sorted(map(tuple, rows)) == [(1, [0, 3], [2.5, 1.0]), (2, [], [])]
    assert loading.read_test_data(spark, None, parsers.libsvm).count() == 0


def test_block_refuses_other_keys(spark):
    t = K.KeyedTable(spark.createDataFrame([(0, 1), (4, 2), (1, 3)], "key long, value long"))
    b = K.Block(t, 0, 4)
    assert sorted(r["key"] for r in b.rows().collect()) == [0, 4]
    assert sorted(map(tuple, b.remove(spark.createDataFrame([(4,)], "key long")).scan().collect())) == [(0, 1), (1, 3)]
    with pytest.raises(Exception, match="not of block 0"):
        b.put(spark.createDataFrame([(1, 9)], "key long, value long")).scan().collect()
