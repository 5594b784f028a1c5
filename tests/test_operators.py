import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions.vectors import code, normalise
from tidepool.operators import augment, imputation, metrics, profiling, rollup, vectors
from tidepool.plans import nodes as N
from tidepool.plans.planner import Engine


def hits(spark, cols):
    rows = [(0, c, r, t, d) for c, (ts, ds) in enumerate(cols) for r, (t, d) in enumerate(zip(ts, ds, strict=True))]
    return spark.createDataFrame(rows, "query int, query_col int, r int, table_id int, distance double")


def test_decay_vote(spark):
    got = {r.table_id: r.score for r in rollup.decay_vote(hits(spark, [([1, 2, 3], [0.1, 0.2, 0.3])])).collect()}
    assert got == {1: 3, 2: 2, 3: 1}
    tie = {r.table_id: r.score for r in rollup.decay_vote(hits(spark, [([1, 2, 3], [0.1, 0.1, 0.3])])).collect()}
    assert tie == {1: 3, 2: 3, 3: 2}
    two = rollup.ranked(rollup.decay_vote(hits(spark, [([1, 2], [0.1, 0.2]), ([2, 3], [0.1, 0.1])])))
    assert [(r.table_id, r.score) for r in two.orderBy("rank").collect()] == [(2, 3), (1, 2), (3, 2)]
    best = rollup.ranked(rollup.max_pool(hits(spark, [([4, 2], [-0.9, -0.9])])), 1)
    assert [r.table_id for r in best.collect()] == [2]


@pytest.mark.parametrize("seed", range(6))
def test_assignment(seed):
    rng = np.random.default_rng(seed)
    w = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
    got = sum(w[i, j] for i, j in rollup.assignment(w))
    small, big = sorted(w.shape)
    m = w if w.shape[0] <= w.shape[1] else w.T
    assert got == pytest.approx(max(sum(m[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small)))


def test_munkres(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "table_id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0])], "query long, embedding array<double>")
    got = {r.table_id: r.score for r in rollup.munkres(q, v.select(F.lit(0).cast("long").alias("query"), "table_id"), v, 0.5).collect()}
    assert got == {1: 2.0, 2: 1.0}


def test_assignment_without_a_matrix():
    """The same best assignment as over the matrix of all pairs, of which not half is held at once."""
    import tracemalloc

    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (5, 3), (3, 9), (40, 60)):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((n, 4)), rng.standard_normal((m, 4))))
        cos = a @ b.T
        want = sum(cos[i, j] for i, j in rollup.assignment(np.where(cos > 0.1, cos, 0.0)) if cos[i, j] > 0.1)
        assert abs(sum(rollup.assigned_cosines(a, b, 0.1)) - want) < 1e-9
    a = np.eye(600)
    tracemalloc.start()
    assert sum(rollup.assigned_cosines(a, a, 0.5)) == 600.0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 * 600 * 8 / 2


def test_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0],), ([-1.0, -1.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(code(F.col("v"), [[1, 0], [0, 1], [1, -1]])).collect()] == [0b101, 0b000, 0b000]
    assert df.select(normalise(F.col("v"))).collect()[2][0] == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.hyperplanes(31, 2)


def test_nearest_and_engine(spark, tiny):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 8))
    v = spark.createDataFrame([(i, i // 4, i, m[i].tolist()) for i in range(40)], "global_id long, table_id int, colid int, embedding array<double>")
    q = v.where("table_id = 0").select(F.col("colid").alias("query_col"), F.col("table_id").alias("query_table"), "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for k in (3, 50):
        got = {(r.query_col, r.r): r.global_id for r in vectors.nearest(q, v, k).collect()}
        for c in range(4):
            want = [int(j) for j in np.argsort(-(unit @ unit[c]), kind="stable") if j // 4][:k]
            assert [got[c, i] for i in range(len(want))] == want
    assert vectors.recall(vectors.lsh_nearest(q, v, 3), vectors.nearest(q, v, 3)).first().recall == 1.0
    e = Engine(tiny, v)
    assert e.run(N.SemanticUnion(table_id=0, k=3)).count() == 3
    assert e.run(N.SemanticJoin(table_id=0, colid=1, k=3, rollup="max_pool")).count() == 3
    assert e.run(N.SemanticUnion(table_id=0, k=3, rollup="munkres", threshold=0.1)).count() <= 3
    with pytest.raises(KeyError):
        e.run(N.SemanticJoin(table_id=0, colid=99))
    with pytest.raises(ValueError):
        e.run(N.SemanticUnion(table_id=0, rollup="other"))
    with pytest.raises(ValueError):
        N.SemanticJoin(table_id=0)
    assert vectors.bad_vectors(v).count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    """Several blocks of queries and vectors, copies that tie, a missing vector, one without a number and one of
    another width: the same rows as by comparing each pair; the pairs themselves are no rows."""
    monkeypatch.setattr(vectors, "MOST", (7, 20))
    monkeypatch.setattr(vectors, "PRODUCT", (3, 6))
    rng = np.random.default_rng(2)
    m = rng.standard_normal((90, 6)).round(1)
    m[10:60:3] = m[10]
    rows = [(i, i % 4, i, m[i].tolist()) for i in range(90)] + [(90, 3, 90, None), (91, 3, 91, [1.0, None] * 3), (92, 3, 92, [1.0, 2.0]), (93, 3, 93, [float("nan")] * 6)]
    v = spark.createDataFrame(rows, "global_id long, table_id int, colid int, embedding array<double>")
    q = v.where("global_id < 30").select(F.col("colid").alias("query_col"), F.col("table_id").alias("query_table"), "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), 0.0)
    for k in (5, 200):
        found = vectors.nearest(q, v, k)
        got = {(r.query_col, r.r): (r.global_id, r.similarity) for r in found.collect()}
        for c in range(30):
            far = [] if c % 4 == 3 else [90, 91, 92]
            want = ([] if c % 4 == 3 else [93]) + [int(j) for j in sorted(range(90), key=lambda j: (-round(dot(unit[c], unit[j]), 12), j)) if j % 4 != c % 4] + far
            assert [got[c, i][0] for i in range(min(k, len(want)))] == want[:k] and (c, len(want)) not in got
            assert k == 5 or far == [] or [got[c, len(want) - i][1] for i in (1, 2, 3)] == [None] * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = vectors.lsh_nearest(q, v.where("global_id < 90"), 5, refine=40)
    assert vectors.recall(got, vectors.nearest(q, v.where("global_id < 90"), 5)).first().recall == 1.0


def test_code_index(spark, tiny):
    raw = tiny.raw("city").union(tiny.raw("beta"))
    codes = vectors.code_index(raw, bits=8)
    assert {r.table_id for r in codes.select("table_id").distinct().collect()} == {1, 2}
    assert codes.where("table_id = 1 and colid = 1").count() == 0  # a column of digits
    e = Engine(tiny, codes=codes, code_bits=8)
    top = e.run(N.SimHash(["Paris", "Rome"], k=2)).orderBy("rank").first()
    assert (top.table_id, top.colid) == (2, 0)
    assert vectors.sample_rows(tiny.raw("gamma"), cap=5).select("rowid").distinct().count() == 5
    store = spark.createDataFrame([("Paris", [1.0])], "value string, embedding array<double>")
    assert vectors.missing_values(raw, store).where("value = 'Paris'").count() == 0
    assert vectors.column_sentence(tiny.by_row(), tiny.columns()).where("sentence like 'City contains 3 values%'").count() == 1


def test_metrics_golden(spark):
    run = spark.createDataFrame([(0, i, x) for i, x in enumerate("axbyc")], "query int, rank int, item string")
    truth = spark.createDataFrame([(0, x) for x in "abc"] + [(1, "z")], "query int, item string")
    m = {r.query: r for r in metrics.at_depths(run, truth, [5]).collect()}
    assert m[0].precision == pytest.approx(3 / 5) and m[0].recall == 1.0
    assert m[0].mean_precision == pytest.approx((1 + 1 / 2 + 2 / 3 + 2 / 4 + 3 / 5) / 5)
    assert m[0].ap == pytest.approx(34 / 45) and m[1].ap == 0.0 and m[1].hit == 0.0
    assert {r.query: r.ap for r in metrics.average_precision(run, truth).collect()}[0] == pytest.approx(34 / 45)
    c = metrics.ceilings(truth, [1, 3]).orderBy("k").collect()
    assert c[0].precision_ceiling == 1.0 and c[1].precision_ceiling == pytest.approx((1 + 1 / 3) / 2)
    d = metrics.truth_density(truth, spark.createDataFrame([(0,), (1,), (2,)], "query int")).first()
    assert (d.p50, d.p90, d.n_queries_with_gt) == (1.0, 3.0, 2)


def rbo(a, b, p=0.9):
    depth = max(len(a), len(b))
    return sum(len(set(a[: d + 1]) & set(b[: d + 1])) / (d + 1) * p**d for d in range(depth)) * (1 - p) / (1 - p**depth)


def test_compared(spark):
    r = random.Random(4)
    a, b = (r.sample(range(12), 7) for _ in range(2))
    as_df = lambda x: spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "query int, rank int, item int")
    got = metrics.compared(as_df(a), as_df(b)).first()
    assert got.rbo == pytest.approx(rbo(a, b)) and got.retention == len(set(a) & set(b)) / 7 and got.additions == len(set(a) - set(b))


def test_profiling(spark, tiny):
    types = {(r.table_id, r.colid): r.col_type for r in profiling.column_types(tiny.by_row()).collect()}
    assert types[3, 0] == "id" and types[2, 1] == "text"
    pair = profiling.key_value_pairs(tiny.by_row()).where("table_id = 3").first()
    assert (pair.key, pair.confidence) == (2, 1.0)  # a column with a decimal point counts as text
    a = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 9.0)], "key string, value double")
    assert profiling.spearman(a, a).first().rho == pytest.approx(1.0)
    assert profiling.spearman(a.limit(2), a).first().rho is None
    cards = spark.createDataFrame([(i, 0, c) for i, c in enumerate([5, 6, 50, 5000])], "table_id int, colid int, stratum int")
    assert len({r.stratum for r in profiling.stratified(cards, 3).collect()}) == 3


def test_imputation(spark, tiny):
    ex = spark.createDataFrame([("berlin", "germany")], "k string, v string")
    masked = spark.createDataFrame([("paris", "france"), ("oslo", "norway")], "k string, v string")
    ranked = spark.createDataFrame([(0, 2), (1, 3)], "rank int, table_id int")
    got = imputation.vote(tiny.by_row(), ranked, ex, masked)
    assert [(r.k, r.v) for r in got.collect()] == [("paris", "france")]
    s = imputation.score(got, masked).first()
    assert (s.n_keys, s.n_covered, s.coverage, s.accuracy) == (2, 1, 0.5, 1.0)
    a, b = imputation.split_query(spark.createDataFrame([(i, str(i), "v") for i in range(7)], "rowid int, k string, v string"))
    assert (a.count(), b.count()) == (5, 2)


def test_regimes(spark):
    pairs = spark.createDataFrame([("m", "q", 0, 0, 0.0, 0.0, False), ("m", "q", 2, 0, 0.0, 0.0, False), ("m", "q", 1, 3, 0.4, 0.2, False), ("m", "q", -1, 3, 0.4, 0.9, True)], "variant string, query_table string, rank int, n_inter int, cont_q2x double, cont_x2q double, numeric_q boolean")
    got = {r.bucket: r.hit_1 for r in metrics.regime_recall(pairs, [1]).collect()}
    assert got == {"0": 0.5, "(0.3,0.5]": 0.0}
    c = metrics.condensed_recall(pairs, [1, 2]).first()
    assert (c.n_semantic, c.raw_2, c.cond_2) == (2, 0.5, 1.0)


def test_streaming(spark, tmp_path):
    from tidepool.streaming import ingest

    src = str(tmp_path / "src")
    spark.createDataFrame([(0, "A"), (1, None)], "n long, v string").write.parquet(src)
    s = ingest.arriving(spark, "n long, v string", src)
    ingest.append(s, 7, "n", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.table_id, r.colid, r.rowid, r.token) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(7, 0, 0, "a"), (7, 0, 1, "")]


def test_queries_have_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_encoders(spark, tiny):
    from tidepool.operators import encoders

    v = encoders.vector_index(tiny, names=["alpha", "beta", "city"])
    assert v.count() == 6 and encoders.vector_index(tiny, names=["alpha", "beta", "city"]).count() == 6
    q = encoders.query_vectors(spark, spark.createDataFrame([("foo", " "), ("bar", None)], "n string, blank string"))
    assert [r.query_col for r in q.collect()] == [0]
    top = Engine(tiny, v).run(N.SemanticUnion(vectors=q, k=2, rollup="max_pool")).orderBy("rank").first()
    assert top.table_id == 0
    with pytest.raises(ValueError):
        encoders.query_vectors(spark, spark.createDataFrame([("x", "y")], "a string, A string"))
    with pytest.raises(KeyError):
        encoders.get("nothing")
    with pytest.raises(ValueError):
        encoders.register("hashing", encoders.hashing)


def test_experiments(spark, tiny):
    from tidepool.plans import experiments as x

    e = Engine(tiny)
    m = x.Matrix({("t", "ok"): lambda: spark.range(3), ("t", "bad"): lambda: 1 / 0}, 1)
    assert [r["rows"] for r in m.run()] == [3] and m.skipped[0][:2] == ("t", "bad")
    run = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "query int, rank int, item string")
    other = spark.createDataFrame([(0, 0, "c")], "query int, rank int, item string")
    truth = spark.createDataFrame([(0, "c")], "query int, item string")
    s = {r.weight: r.recall for r in x.fusion_sweep(run, other, truth, 1).collect()}
    assert s[0.0] == 0.0 and s[1.0] == 1.0
    d = x.difficulty(spark.createDataFrame([(0, 1.0), (1, 0.0)], "query int, recall double"), spark.createDataFrame([(0, 0.5), (2, 0.5)], "query int, recall double"))
    assert {r.query: r.bucket for r in d.collect()} == {0: "both", 1: "neither", 2: "exact"}
    for node in x.column_variants(e, tiny.frames["city"], 2).values():
        assert e.ids(node)[0] == 2
    ex = spark.createDataFrame([("berlin", "germany")], "k string, v string")
    tr = spark.createDataFrame([("paris", "france")], "k string, v string")
    legs = {(r.leg, r.k): r.accuracy for r in x.imputation_legs(e, ex, tr.select("k"), tr, [1]).collect()}
    assert legs == {("rows", 1): 1.0, ("keys", 1): 1.0, ("both", 1): 1.0}
    got = x.calibrate(tiny, {"Keyword": [N.Keyword(["foo"])]}, e)
    assert x.cost_report(got).first().cost == 1
    assert x.evaluate(run, truth, [1, 2]).count() == 2
    assert set(x.assisted(e, N.SingleColumn(["foo"], k=2), ["foo"], 2)) == {"alone", "within", "with", "without"}
    hits = spark.createDataFrame([(0, 0, i, t, i / 10) for i, t in enumerate([1, 2, 2, 3])], "query int, query_col int, r int, table_id int, distance double")
    grid = {(r.fetch, r.vote): (r.recall, r.full) for r in x.depth_grid(hits, spark.createDataFrame([(0, 3)], "query int, item int"), [2, 4, 9], [2, 4], 3).collect()}
    assert grid == {(2, 2): (0.0, 1.0), (4, 2): (0.0, 1.0), (4, 4): (1.0, 1.0), (9, 2): (0.0, 0.0), (9, 4): (1.0, 0.0)}


def test_command_line(spark, tmp_path, capsys):
    from tidepool.__main__ import main

    d = tmp_path / "csvs"
    d.mkdir()
    (d / "a.csv").write_text("s,t\nfoo,1\nbar,2\n")
    (d / "b.csv").write_text("s\nfoo\n")
    base = [str(d), "--index", str(tmp_path / "index")]
    main(["ingest", *base])
    main(["keyword", *base, "--values", "foo,bar"])
    main(["union", *base, "--table", "b.csv"])
    main(["types", *base])
    main(["rows", *base, "--values", "foo,1;bar,2"])
    main(["correlation", *base, "--values", "foo,3;bar,5"])
    out = capsys.readouterr().out
    assert "5 cells of 2 tables; copies agree: True" in out and "a.csv" in out


@pytest.fixture(scope="module")
def embedded(spark, tmp_path_factory):
    """A folder with 130 vectors of five labels."""
    r, d = random.Random(4), str(tmp_path_factory.mktemp("vectors"))
    rows = [(i, i % 5, [r.gauss(0, 1) for _ in range(64)]) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, rows


@pytest.mark.parametrize("name", ["lsh_recall", "depth_grid", "ann_frontier"])
def test_searches_query_every_20th_vector(spark, embedded, monkeypatch, name):
    from tidepool import queries as q

    seen, nearest = set(), q.vectors.nearest
    monkeypatch.setattr(q.vectors, "nearest", lambda queries, *a, **k: (seen.update(r.query_col for r in queries.select("query_col").collect()), nearest(queries, *a, **k))[1])
    q.QUERIES[name](spark, embedded[0]).collect()
    assert seen == {i for i in range(130) if i % 20 == 0}


def test_munkres_query_has_all_vectors(spark, embedded):
    from tidepool import queries as q

    d, rows = embedded
    unit = {t: np.array([np.array(e, dtype=np.float32).astype(float) for _, g, e in rows if g == t]) for t in range(5)}
    unit = {t: x / np.linalg.norm(x, axis=1, keepdims=True) for t, x in unit.items()}
    got = {r.table_id: r.score for r in q.QUERIES["munkres"](spark, d).collect()}
    for t in (0, 2, 3, 4):
        cos = unit[1] @ unit[t].T
        want = sum(cos[i, j] for i, j in rollup.assignment(np.where(cos > 0.1, cos, 0.0)) if cos[i, j] > 0.1)
        assert abs(got.pop(t) - want) < 1e-6
    assert not got


def test_legs_align_tables_once(spark, tiny, monkeypatch):
    """Alignment does not depend on a leg or its depth; voting over the kept answers is ``vote``."""
    from tidepool.operators import imputation
    from tidepool.plans import experiments

    count, align = [], imputation.align
    monkeypatch.setattr(imputation, "align", lambda *a: (count.append(1), align(*a))[1])
    ex = spark.createDataFrame([("berlin", "germany"), ("rome", "italy")], "k string, v string")
    tr = spark.createDataFrame([("paris", "france"), ("oslo", "norway")], "k string, v string")
    got = experiments.imputation_legs(Engine(tiny), ex, tr.select("k"), tr, [1, 3]).collect()
    assert len(got) == 6 and len(count) == 1
    ranked = spark.createDataFrame([(2, 0), (1, 1)], "table_id int, rank int")
    want = imputation.vote(tiny.by_row(), ranked, ex, tr.select("k")).collect()
    assert imputation.majority(imputation.answers(tiny.by_token(), tiny.by_row(), [1, 2], ex, tr.select("k")), ranked).collect() == want
    assert {(r.k, r.v) for r in want} == {("paris", "france")}
    assert imputation.answers(tiny.by_token(), tiny.by_row(), [], ex, tr.select("k")).count() == 0


def test_augmentation(spark):
    query = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "name string, size int")
    found = spark.createDataFrame([("q", "x", 1.0, None), ("q", "x", 3.0, None), ("r", "x", 3.0, None), ("p", "z", None, None), ("s", None, 9.0, None)], "tag string, label string, v double, none string")
    assert augment.best_columns(query, found) == {"name": "label", "size": "tag"}
    both = augment.union_by_overlap(query, found)
    assert both.dtypes == query.dtypes and both.count() == 8 and both.where("name = 'x' and size is null").count() == 3
    rows = {r.label: r[1:] for r in augment.modes(found, "label").collect()}
    assert rows == {"x": ("q", 3.0, None), "z": ("p", None, None)}
    tie = spark.createDataFrame([(1, 10), (1, 9), (1, None), (1, None), (1, None)], "k int, v int")
    assert [tuple(r) for r in augment.modes(tie, "k").collect()] == [(1, 9)]
    wide = {r.name: r for r in augment.join_modes(query, "name", found).collect()}
    assert wide["x"].tag_join == "q" and wide["y"].tag_join is None and wide[None].v_join is None and len(wide) == 3
    mean = augment.join_means(query.withColumn("v", F.lit(0)), "name", found)
    assert mean.columns == ["name", "size", "v", "v_correlation"]
    assert {r.name: r.v_correlation for r in mean.collect()} == {"x": pytest.approx(7 / 3), "y": None, None: None}
    assert augment.join_means(query, "name", found.limit(0)).count() == 3 and augment.union_by_overlap(query.limit(0), found.limit(0)).count() == 0


def test_own_table_is_dropped(spark, tiny):
    from tidepool.plans import adapters, tasks

    run = spark.createDataFrame([(7, i, x) for i, x in enumerate([5, 7, 6, 8])] + [(9, 0, 9)], "query long, rank int, item long")
    own = spark.createDataFrame([(7, 7), (9, 9)], "query long, item long")
    assert sorted(tuple(r) for r in adapters.without_self(run, own, 2).collect()) == [(7, 0, 5), (7, 1, 6)]
    frame = {i: tiny.frames[n] for i, n in enumerate(tiny.names)}
    plans = {i: (lambda k, i=i: tasks.union_search(frame[i], k)) for i in (0, 1, 3)}
    truth = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (1, 2), (3, 99), (2, 1)], "query int, item int")
    rows, mean = adapters.evaluate(Engine(tiny), plans, truth, 2)
    got = {r.query: r for r in rows.collect()}
    assert set(got) == {0, 1} and (mean["evaluated"], mean["skipped"], mean["total_queries"]) == (2, 1, 3)
    assert (got[0].n_relevant, got[0].hits, got[0].recall, got[0].reciprocal_rank) == (1, 1, 1.0, 1.0)
    assert got[1].n_relevant == 2 and got[1].runtime_ms > 0 and mean["mrr"] > 0
    none, mean = adapters.evaluate(Engine(tiny), {}, truth, 2)
    assert none.count() == 0 and mean["map"] == 0.0


def test_spearman_loses_no_key_when_means_move(spark):
    """Means differ each time they are computed, as on a cluster where their parts arrive in any order; no key may be lost."""

    def noisy(batches):
        for batch in batches:
            yield batch.assign(value=[v + random.SystemRandom().random() * 1e-9 for v in batch["value"]])

    keys = spark.range(50).select(F.col("id").alias("key"), F.col("id").cast("double").alias("value")).mapInPandas(noisy, "key long, value double")
    was = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = profiling.spearman(keys, keys).first()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", was)
    assert got.n == 50 and got.rho == pytest.approx(1.0)
