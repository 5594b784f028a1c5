import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.operators import seekers, setops
from tidepool.operators.filters import IdFilter
from tidepool.plans import config, correctness, costs, tasks
from tidepool.plans import nodes as N
from tidepool.plans.plan import Plan
from tidepool.plans.planner import Engine, Options, Reach, reach
from tidepool.sources.lake import Lake


@pytest.fixture(scope="module")
def engine(tiny):
    return Engine(tiny)


def ids(df):
    return [r.table_id for r in df.orderBy("rank").collect()]


def test_keyword_and_column(engine):
    assert ids(engine.run(N.Keyword(["FOO", "bar", "baz", None, "nan"], k=5))) == [0, 1]
    top = [(r.table_id, r.colid, r.score) for r in engine.run(N.SingleColumn(["a", "b", "c", "foo"], k=5)).orderBy("rank").collect()]
    assert top == [(3, 1, 3), (0, 0, 1), (1, 0, 1)]
    assert ids(engine.run(N.Keyword(["", "nan"]))) == []


def test_costs_and_order(engine):
    kw, sc, mc = N.Keyword(["x"]), N.SingleColumn(["x"]), N.MultiColumn([("x", "y")])
    assert [x.cost for x in (kw, sc, mc)] == [3, 4, 10]
    assert N.Intersection((mc, sc)).cost == 4 and N.Union((mc, sc)).cost == 14 and N.Difference((mc, sc)).cost == 4
    assert engine.order(N.Intersection((mc, sc, kw))) == [kw, sc, mc]
    assert engine.order(N.Intersection((mc, N.SingleColumn(["x"], order_cost=99)))) == [mc, N.SingleColumn(["x"], order_cost=99)]
    assert engine.order(N.Intersection((mc, kw), fixed=True)) == [mc, kw]
    late = Engine(engine.lake, options=Options(exact_first=True))
    assert late.order(N.Intersection((N.SemanticJoin(table_id=0, colid=0), mc)))[0] is mc


def test_pushdown_changes_what_is_cut(engine):
    a, b = N.Keyword(["foo"], k=1), N.SingleColumn(["foo", "baz"], k=1)
    assert ids(engine.run(N.Intersection((a, b), k=2))) == [0]
    pure = Engine(engine.lake, options=Options(pushdown=False))
    assert ids(pure.run(N.Intersection((a, b), k=2))) == []
    assert ids(engine.run(N.Difference((N.Keyword(["foo"], k=1), N.Keyword(["bar"], k=1)), k=2))) == [1]
    assert correctness.sound(engine, N.Intersection((a, b), k=2))
    rows = {r.arm: r for r in correctness.compare(engine, N.Intersection((a, N.Keyword(["foo", "bar"], k=2)), k=2), ("optimised", "no_pushdown")).collect()}
    assert rows["no_pushdown"].retention == 1.0
    curve = correctness.width_curve(engine, N.Intersection((a, b), k=1), [1, 5])
    assert [r.recovered for r in curve.orderBy("width").collect()] == [0.5, 1.0]


def test_combiners(spark):
    v = lambda *x: setops.values(spark, x)
    assert ids(setops.pure_intersection([v(3, 1, 2), v(2, 3)])) == [3, 2]
    assert ids(setops.pure_difference(v(3, 1, 2), v(1))) == [3, 2]
    assert ids(setops.union([v(5, 1), v(7, 1)], 3)) == [5, 7, 1]
    assert [(r.table_id, r.score) for r in setops.counter([v(5, 1), v(7, 1)]).orderBy("rank").collect()] == [(1, 2), (5, 1), (7, 1)]
    assert ids(setops.fusion([v(1, 2), v(3, 2)])) == [2, 1, 3]
    assert ids(setops.values(spark, [4, 4, 2])) == [4, 2]
    assert ids(setops.repair(v(1, 2), v(1, 9), v(9, 8), v(2))) == [1, 9]


def test_filters():
    f = IdFilter.of(allow=[1, 2]).also(allow=[2, 3], deny=[5])
    assert f.allow == {2} and f.deny == {5} and not f.empty
    assert IdFilter.of(allow=[1], deny=[1]).empty and not IdFilter().empty and IdFilter.of(allow=[]).empty


def mc_spec(tables, query):
    """Multi-column search by its definition, for two columns."""
    out = {}
    second = {b for _, b in query if b}
    for t, rows in tables.items():
        counts = defaultdict(int)
        for row in rows:
            weight = sum(c in second for c in row)
            if not weight:
                continue
            for col, cell in enumerate(row):
                for a, b in query:
                    if a and cell == a and b in row:
                        counts[col, tuple(i for i, c in enumerate(row) if c == b)] += weight
        if counts:
            out[t] = max(counts.values())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_multi_column(spark, tmp_path, seed):
    r = random.Random(seed)
    value = lambda: r.choice(["a", "b", "c", "d", ""])
    tables = {i: [[value() for _ in range(3)] for _ in range(6)] for i in range(4)}
    lake = Lake(spark, {f"t{i}": spark.createDataFrame(rows, "x string, y string, z string") for i, rows in tables.items()}, str(tmp_path / "lake"))
    query = [(value(), value()) for _ in range(4)] + [("a", "b")]
    want = mc_spec(tables, query)
    for prune in (False, True):
        assert {x.table_id: x.score for x in seekers.multi_column(lake, query, prune=prune).collect()} == want


def test_one_and_three_columns(tiny):
    got = {r.table_id: r.score for r in seekers.multi_column(tiny, [("paris",), ("foo",)]).collect()}
    assert got == {0: 2, 1: 1, 2: 2}
    three = {r.table_id: r.score for r in seekers.multi_column(tiny, [("1", "b", "1.0"), ("9", "z", "9.0")]).collect()}
    assert three == {3: 1}


def test_correlation(engine):
    r = engine.run(N.Correlation(["a", "b", "c"], [0.0, 1.0, 2.0], k=5)).collect()
    assert {(x.table_id, x.colid, x.numcol) for x in r} == {(3, 1, 0), (3, 1, 2)}
    assert engine.run(N.Correlation(["a", None], [1.0, 2.0])).count() == 0


def test_plan(engine):
    p = Plan(engine).add("a", N.Keyword(["foo"], k=3)).add("b", N.SingleColumn(["foo"], k=3))
    with pytest.raises(ValueError):
        _ = p.terminal
    with pytest.raises(ValueError):
        p.add("a", N.Keyword(["x"]))
    with pytest.raises(TypeError):
        p.add("c", "keyword")
    with pytest.raises(ValueError):
        p.add("c", N.Keyword(["x"]), ["a"])
    with pytest.raises(KeyError):
        p.add("c", N.Union, ["nope"])
    assert p.add("c", N.Union, ["a", "b"]).ids() == [0, 1]
    with pytest.raises(ValueError):
        N.Difference((N.Keyword(["x"]),))
    with pytest.raises(TypeError):
        N.Union(("x",))


def test_reach():
    node, o = N.SemanticUnion(table_id=0, k=10), Options()
    assert reach(node, o, 900) == Reach(30, 20, True) and reach(node, o, 5000) == Reach(30, 20, False)
    assert reach(node, o, 5000, 40) == Reach(40, 40, True) and reach(node, o, 5000, 3000) == Reach(500, 500, False)
    assert reach(N.SemanticUnion(table_id=0, k_coarse=7), o, 5000, 40) == Reach(7, 7, True)
    late = N.SemanticUnion(table_id=0, prefilter=False)
    assert not reach(late, o, 5000, 40).exact  # the filter comes after the search
    assert reach(node, Options(exact_columns=10), 11, 10).exact and not reach(node, Options(exact_columns=10), 11).exact


def test_dispatch(spark, tiny):
    """More columns than ``exact_columns`` are searched by hashing, fewer after a filter exactly."""
    r = __import__("random").Random(0)
    centre = [[r.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = [(i, i % 4, i, [x + r.gauss(0, 0.3) for x in centre[i % 3]]) for i in range(200)]
    v = spark.createDataFrame(rows, "global_id long, table_id int, colid int, embedding array<double>")
    node = N.SemanticUnion(table_id=1, k=3)
    engine = lambda n: Engine(tiny, v, options=Options(exact_columns=n))
    plan = lambda e, keep: e.scored(node, keep)._jdf.queryExecution().analyzed().toString()
    none, one = IdFilter(), IdFilter.of(deny=[3])
    assert "_bits" in plan(engine(100), none) and "_bits" not in plan(engine(1000), none)
    assert "_bits" in plan(engine(149), one) and "_bits" not in plan(engine(150), one)
    assert ids(engine(100).run(node)) == ids(engine(1000).run(node))


def test_config():
    s = config.load("[search]\nk = 7\n[planner]\npushdown = no\nguard_width = 500\n")
    assert s.k == 7 and not s.options.pushdown and s.options.guard_width == 500 and s.code_bits == 18


def test_tasks_build(spark, engine, tiny):
    df = tiny.frames["city"]
    for node in (tasks.union_search(df, 2), tasks.union_by_votes(df, 2), tasks.imputation(df, df.select("City"), 2), tasks.negative_examples(df, df.limit(1), 2), tasks.dependent_data(df, ["City", "Country"], ["Country", "City"], 2)):
        assert engine.run(node).count() >= 0
    assert ids(engine.run(tasks.union_by_votes(df, 2)))[0] == 2


def test_costs(spark, tmp_path):
    s = spark.createDataFrame([("a", 1.0, "ok"), ("a", 3.0, "ok"), ("a", 9.0, "censored"), ("b", 9.0, "censored")], "kind string, seconds double, outcome string")
    got = {r.kind: r["q0.5"] for r in costs.censored_quantiles(s).collect()}
    assert got == {"a": 3.0, "b": None}
    m = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("c", 3.0)], "kind string, median double")
    assert {r.kind: r.cost for r in costs.cost_integers(m).collect()} == {"a": 1, "b": 2, "c": 2}
    q = spark.createDataFrame([(0, 0, 0, "x"), (0, 0, 1, "u"), (0, 1, 0, "y"), (0, 1, 1, "u")], "query int, qid int, col int, token string")
    fr = spark.createDataFrame([("x", 4), ("y", 5), ("u", 4)], "token string, n long")
    r = costs.features(q, fr).first()
    assert (r.rows, round(r.frequency, 9), r.columns) == (2, 6.0, 2)
    pts = spark.createDataFrame([(n, k, 1.0 + 2 * n + 3 * k + 0.5 * n * k) for n, k in itertools.product((1, 2, 4), (10, 30))], "n_cols int, k_coarse int, ms double")
    coef = costs.fit_unfiltered(pts, "union")
    assert [round(coef[x], 6) for x in "abcd"] == [1.0, 2.0, 3.0, 0.5]
    assert round(costs.predict_unfiltered(coef, 3, 20), 6) == 97.0
    assert costs.predict_filtered(2, 10, 1.0, 0.1, 5, 7.0) == 14.0 and costs.predict_filtered(2, 4, 1.0, 0.1, 5, 7.0) == 2.8
    assert costs.measure(lambda: 1, 1)[1] == "ok" and costs.measure(lambda: 1 / 0)[1] == "error"
    costs.save_profile(spark, "p", {"a": 1}, str(tmp_path))
    assert costs.load_profile(spark, "p", str(tmp_path)) == {"a": 1}
    samples = spark.createDataFrame([(float(i), float(i * 2), 2.0, i * 0.1) for i in range(30)], "rows double, frequency double, columns double, seconds double")
    assert costs.train(samples, 2).numFeatures == 3
    assert costs.with_deadline(spark.range(3), 30, "t1") and N.Keyword(["x"], predicted=2.0).runtime == 2.0


def test_disagreement(spark):
    runs = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 0, 5), ("b", 1, 0, 6)], "arm string, repeat int, rank int, item int")
    got = {r.same_arm: (r.pairs, r.lists_differ) for r in correctness.disagreement(runs).collect()}
    assert got == {True: (1, 0.0), False: (2, 1.0)}


def test_scored_is_not_cut(engine):
    assert engine.scored(N.Keyword(["foo"])).agg(F.sum("score")).first()[0] == 2
