"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib

import pytest

from tidepool.llm import chat, decontam, langid, licenses, linededup, minhash, mixing, pii, quality, substring

LONG = " ".join(f"w{i % 977} v{i % 31}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "null id " * 30), (7, "a b\nc d\n" * 3), (7, "other text of the same id")]


def test_operators_on_odd_rows(spark, docs):
    d = docs(ODD)
    items = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one", "x"), (None, "null id null id null", "x"), (4, "w1 v1 w2 v2 w3 v3 w4 v4 w5", "x")], "item_id long, text string, grams string")
    mix = mixing.pareto_mix(spark, d).collect()
    assert len(mix) == 10 and all(r.taken <= 3 * r.size for r in mix) and sum(r.size == 0 for r in mix) == 3
    good = quality.judge(spark, d).collect()
    assert len(good) == 10 and {r.n_words for r in good} >= {0, 1, 120_000}
    assert quality.judge(spark, d, keep=True).columns == d.columns
    hit = {r.doc_id: r for r in decontam.contamination(spark, d, items).collect()}
    assert hit[4].n_hit == 1 and hit[4].n_items == 1 and hit[None].n_hit > 0 and hit[None].n_items == 0 and hit[1].n_words == 0
    assert hit[5].n_items == 1 and hit[5].n_hit >= 9
    out = linededup.dedup_lines(spark, d)
    assert out.count() == 10 and [c for c in out.columns if c not in ("_lines", "_removed")] == d.columns
    assert {r.doc_id: r.text for r in out.collect()}[1] is None
    near = minhash.near_duplicates(spark, d).collect()
    assert len(near) == 10 and {r.doc_id: r.component_id for r in near}[6] == 5
    assert {r.n_shingles for r in near if r.doc_id in (1, 2, 3)} == {0}
    cut = substring.remove_repeats(spark, d).collect()
    assert len(cut) == 10 and {r.doc_id: r.n_removed for r in cut}[6] == 120_000 and {r.doc_id: r.n_removed for r in cut}[5] == 0
    assert pii.pseudonymize(d, "k", count_col="size").select("size").distinct().count() == 1


def test_empty_tables(spark, docs):
    d = docs([]).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    assert mixing.pareto_mix(spark, d).count() == 0
    assert quality.judge(spark, d).count() == 0 and quality.judge(spark, d, keep=True).count() == 0
    assert decontam.contamination(spark, d, items).count() == 0
    assert decontam.contamination(spark, docs([(1, "a b")]), items).first().n_hit == 0
    assert linededup.dedup_lines(spark, d).count() == 0
    assert minhash.near_duplicates(spark, d).count() == 0
    assert substring.remove_repeats(spark, d).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(turns)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(spark, pages, docs([(1, "the cat")])).count() == 0
    assert langid.identify(spark, pages, d).count() == 0
    assert licenses.scan(spark, licenses.page_files(pages)).count() == 0
    assert pii.pseudonymize(d, "k").count() == 0


def test_all_null(spark):
    d = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.pareto_mix(spark, d).count() == 2
    assert quality.judge(spark, d).where("kept").count() == 0
    assert linededup.dedup_lines(spark, d).count() == 2
    assert minhash.near_duplicates(spark, d).where("kept").count() == 2
    assert [r.kept_sha256 for r in substring.remove_repeats(spark, d).collect()] == [hashlib.sha256(b"").hexdigest()] * 2
    p = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    assert langid.identify(spark, p, labelled).count() == 1
    assert licenses.scan(spark, licenses.page_files(p)).first().license is None
    t = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(t)).first().n_turns == 1


def test_large_sides_are_salted(spark):
    from tidepool.llm._store import attach

    big = spark.range(1000).selectExpr("id % 3 as k", "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, v string")
    for rows in (0, 100):
        got = sorted(tuple(r) for r in attach(big, small, ["k"], rows=rows).groupBy("k", "v").count().collect())
        assert got == [(0, "a", 334), (1, "b", 333)]
        assert attach(big, small, ["k"], "left", rows=rows).count() == 1000
        assert attach(big, small.select("k"), ["k"], "left_semi", rows=rows).count() == 667


def test_components(spark):
    from tidepool.llm._store import Scratch, components

    rows = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 200), (200, 7), (300, 301), (301, 302), (302, 300), (5, 5)]
    edges = spark.createDataFrame(rows, "a long, b long")
    for few in (0, 1000):
        got = {r.node: r.component for r in components(Scratch(spark, "t"), edges, few=few).collect()}
        assert got == {**{i: 0 for i in range(41)}, 200: 0, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300, 302: 300}
        assert components(Scratch(spark, "t"), edges.where("false"), few=few).count() == 0


@pytest.mark.parametrize("name", ["tidepool", "tidepool.queries"])
def test_nothing_else_imports_this(name):
    import subprocess
    import sys

    code = f"import sys, {name}; assert not [m for m in sys.modules if m.startswith('tidepool.llm')]"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
