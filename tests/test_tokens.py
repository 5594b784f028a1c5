from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions.tokens import covers, signature, token

SAMPLES = {
    " Foo ": "foo", "A\"B'C": "abc", "tab\there": "tabhere", "line\nend\r": "lineend", "back\\slash": "backslash", "a/b": "a/b", "NaN": "", "None": "", " none ": "", "x" * 250: "x" * 200,
    "1": "1", "1.50": "1.50", "": "", "nano": "nano", "ÄÖ": "äö",
}


def test_samples(spark):
    df = spark.createDataFrame([(k,) for k in SAMPLES] + [(None,)], "v string")
    got = {r.v: r.t for r in df.select("v", token(F.col("v")).alias("t")).collect()}
    assert got == {**SAMPLES, None: ""}


def spec(t: str) -> tuple[int, int]:
    """The signature by its definition, with whole numbers."""
    alphabet = " 0123456789abcdefghijklmnopqrstuvwxyz"
    field, n = 0, len(t)
    for c, _ in sorted(Counter(t).items(), key=lambda x: (x[1], x[0]))[:5]:
        if c in alphabet:
            mean = sum(i for i, x in enumerate(t) if x == c) / t.count(c)
            field |= 1 << (alphabet.index(c) * 3 + max(int(mean / n * 3 - 1e-6), 0))
    turn = 111 * (n % 17) // 17
    field = ((field << turn) | (field >> (111 - turn))) % (1 << 111) | 1 << (111 + n % 17)
    return field >> 64, field & (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz 0189-ä", max_size=25), min_size=1, max_size=60))
def test_signature(spark, words):
    words = sorted({*words, "", "zzzz", "a"})
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for r in df.select("t", signature(F.col("t")).alias("s")).collect():
        hi, lo = spec(r.t)
        assert (r.s.hi, r.s.lo) == (signed(hi), signed(lo)), r.t


@pytest.mark.parametrize(("row", "query", "expected"), [(0b1110, 0b0110, True), (0b1110, 0b0001, False), (-1, 1 << 62, True)])
def test_covers(spark, row, query, expected):
    df = spark.createDataFrame([(row, 0, query, 0)], "a long, b long, c long, d long")
    assert df.select(covers(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] is expected


def test_many_signatures_at_once(spark):
    """``rowkeys`` signs by ``signatures``; both give the same, for odd tokens too."""
    import pyarrow as pa

    from tidepool.functions.tokens import signatures
    from tidepool.sources.lake import rowkeys

    toks = ["", "a", "zz top", "ÄÖ ä", "😀b😀", "1.0e10", "x" * 200, "abc-def-abc", "the quick brown fox", "á", "0000001", "mississippi"]
    df = spark.createDataFrame([(i // 5, i // 2, t) for i, t in enumerate(toks)], "table_id int, rowid long, token string")
    want = {r.token: tuple(r.s) for r in df.select("token", signature(F.col("token")).alias("s")).collect()}
    assert list(zip(*(x.tolist() for x in signatures(pa.array(toks))), strict=True)) == [want[t] for t in toks]
    rows = {}
    for i, t in enumerate(toks):
        hi, lo = rows.get((i // 5, i // 2), (0, 0))
        rows[i // 5, i // 2] = (hi | want[t][0], lo | want[t][1])
    found = rowkeys(df)
    assert {(r.table_id, r.rowid): (r.hi, r.lo) for r in found.collect()} == rows
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


def test_plain_values_have_the_same_tokens(spark):
    from tidepool.functions.tokens import plain_token

    df = spark.sql("select * from values (1.5d, 1e10d, float('nan'), -7, true, date'2020-01-02', timestamp'2020-01-02 03:04:05'), (null, -0.0d, float('inf'), null, null, null, null) t(a, b, c, d, e, f, g)")
    for c in df.columns:
        assert df.where(~plain_token(F.col(c)).eqNullSafe(token(F.col(c)))).count() == 0
