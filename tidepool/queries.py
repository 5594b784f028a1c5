"""The engine's queries by name, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.tokens import signature, token, tokens_of
from .functions.vectors import code, normalise
from .operators import augment, encoders, imputation, metrics, profiling, rollup, seekers, setops, vectors
from .operators.filters import IdFilter
from .plans import adapters, correctness, costs, experiments, tasks
from .plans import nodes as N
from .plans.plan import Plan
from .plans.planner import Engine, Options
from .sources.lake import Lake, rowkeys, shared_lake
from .streaming import ingest

#: Tables of the lake that the queries search, with their columns; numbers are marked.
TABLES = {
    "benchmark": "item_id# text",
    "customer": "c_custkey# c_name c_nationkey# c_acctbal# c_mktsegment",
    "events": "event_id# ts user_id# event_type value# props",
    "labels": "doc_id# quality# toxic#",
    "lineitem": "l_orderkey# l_partkey# l_suppkey# l_linenumber# l_quantity# l_extendedprice# l_discount# l_tax# l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey# n_name n_regionkey#",
    "orders": "o_orderkey# o_custkey# o_orderstatus o_totalprice# o_orderdate o_orderpriority",
    "part": "p_partkey# p_name p_brand p_type p_size# p_retailprice#",
    "region": "r_regionkey# r_name",
    "supplier": "s_suppkey# s_name s_nationkey# s_acctbal#",
}
IDS = {n: i for i, n in enumerate(sorted(TABLES))}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lake(spark: SparkSession, d: str) -> Lake:
    return shared_lake(spark, d, TABLES)


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    """Stored columns: a label is a table, a vector one of its columns."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("global_id"), F.col("label").cast("int").alias("table_id"), F.col("vec_id").cast("int").alias("colid"), "embedding")


def engine(spark: SparkSession, d: str, **options) -> Engine:
    return Engine(lake(spark, d), vector_table(spark, d), options=Options(**options))


# -- SQL pieces ----------------------------------------------------------------------------------


def tok(x: str) -> str:
    clean = rf"""left(regexp_replace(regexp_replace(lower(CAST({x} AS VARCHAR)), '[\\''"\t\n\r]', '', 'g'), '^\s+|\s+$', '', 'g'), 200)"""
    return f"CASE WHEN {clean} IN ('nan', 'none') THEN '' ELSE coalesce({clean}, '') END"


def _cells() -> str:
    rows, parts = [], []
    for name, i in IDS.items():
        rows.append(f"t{i} AS (SELECT row_number() OVER () - 1 AS rowid, * FROM {name})")
        for j, c in enumerate(TABLES[name].split()):
            col = f'"{c.rstrip("#")}"'
            upper = f"coalesce({col} >= avg({col}) OVER (), false)" if c.endswith("#") else "CAST(NULL AS BOOLEAN)"
            parts.append(f"SELECT {i} AS table_id, {j} AS colid, rowid, CAST({col} AS VARCHAR) AS v, {upper} AS quadrant FROM t{i}")
    return ",\n".join(rows) + ",\nraw AS (" + "\nUNION ALL ".join(parts) + f"),\ncells AS MATERIALIZED (SELECT table_id, colid, rowid, {tok('v')} AS token, quadrant FROM raw)"


CELLS = _cells()


def values_sql(values: list[str]) -> str:
    quoted = [f"('{v}')" for v in values]
    return f"(SELECT DISTINCT {tok('v')} AS token FROM (VALUES {', '.join(quoted)}) x(v) WHERE {tok('v')} <> '')"


def kw_sql(tokens: str, k: int, keep: str = "true") -> str:
    return f"SELECT table_id, score, row_number() OVER (ORDER BY score DESC, table_id) - 1 AS rank FROM (SELECT table_id, count(DISTINCT token) AS score FROM cells WHERE token IN {tokens} AND {keep} GROUP BY 1 ORDER BY score DESC, table_id LIMIT {k})"


def sc_sql(tokens: str, k: int, keep: str = "true") -> str:
    return f"SELECT table_id, colid, score, row_number() OVER (ORDER BY score DESC, table_id, colid) - 1 AS rank FROM (SELECT table_id, colid, count(DISTINCT token) AS score FROM cells WHERE token IN {tokens} AND {keep} GROUP BY 1, 2 ORDER BY score DESC, table_id, colid LIMIT {k})"


def c_sql(source: str, k: int, keep: str = "true") -> str:
    """``source`` selects ``s`` and ``t``."""
    return f"""SELECT table_id, colid, numcol, score, abs(score) AS strength, row_number() OVER (ORDER BY abs(score) DESC, table_id, colid, numcol) - 1 AS rank FROM (
  SELECT table_id, catcol AS colid, numcol, CAST(2 * sum(CAST(high = upper AS INT)) - count(*) AS BIGINT) AS score FROM (
    SELECT c.table_id, c.colid AS catcol, n.colid AS numcol, c.token, q.high, avg(CAST(n.quadrant AS INT)) > 0.5 AS upper, count(DISTINCT n.token) AS n, min(n.token) AS least
    FROM cells c JOIN (SELECT token, max(high) AS high FROM (SELECT {tok("s")} AS token, m >= avg(m) OVER () AS high FROM (SELECT CAST(s AS VARCHAR) AS s, avg(CAST(t AS DOUBLE)) AS m FROM ({source}) WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY 1)) WHERE token <> '' GROUP BY 1) q USING (token)
    JOIN cells n ON n.table_id = c.table_id AND n.rowid = c.rowid
    WHERE c.rowid < 256 AND n.rowid < 256 AND n.quadrant IS NOT NULL AND {keep.replace("table_id", "c.table_id", 1)} GROUP BY ALL)
  GROUP BY 1, 2, 3 HAVING count(*) > 1 AND (count(DISTINCT least) > 1 OR sum(n) > count(*))
  ORDER BY abs(score) DESC, table_id, colid, numcol LIMIT {k})"""


def mc_sql(rows: str, k: int, keep: str = "true") -> str:
    """Two query columns; ``rows`` selects ``a`` and ``b``."""
    return f"""SELECT table_id, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, table_id) - 1 AS rank FROM (
  SELECT table_id, max(n) AS score FROM (
    SELECT table_id, colid, cols, sum(c) AS n FROM (
      SELECT x.table_id, x.rowid, x.colid, x.qid, x.c, list(i.colid ORDER BY i.colid) AS cols FROM (
        SELECT h.table_id, h.rowid, h.colid, q.qid, q.b, m.c FROM cells h
        JOIN (SELECT row_number() OVER () AS qid, {tok("a")} AS a, {tok("b")} AS b FROM ({rows})) q ON q.a = h.token
        JOIN (SELECT table_id, rowid, count(*) AS c FROM cells WHERE token IN (SELECT {tok("b")} FROM ({rows})) AND token <> '' GROUP BY 1, 2) m ON m.table_id = h.table_id AND m.rowid = h.rowid
        WHERE h.token <> '' AND {keep.replace("table_id", "h.table_id", 1)}) x
      JOIN cells i ON i.table_id = x.table_id AND i.rowid = x.rowid AND i.token = x.b GROUP BY 1, 2, 3, 4, 5)
    GROUP BY 1, 2, 3) GROUP BY 1 ORDER BY score DESC, table_id LIMIT {k})"""


def with_cells(body: str, more: str = "") -> str:
    return f"WITH {CELLS}{', ' + more if more else ''}\n{body}"


WORDS = ["ASIA", "Europe", "FRANCE", " building ", "1-URGENT", "O", "nan", "none", ""]
NAMES = ["FRANCE", "GERMANY", "asia", "MACHINERY", "AUTOMOBILE", "F"]
KW, NM = values_sql(WORDS), values_sql(NAMES)
URGENT = f"(SELECT DISTINCT {tok('o_custkey')} FROM orders WHERE o_orderpriority = '1-URGENT')"
PAIRS = "SELECT n_nationkey AS a, n_regionkey AS b FROM nation"
SPEND = "SELECT c_nationkey AS s, c_acctbal AS t FROM customer"
SIZES = "SELECT p_size AS s, p_retailprice AS t FROM part"


def urgent(spark, d) -> DataFrame:
    return read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")


def pairs(spark, d) -> DataFrame:
    return read(spark, d, "nation").select("n_nationkey", "n_regionkey")


def spend(spark, d) -> DataFrame:
    return read(spark, d, "customer").select("c_nationkey", "c_acctbal")


def sizes(spark, d) -> DataFrame:
    return read(spark, d, "part").select("p_size", "p_retailprice")


# -- index -------------------------------------------------------------------------------------------


@query(with_cells("SELECT table_id, colid, count(*) AS n, count(DISTINCT token) AS n_distinct, count(*) FILTER (token = '') AS n_empty, count(*) FILTER (quadrant) AS n_upper, count(*) FILTER (quadrant IS NULL) AS n_none FROM cells GROUP BY 1, 2"))
def cell_profile(spark, d):
    c = lake(spark, d).cells()
    return c.groupBy("table_id", "colid").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_distinct"), F.count_if(F.col("token") == "").alias("n_empty"), F.count_if("quadrant").alias("n_upper"), F.count_if(F.col("quadrant").isNull()).alias("n_none"))


@query(with_cells("SELECT rowid, colid, token, quadrant FROM cells WHERE table_id = 9"))
def cell_explode(spark, d):
    return lake(spark, d).explode("supplier").select("rowid", "colid", "token", "quadrant")


@query(with_cells("SELECT token, count(*) AS n FROM cells GROUP BY 1 ORDER BY n DESC, token LIMIT 50"))
def token_frequency(spark, d):
    return profiling.token_frequencies(lake(spark, d).cells()).orderBy(F.desc("n"), "token").limit(50)


def _registry_sql() -> str:
    rows, g = [], 0
    for name, i in IDS.items():
        for j, c in enumerate(TABLES[name].split()):
            rows.append(f"SELECT {g} AS global_id, {i} AS table_id, {j} AS colid, '{c.rstrip('#')}' AS \"column\", (SELECT count(*) FROM {name}) AS n_rows")
            g += 1
    return " UNION ALL ".join(rows)


@query(_registry_sql())
def column_registry(spark, d):
    return lake(spark, d).columns()


@query(" UNION ALL ".join(f"SELECT {i} AS table_id, '{n}' AS name" for n, i in IDS.items()))
def sidecar(spark, d):
    return lake(spark, d).sidecar()


@query(f"SELECT row_number() OVER () - 1 AS rowid, {tok('n_nationkey')} AS c0, {tok('n_name')} AS c1, {tok('n_regionkey')} AS c2 FROM nation")
def table_reconstruct(spark, d):
    return lake(spark, d).table(IDS["nation"])


_SUMS = "table_id, count(*) AS n, CAST(sum(rowid) AS BIGINT) AS rows, CAST(sum(colid * length(token)) AS BIGINT) AS chars, count(DISTINCT token) AS tokens, max(md5(token)) AS most, count(*) FILTER (quadrant) AS upper"


@query(with_cells(f"SELECT 'by_row' AS copy, {_SUMS} FROM cells GROUP BY 2 UNION ALL SELECT 'by_token', {_SUMS} FROM cells GROUP BY 2"))
def index_parity(spark, d):
    """Sums and digests of each copy's cells; an error if the copies differ in any cell."""
    l = lake(spark, d)

    def one(copy: str, cells: DataFrame) -> DataFrame:
        # Digests and lengths once for each different token of a table, not for each cell.
        tokens = cells.groupBy("table_id", "token").agg(F.count("*").alias("n"), F.sum("rowid").alias("rows"), F.sum("colid").alias("cols"), F.count_if("quadrant").alias("upper"), F.bit_xor(F.xxhash64(*cells.columns)).alias("x"))
        sums = tokens.groupBy("table_id").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum(F.col("cols") * F.length("token")).cast("long").alias("chars"), F.count("*").alias("tokens"), F.max(F.md5("token")).alias("most"), F.sum("upper").alias("upper"), F.bit_xor("x").alias("x"))
        return sums.select(F.lit(copy).alias("copy"), "*")

    # One row a table and copy; all cells are compared by their hashes.
    both = one("by_row", l.by_row()).union(one("by_token", l.by_token()))
    rows = both.collect()
    cells = lambda copy: {(r.table_id, r.n, r.x) for r in rows if r.copy == copy}
    if cells("by_row") != cells("by_token"):
        raise ValueError("the copies of the index differ")
    return spark.createDataFrame(rows, both.schema).drop("x")


_SIGNATURE = r"""
ch AS (SELECT token, unnest(string_split(token, '')) AS c, generate_subscripts(string_split(token, ''), 1) - 1 AS p FROM toks WHERE token <> ''),
st AS (SELECT token, c, count(*) AS k, avg(p) AS m FROM ch GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY k, c) AS r, instr(' 0123456789abcdefghijklmnopqrstuvwxyz', c) AS a FROM st),
bits AS (SELECT token, ((a - 1) * 3 + greatest(CAST(floor(m / length(token) * 3 - 1e-6) AS INT), 0) + 111 * (length(token) % 17) // 17) % 111 AS b FROM rk WHERE r <= 5 AND a > 0
  UNION SELECT token, 111 + length(token) % 17 FROM toks),
sig AS (SELECT token, bit_or(CASE WHEN b >= 64 THEN CAST(1 AS HUGEINT) << (b - 64) ELSE 0 END) AS hi, bit_or(CASE WHEN b < 64 THEN CAST(1 AS HUGEINT) << b ELSE 0 END) AS lo FROM bits GROUP BY 1)"""


def _half(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= CAST(9223372036854775808 AS HUGEINT) THEN {x} - CAST(18446744073709551616 AS HUGEINT) ELSE {x} END AS BIGINT)"


@query(f"WITH toks AS (SELECT DISTINCT {tok('p_name')} AS token FROM part UNION SELECT {tok('n_name')} FROM nation), {_SIGNATURE} SELECT token, {_half('hi')} AS hi, {_half('lo')} AS lo FROM sig")
def token_signature(spark, d):
    t = read(spark, d, "part").select(token(F.col("p_name")).alias("token")).union(read(spark, d, "nation").select(token(F.col("n_name")).alias("token"))).distinct()
    return t.select("token", signature(F.col("token")).alias("s")).select("token", "s.hi", "s.lo")


@query(f"WITH {CELLS}, toks AS (SELECT DISTINCT token FROM cells), {_SIGNATURE} SELECT table_id, rowid, {_half('bit_or(hi)')} AS hi, {_half('bit_or(lo)')} AS lo FROM cells JOIN sig USING (token) GROUP BY 1, 2")
def rowkey_signature(spark, d):
    return lake(spark, d).rowkeys()


@query(with_cells("SELECT count(*) AS n, count(DISTINCT rowid) AS n_rows FROM cells WHERE rowid < 256"))
def rowid_slice(spark, d):
    return lake(spark, d).first_rows(256).agg(F.count("*").alias("n"), F.countDistinct("rowid").alias("n_rows"))


# -- predicates --------------------------------------------------------------------------------------


@query(with_cells(f"SELECT table_id, colid, rowid, token FROM cells WHERE token IN {KW}"))
def token_in(spark, d):
    return seekers.matching(lake(spark, d), WORDS).select("table_id", "colid", "rowid", "token")


@query(with_cells(f"SELECT table_id, count(*) AS n FROM cells WHERE token IN {URGENT} GROUP BY 1"))
def token_semi_join(spark, d):
    return seekers.matching(lake(spark, d), urgent(spark, d)).groupBy("table_id").agg(F.count("*").alias("n"))


@query(with_cells(kw_sql(KW, 10, "table_id IN (1, 5, 6)")))
def allow_pushdown(spark, d):
    return seekers.top(seekers.keyword(lake(spark, d), WORDS, IdFilter.of(allow=[1, 5, 6])), 10)


@query(with_cells(kw_sql(KW, 10, "table_id NOT IN (4, 6)")))
def deny_pushdown(spark, d):
    return seekers.top(seekers.keyword(lake(spark, d), WORDS, IdFilter.of(deny=[4, 6])), 10)


@query(with_cells(sc_sql(URGENT, 10, "table_id <> 6")))
def self_exclusion(spark, d):
    return seekers.top(seekers.single_column(lake(spark, d), urgent(spark, d), IdFilter.of(deny=[IDS["orders"]])), 10)


@query("SELECT 0 AS table_id, 0 AS score, 0 AS rank WHERE false")
def empty_query(spark, d):
    return seekers.top(seekers.keyword(lake(spark, d), ["", "nan", None]), 10)


# -- seekers -----------------------------------------------------------------------------------------


@query(with_cells(kw_sql(KW, 10)))
def keyword_search(spark, d):
    return engine(spark, d).run(N.Keyword(WORDS, k=10))


@query(with_cells(sc_sql(URGENT, 10)))
def single_column_overlap(spark, d):
    return engine(spark, d).run(N.SingleColumn(urgent(spark, d), k=10))


@query(with_cells(f"SELECT table_id, colid, count(DISTINCT token) AS score FROM cells WHERE token IN {URGENT} GROUP BY 1, 2"))
def single_column_scored(spark, d):
    return engine(spark, d).scored(N.SingleColumn(urgent(spark, d)))


@query(with_cells(mc_sql(PAIRS, 10)))
def multi_column_overlap(spark, d):
    return engine(spark, d).run(N.MultiColumn(pairs(spark, d), k=10))


@query(with_cells(mc_sql(PAIRS, 10, "table_id IN (1, 5, 8, 9)")))
def multi_column_pruned(spark, d):
    found = seekers.multi_column(lake(spark, d), pairs(spark, d), IdFilter.of(allow=[1, 5, 8, 9]), prune=True)
    return seekers.top(found, 10)


@query(with_cells(c_sql(SPEND, 10)))
def correlation_search(spark, d):
    return engine(spark, d).run(N.Correlation(spend(spark, d), k=10))


def code_table(spark, d) -> DataFrame:
    """A written code index of the lake's text columns."""
    return vectors.written_codes(lake(spark, d), tuple(TABLES))


@query()
def simhash_overlap(spark, d):
    e = engine(spark, d)
    e.codes = code_table(spark, d)
    return e.run(N.SimHash(table_id=IDS["nation"], colid=1, k=5))


UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 1e-12)) AS e FROM embeddings)"


def knn_sql(query_where: str, k: int, keep: str = "true", mine: str = "q.label") -> str:
    return f"""SELECT query_col, r, global_id, table_id, similarity FROM (SELECT q.vec_id AS query_col, v.vec_id AS global_id, v.label AS table_id, list_inner_product(q.e, v.e) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) - 1 AS r FROM {UNIT} q JOIN {UNIT} v ON v.label <> {mine} AND {keep} WHERE {query_where}) WHERE r < {k}"""


def _queries(spark, d, where: str) -> DataFrame:
    return vector_table(spark, d).where(where).select(F.col("colid").alias("query_col"), F.col("table_id").alias("query_table"), "embedding")


@query(f"SELECT query_col, r, global_id, table_id, round(similarity, 6) AS similarity FROM ({knn_sql('q.vec_id % 20 = 0', 10)})")
def cosine_topk(spark, d):
    return vectors.nearest(_queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d), 10).select("query_col", "r", "global_id", "table_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT query_col, r, global_id, table_id, round(similarity, 6) AS similarity FROM ({knn_sql('q.vec_id % 20 = 0', 10, 'v.label IN (1, 3)')})")
def filtered_topk(spark, d):
    return vectors.nearest(_queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d), 10, IdFilter.of(allow=[1, 3])).select("query_col", "r", "global_id", "table_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, round(e[1], 6) AS first, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS length FROM {UNIT}")
def l2_normalise(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", normalise(F.col("embedding")).alias("e"))
    return v.select("vec_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


def vote_sql(hits: str, k_vote: int, k: int) -> str:
    return f"""SELECT table_id, CAST(score AS BIGINT) AS score, row_number() OVER (ORDER BY score DESC, fc, fr) - 1 AS rank FROM (
  SELECT table_id, sum(n - gaps) AS score, min(query_col) AS fc, arg_min(r, query_col * 100000 + r) AS fr FROM (
    SELECT *, count(*) OVER (PARTITION BY query_col) AS n, sum(gap) OVER (PARTITION BY query_col ORDER BY r) AS gaps FROM (
      SELECT *, CAST(coalesce(abs(similarity - lag(similarity) OVER (PARTITION BY query_col ORDER BY r)) > 1e-6, false) AS INT) AS gap FROM ({hits}) WHERE r < {k_vote}))
  GROUP BY 1) ORDER BY rank LIMIT {k}"""


@query(vote_sql(knn_sql("q.label = 2", 20), 10, 5))
def semantic_union(spark, d):
    return engine(spark, d, exact_columns=1 << 40).run(N.SemanticUnion(table_id=2, k=5)).select("rank", "table_id", "score")


@query(vote_sql(knn_sql("q.label = 2", 500, "v.label IN (1, 3)"), 500, 5))
def semantic_dispatch(spark, d):
    """The filter leaves few enough columns for an exact search, whatever the index holds."""
    left = vector_table(spark, d).where("table_id in (1, 3)").count()
    e = engine(spark, d, exact_columns=left)
    return seekers.top(e.scored(N.SemanticUnion(table_id=2, k=5), IdFilter.of(allow=[1, 3])), 5, ties=("first", "table_id")).select("rank", "table_id", "score")


@query(vote_sql(knn_sql("q.vec_id = 7", 20), 10, 5))
def semantic_join(spark, d):
    own = read(spark, d, "embeddings").where("vec_id = 7").select("label").first()["label"]
    return engine(spark, d, exact_columns=1 << 40).run(N.SemanticJoin(table_id=int(own), colid=7, k=5)).select("rank", "table_id", "score")


@query(f"SELECT table_id, round(max(similarity), 6) AS score FROM ({knn_sql('q.vec_id % 20 = 0', 20)}) GROUP BY 1")
def max_pool(spark, d):
    hits = vectors.nearest(_queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d), 20).select(F.lit(0).alias("query"), "query_col", "r", "table_id", (-F.col("similarity")).alias("distance"))
    return rollup.max_pool(hits).select("table_id", F.round("score", 6).alias("score"))


@query(f"SELECT query AS query, table_id, CAST(sum(n - gaps) AS BIGINT) AS score FROM (SELECT *, count(*) OVER (PARTITION BY query_col) AS n, sum(gap) OVER (PARTITION BY query_col ORDER BY r) AS gaps FROM (SELECT *, query_col % 2 AS query, CAST(coalesce(abs(similarity - lag(similarity) OVER (PARTITION BY query_col ORDER BY r)) > 1e-6, false) AS INT) AS gap FROM ({knn_sql('q.vec_id % 20 = 0', 15)}))) GROUP BY 1, 2")
def decay_vote(spark, d):
    hits = vectors.nearest(_queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d), 15).select((F.col("query_col") % 2).alias("query"), "query_col", "r", "table_id", (-F.col("similarity")).alias("distance"))
    return rollup.decay_vote(hits).select("query", "table_id", "score")


@query()
def munkres(spark, d):
    unit = vectors.normalised(vector_table(spark, d))
    q = unit.where("table_id = 1").select(F.lit(1).alias("query"), "embedding")
    return rollup.munkres(q, unit.where("table_id <> 1").select(F.lit(1).alias("query"), "table_id"), unit.select("table_id", "embedding"), 0.1)


DIM = 64
_PLANES = vectors.hyperplanes(12, DIM, 3)
_BITS = " + ".join(f"{1 << (11 - i)} * CAST(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [{', '.join(repr(x) for x in p)}]) > 0 AS INT)" for i, p in enumerate(_PLANES))


@query(f"SELECT vec_id, {_BITS} AS code FROM embeddings")
def simhash_codes(spark, d):
    return read(spark, d, "embeddings").select("vec_id", code(F.col("embedding"), _PLANES).alias("code"))


@query()
def lsh_recall(spark, d):
    q, v = _queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d)
    return vectors.recall(vectors.lsh_nearest(q, v, 10), vectors.nearest(q, v, 10))


@query("SELECT count(*) AS n FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0")
def vector_check(spark, d):
    return vectors.bad_vectors(vector_table(spark, d)).agg(F.count("*").alias("n"))


# -- combiners ---------------------------------------------------------------------------------------

_KW3 = kw_sql(KW, 3)
_INTER = with_cells(sc_sql(NM, 5, "table_id IN (SELECT table_id FROM leg)"), f"leg AS ({_KW3})")


@query(_INTER)
def intersection_pushdown(spark, d):
    return engine(spark, d).run(N.Intersection((N.SingleColumn(NAMES, k=8), N.Keyword(WORDS, k=3)), k=5))


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY min(rank)) - 1 AS rank FROM b WHERE table_id IN (SELECT table_id FROM a) GROUP BY 1", f"a AS ({_KW3}), b AS ({sc_sql(NM, 8)})"))
def intersection_pure(spark, d):
    return engine(spark, d, pushdown=False).run(N.Intersection((N.SingleColumn(NAMES, k=8), N.Keyword(WORDS, k=3)), k=5))


@query(with_cells(kw_sql(KW, 5, "table_id NOT IN (SELECT table_id FROM leg)"), f"leg AS ({sc_sql(NM, 2)})"))
def difference_pushdown(spark, d):
    return engine(spark, d).run(N.Difference((N.Keyword(WORDS, k=2), N.SingleColumn(NAMES, k=2)), k=5))


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY rank) - 1 AS rank FROM a WHERE table_id NOT IN (SELECT table_id FROM b)", f"a AS ({kw_sql(KW, 4)}), b AS ({sc_sql(NM, 2)})"))
def difference_pure(spark, d):
    return engine(spark, d, pushdown=False).run(N.Difference((N.Keyword(WORDS, k=4), N.SingleColumn(NAMES, k=2)), k=5))


_LEGS = f"a AS ({kw_sql(KW, 4)}), b AS ({sc_sql(NM, 6)}), u AS (SELECT table_id, rank, 0 AS leg FROM a UNION ALL SELECT table_id, rank, 1 FROM b)"


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY r, leg, table_id) - 1 AS rank FROM (SELECT table_id, min(rank) AS r, arg_min(leg, rank * 10 + leg) AS leg FROM u GROUP BY 1 ORDER BY r, leg, table_id LIMIT 5)", _LEGS))
def union_ranked(spark, d):
    return engine(spark, d).run(N.Union((N.Keyword(WORDS, k=4), N.SingleColumn(NAMES, k=6)), k=5))


@query(with_cells("SELECT table_id, score, row_number() OVER (ORDER BY score DESC, table_id) - 1 AS rank FROM (SELECT table_id, count(*) AS score FROM u GROUP BY 1 ORDER BY score DESC, table_id LIMIT 5)", _LEGS))
def counter_votes(spark, d):
    return engine(spark, d).run(N.Counter((N.Keyword(WORDS, k=4), N.SingleColumn(NAMES, k=6)), k=5))


@query(with_cells("SELECT table_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, f) - 1 AS rank FROM (SELECT table_id, sum((CASE leg WHEN 0 THEN 1.0 ELSE 0.5 END) / (60.0 + rank)) AS score, min(leg * 1000 + rank) AS f FROM u GROUP BY 1)", _LEGS))
def rrf_fusion(spark, d):
    e = engine(spark, d)
    out = setops.fusion([e.run(N.Keyword(WORDS, k=4)), e.run(N.SingleColumn(NAMES, k=6))], [1.0, 0.5])
    return out.select("table_id", F.round("score", 9).alias("score"), "rank")


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY min(rank), table_id) - 1 AS rank FROM b GROUP BY 1", f"b AS ({sc_sql(NM, 8)})"))
def dedup_ranked(spark, d):
    return setops.distinct_tables(engine(spark, d).run(N.SingleColumn(NAMES, k=8)))


@query(with_cells(f"SELECT table_id, row_number() OVER (ORDER BY leg, rank) - 1 AS rank FROM (SELECT table_id, rank, 0 AS leg FROM a WHERE NOT (table_id NOT IN (1, 5, 8) AND table_id IN (6, 4)) UNION ALL SELECT table_id, min(rank), 1 FROM b WHERE table_id IN (1, 5, 8) AND table_id NOT IN (SELECT table_id FROM a) GROUP BY 1)", f"a AS ({kw_sql(KW, 3)}), b AS ({sc_sql(NM, 8)})"))
def oracle_repair(spark, d):
    e = engine(spark, d)
    one = lambda ids: setops.values(spark, ids)
    return setops.repair(e.run(N.Keyword(WORDS, k=3)), one([1, 5, 8]), e.run(N.SingleColumn(NAMES, k=8)), one([6, 4]))


@query(with_cells(kw_sql(KW, 6, "table_id IN (SELECT table_id FROM y)"), f"x AS ({sc_sql(NM, 8)}), y AS ({sc_sql(URGENT, 9, 'table_id IN (SELECT table_id FROM x)')})"))
def intersection_fixed_order(spark, d):
    legs = (N.SingleColumn(NAMES, k=8), N.SingleColumn(urgent(spark, d), k=9), N.Keyword(WORDS, k=2))
    return engine(spark, d).run(N.Intersection(legs, k=6, fixed=True))


# -- tasks -------------------------------------------------------------------------------------------


@query(with_cells(kw_sql(NM, 5)))
def task_keyword_search(spark, d):
    return engine(spark, d).run(tasks.keyword_search(NAMES, 5))


@query(with_cells(sc_sql(f"(SELECT DISTINCT {tok('s_nationkey')} FROM supplier)", 5)))
def task_single_column_join(spark, d):
    return engine(spark, d).run(tasks.single_column_join(read(spark, d, "supplier").select("s_nationkey"), 5))


_STATUS = "SELECT DISTINCT o_orderstatus AS a, o_orderpriority AS b FROM orders"


@query(with_cells(mc_sql(_STATUS, 5)))
def task_multi_column_join(spark, d):
    return engine(spark, d).run(tasks.multi_column_join(read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct(), 5))


@query(with_cells(c_sql(SIZES, 5)))
def task_correlation_search(spark, d):
    return engine(spark, d).run(tasks.correlation_search(sizes(spark, d), k=5))


def _column(table: str, c: str) -> str:
    return f"(SELECT DISTINCT {tok(c)} FROM {table} WHERE {tok(c)} <> '')"


_NLEGS = ", ".join(f"l{i} AS ({sc_sql(_column('nation', c), 50)})" for i, c in enumerate(("n_nationkey", "n_name", "n_regionkey")))
_NU = "u AS (" + " UNION ALL ".join(f"SELECT table_id, rank, {i} AS leg FROM l{i}" for i in range(3)) + ")"


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY r, leg, table_id) - 1 AS rank FROM (SELECT table_id, min(rank) AS r, arg_min(leg, rank * 10 + leg) AS leg FROM u GROUP BY 1 ORDER BY r, leg, table_id LIMIT 5)", f"{_NLEGS}, {_NU}"))
def task_union_search(spark, d):
    return engine(spark, d).run(tasks.union_search(read(spark, d, "nation"), 5))


@query(with_cells("SELECT table_id, score, row_number() OVER (ORDER BY score DESC, table_id) - 1 AS rank FROM (SELECT table_id, count(*) AS score FROM u GROUP BY 1 ORDER BY score DESC, table_id LIMIT 5)", f"{_NLEGS}, {_NU}"))
def task_union_by_votes(spark, d):
    return engine(spark, d).run(tasks.union_by_votes(read(spark, d, "nation"), 5))


@query(with_cells(mc_sql(PAIRS, 3, "table_id IN (SELECT table_id FROM leg)"), f"leg AS ({sc_sql(_column('nation', 'n_name'), 90)})"))
def task_imputation(spark, d):
    return engine(spark, d).run(tasks.imputation(pairs(spark, d), read(spark, d, "nation").select("n_name"), 3))


@query(with_cells(mc_sql(PAIRS, 2, "table_id IN (SELECT table_id FROM leg)"), f"leg AS ({sc_sql(_column('supplier', 's_nationkey'), 60)})"))
def task_augmentation(spark, d):
    return engine(spark, d).run(tasks.augmentation(pairs(spark, d), read(spark, d, "supplier").select("s_nationkey"), 2))


_D1 = f"a1 AS ({sc_sql(_column('nation', 'n_nationkey'), 6)}), a2 AS ({sc_sql(_column('nation', 'n_name'), 6, 'table_id IN (SELECT table_id FROM a1)')})"
_D2 = f"b1 AS ({sc_sql(_column('nation', 'n_regionkey'), 6)}), b2 AS ({sc_sql(_column('nation', 'n_nationkey'), 6, 'table_id IN (SELECT table_id FROM b1)')})"


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY r, leg, table_id) - 1 AS rank FROM (SELECT table_id, min(rank) AS r, arg_min(leg, rank * 10 + leg) AS leg FROM (SELECT table_id, rank, 0 AS leg FROM a2 UNION ALL SELECT table_id, rank, 1 FROM b2) GROUP BY 1 ORDER BY r, leg, table_id LIMIT 6)", f"{_D1}, {_D2}"))
def task_dependent_data(spark, d):
    return engine(spark, d).run(tasks.dependent_data(read(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_regionkey", "n_nationkey"], 6))


_PART3 = "SELECT p_size AS s, p_partkey AS t FROM part"


@query(with_cells(c_sql(SIZES, 4, "table_id NOT IN (SELECT table_id FROM leg)"), f"leg AS ({c_sql(_PART3, 40)})"))
def task_features(spark, d):
    return engine(spark, d).run(tasks.features(read(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", 4))


@query(with_cells(mc_sql(PAIRS, 4, "table_id NOT IN (SELECT table_id FROM leg)"), f"leg AS ({mc_sql(_STATUS, 8)})"))
def task_negative_examples(spark, d):
    return engine(spark, d).run(tasks.negative_examples(pairs(spark, d), read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct(), 4))


@query(with_cells(mc_sql("SELECT p_size AS a, p_brand AS b FROM part", 3, "table_id IN (SELECT table_id FROM f)"), f"g AS ({c_sql(_PART3, 30)}), f AS ({c_sql(SIZES, 3, 'table_id NOT IN (SELECT table_id FROM g)')})"))
def task_collinearity(spark, d):
    return engine(spark, d).run(tasks.collinearity(read(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", ["p_size", "p_brand"], 3))


_CX = f"{', '.join(f'l{i} AS ({sc_sql(_column("nation", c), 20)})' for i, c in enumerate(('n_nationkey', 'n_name', 'n_regionkey')))}, v AS (SELECT table_id, row_number() OVER (ORDER BY score DESC, table_id) - 1 AS rank FROM (SELECT table_id, count(*) AS score FROM (SELECT table_id FROM l0 UNION ALL SELECT table_id FROM l1 UNION ALL SELECT table_id FROM l2) GROUP BY 1 ORDER BY score DESC, table_id LIMIT 2)), s AS ({sc_sql(_column('nation', 'n_nationkey'), 2)}), c AS ({c_sql('SELECT n_name AS s, n_regionkey AS t FROM nation', 2)})"


@query(with_cells("SELECT table_id, row_number() OVER (ORDER BY r, leg, table_id) - 1 AS rank FROM (SELECT table_id, min(rank) AS r, arg_min(leg, rank * 10 + leg) AS leg FROM (SELECT table_id, rank, 0 AS leg FROM v UNION ALL SELECT table_id, rank, 1 FROM s UNION ALL SELECT table_id, rank, 2 FROM c) GROUP BY 1 ORDER BY r, leg, table_id LIMIT 8)", _CX))
def task_complex_search(spark, d):
    return engine(spark, d).run(tasks.complex_search(read(spark, d, "nation"), "n_name", "n_regionkey", 2))


@query(with_cells(sc_sql(NM, 5, "table_id IN (SELECT table_id FROM leg)"), f"leg AS ({_KW3})"))
def plan_facade(spark, d):
    p = Plan(engine(spark, d))
    p.add("names", N.SingleColumn(NAMES, k=8)).add("words", N.Keyword(WORDS, k=3)).add("both", N.Intersection, ["names", "words"])
    return p.engine.run(p.terminal.cut(5))


# -- metrics -----------------------------------------------------------------------------------------
# A run: each segment's customers by balance; the truth: customers with an urgent order of over 300,000.

_RUN = "run AS (SELECT c_mktsegment AS query, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank, c_custkey AS item FROM customer), tru AS (SELECT DISTINCT c_mktsegment AS query, c_custkey AS item FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000), j AS (SELECT run.query, rank, run.item, CAST(tru.item IS NOT NULL AS INT) AS rel FROM run LEFT JOIN tru ON tru.query = run.query AND tru.item = run.item WHERE rank < 40), n AS (SELECT query, count(*) AS n_rel FROM tru GROUP BY 1)"


def run_and_truth(spark, d) -> tuple[DataFrame, DataFrame]:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    run = c.select(F.col("c_mktsegment").alias("query"), (F.row_number().over(w) - 1).alias("rank"), F.col("c_custkey").alias("item")).where("rank < 40")
    big = o.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000")
    return run, c.join(big, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("query"), F.col("c_custkey").alias("item")).distinct()


_DEPTHS = f"""WITH {_RUN}, k AS (SELECT unnest([1, 5, 10, 50]) AS k),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS hits FROM j),
m AS (SELECT n.query, k.k, n.n_rel, count(h.rank) FILTER (h.rank < k.k) AS found, coalesce(sum(rel) FILTER (h.rank < k.k), 0) AS hits,
  coalesce(sum(rel / log2(rank + 2)) FILTER (h.rank < k.k), 0) AS gain, coalesce(sum(rel * hits / (rank + 1)) FILTER (h.rank < k.k), 0) AS prec,
  coalesce(sum(hits / (rank + 1)) FILTER (h.rank < k.k), 0) AS mean, min(CASE WHEN rel = 1 AND rank < k.k THEN rank + 1 END) AS fh
  FROM n CROSS JOIN k LEFT JOIN h ON h.query = n.query GROUP BY ALL)
SELECT query, k, round(hits / k, 6) AS precision, round(hits / n_rel, 6) AS recall, round(gain / list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
  round(prec / least(n_rel, k), 6) AS ap, round((mean + coalesce(list_sum(list_transform(range(found + 1, k + 1), lambda i: hits / i)), 0)) / k, 6) AS mean_precision,
  round(CASE WHEN found > 0 THEN hits / found ELSE 0 END, 6) AS precision_found, round(coalesce(1 / fh, 0), 6) AS reciprocal_rank, CAST(hits > 0 AS DOUBLE) AS hit,
  round(CASE WHEN hits > 0 THEN 2 * (hits / k) * (hits / n_rel) / (hits / k + hits / n_rel) ELSE 0 END, 6) AS f1 FROM m"""


@query(_DEPTHS)
def metrics_at_depths(spark, d):
    out = metrics.at_depths(*run_and_truth(spark, d), ks=[1, 5, 10, 50])
    return out.select("query", "k", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("query", "k")])


@query(f"WITH {_RUN}, h AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS hits FROM j) SELECT n.query, round(coalesce(sum(rel * hits / (rank + 1)), 0) / any_value(n_rel), 6) AS ap FROM n LEFT JOIN h ON h.query = n.query GROUP BY 1")
def average_precision(spark, d):
    return metrics.average_precision(*run_and_truth(spark, d)).select("query", F.round("ap", 6).alias("ap"))


@query(f"WITH {_RUN}, q AS (SELECT DISTINCT query FROM run), c AS (SELECT coalesce(n_rel, 0) AS n, row_number() OVER (ORDER BY coalesce(n_rel, 0)) AS i, count(*) OVER () AS t FROM q LEFT JOIN n USING (query)) SELECT round(avg(n), 6) AS mean, CAST(min(n) FILTER (i >= ceil(0.5 * t)) AS DOUBLE) AS p50, CAST(min(n) FILTER (i >= ceil(0.9 * t)) AS DOUBLE) AS p90, CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max, count(*) AS n_queries, count(*) FILTER (n > 0) AS n_queries_with_gt FROM c")
def truth_density(spark, d):
    run, truth = run_and_truth(spark, d)
    return metrics.truth_density(truth, run).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_RUN}, k AS (SELECT unnest([1, 5, 10, 50]) AS k) SELECT k, round(avg(least(n_rel, k) / k), 6) AS precision_ceiling, round(avg(least(n_rel, k) / n_rel), 6) AS recall_ceiling FROM n, k GROUP BY 1")
def ceilings(spark, d):
    return metrics.ceilings(run_and_truth(spark, d)[1], [1, 5, 10, 50]).select("k", F.round("precision_ceiling", 6).alias("precision_ceiling"), F.round("recall_ceiling", 6).alias("recall_ceiling"))


@query(f"""WITH {_RUN}, a AS (SELECT query, rank, item FROM j WHERE rank < 10), b AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank) - 1 AS rank, item FROM j WHERE rank % 2 = 0 AND rank < 24),
f AS (SELECT coalesce(a.query, b.query) AS query, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b ON a.query = b.query AND a.item = b.item),
s AS (SELECT query, count(ra) AS na, count(rb) AS nb, count(ra + rb) AS n FROM f GROUP BY 1),
e AS (SELECT s.query, any_value(na) AS na, any_value(nb) AS nb, any_value(n) AS n, sum(pow(0.9, x.d) / (x.d + 1) * (SELECT count(*) FROM f WHERE f.query = s.query AND greatest(ra, rb) <= x.d AND ra IS NOT NULL AND rb IS NOT NULL)) AS t FROM s, range(0, 12) x(d) GROUP BY 1)
SELECT query, round(n / nb, 6) AS retention, na - n AS additions, na <> n OR nb <> n AS changed, round(1 - n / (na + nb - n), 6) AS distance, round(t * (1 - 0.9) / (1 - pow(0.9, 12)), 6) AS rbo FROM e""")
def compared_rankings(spark, d):
    run, _ = run_and_truth(spark, d)
    w = Window.partitionBy("query").orderBy("rank")
    other = run.where("rank % 2 = 0 and rank < 24").withColumn("rank", F.row_number().over(w) - 1)
    out = metrics.compared(run.where("rank < 10"), other)
    return out.select("query", F.round("retention", 6).alias("retention"), "additions", "changed", F.round("distance", 6).alias("distance"), F.round("rbo", 6).alias("rbo"))


_REG = "reg AS (SELECT row_number() OVER (ORDER BY p_partkey) AS row_idx, p_brand AS query_table, p_partkey AS candidate_table, p_size % 6 AS n_inter, (p_size % 6) / 5.0 AS cont_q2x, (p_size % 4) / 8.0 AS cont_x2q, p_size % 3 = 0 AS numeric_q FROM part WHERE p_size % 7 <> 0), prs AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS variant, p_brand AS query_table, p_partkey AS candidate_table, p_partkey % 13 - 1 AS rank FROM part), m AS (SELECT prs.*, n_inter, cont_q2x, cont_x2q, numeric_q FROM prs LEFT JOIN reg USING (query_table, candidate_table))"


def labelled_pairs(spark, d) -> DataFrame:
    p = read(spark, d, "part")
    reg = p.where("p_size % 7 <> 0").select(F.col("p_partkey").alias("row_idx"), F.col("p_brand").alias("query_table"), F.col("p_partkey").alias("candidate_table"), (F.col("p_size") % 6).alias("n_inter"), ((F.col("p_size") % 6) / 5.0).alias("cont_q2x"), ((F.col("p_size") % 4) / 8.0).alias("cont_x2q"), (F.col("p_size") % 3 == 0).alias("numeric_q"), F.lit("ok").alias("status"))
    prs = p.select(F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("variant"), F.col("p_brand").alias("query_table"), F.col("p_partkey").alias("candidate_table"), (F.col("p_partkey") % 13 - 1).alias("rank"))
    return metrics.labelled(prs, reg, ["query_table", "candidate_table"])


@query(f"WITH {_REG} SELECT variant, CASE WHEN cont_q2x <= 0 THEN '0' WHEN cont_q2x <= 0.1 THEN '(0,0.1]' WHEN cont_q2x <= 0.3 THEN '(0.1,0.3]' WHEN cont_q2x <= 0.5 THEN '(0.3,0.5]' WHEN cont_q2x <= 1 THEN '(0.5,1]' END AS bucket, round(avg(CAST(rank BETWEEN 0 AND 0 AS INT)), 3) AS hit_1, round(avg(CAST(rank BETWEEN 0 AND 4 AS INT)), 3) AS hit_5, round(avg(CAST(rank BETWEEN 0 AND 9 AS INT)), 3) AS hit_10, count(*) AS n FROM m WHERE n_inter IS NOT NULL AND NOT numeric_q GROUP BY 1, 2")
def regime_recall(spark, d):
    return metrics.regime_recall(labelled_pairs(spark, d), text_only=True)


@query(f"WITH {_REG}, c AS (SELECT *, CASE WHEN rank < 0 THEN -1 ELSE rank - (SELECT count(*) FROM m o WHERE o.variant = m.variant AND o.query_table = m.query_table AND o.n_inter > 0 AND o.rank >= 0 AND o.rank < m.rank) END AS cond FROM m WHERE n_inter IS NOT NULL) SELECT variant, count(*) AS n_semantic, round(avg(CAST(rank BETWEEN 0 AND 0 AS INT)), 4) AS raw_1, round(avg(CAST(rank BETWEEN 0 AND 4 AS INT)), 4) AS raw_5, round(avg(CAST(rank BETWEEN 0 AND 9 AS INT)), 4) AS raw_10, round(avg(CAST(cond BETWEEN 0 AND 0 AS INT)), 4) AS cond_1, round(avg(CAST(cond BETWEEN 0 AND 4 AS INT)), 4) AS cond_5, round(avg(CAST(cond BETWEEN 0 AND 9 AS INT)), 4) AS cond_10 FROM c WHERE n_inter = 0 GROUP BY 1")
def condensed_recall(spark, d):
    return metrics.condensed_recall(labelled_pairs(spark, d))


@query(f"""WITH {_RUN}, f AS (SELECT query, item, rank - 1 AS rank, rel FROM j WHERE rank BETWEEN 1 AND 10), h AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS hits FROM f)
SELECT n.query, any_value(n_rel) AS n_relevant, count(h.rank) AS n_retrieved, CAST(coalesce(sum(rel), 0) AS BIGINT) AS hits, round(coalesce(sum(rel), 0) / 10, 6) AS precision, round(coalesce(sum(rel), 0) / any_value(n_rel), 6) AS recall,
  round(coalesce(sum(rel * hits / (rank + 1)), 0) / any_value(n_rel), 6) AS ap, round(coalesce(1 / min(CASE WHEN rel = 1 THEN rank + 1 END), 0), 6) AS reciprocal_rank, CAST(coalesce(sum(rel), 0) > 0 AS DOUBLE) AS hit
FROM n LEFT JOIN h ON h.query = n.query GROUP BY 1""")
def self_drop_scores(spark, d):
    """Each query's own item is the first of its run here."""
    run, truth = run_and_truth(spark, d)
    out = adapters.scores(adapters.without_self(run, run.where("rank = 0"), 10), truth, 10)
    return out.select("query", "n_relevant", "n_retrieved", F.col("hits").cast("long").alias("hits"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ap", "reciprocal_rank", "hit")])


@query("SELECT p_brand AS brand, p_type AS kind FROM part UNION ALL SELECT p_brand, p_type FROM part")
def augment_union(spark, d):
    part = read(spark, d, "part")
    return augment.union_by_overlap(part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")), part)


@query("""WITH q AS (SELECT DISTINCT o_orderpriority AS priority FROM orders), s AS (SELECT o_orderpriority AS p, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT o_orderpriority AS p, o_custkey AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT priority, (SELECT v FROM s WHERE p = priority ORDER BY n DESC, v LIMIT 1) AS o_orderstatus_join, (SELECT v FROM c WHERE p = priority ORDER BY n DESC, v LIMIT 1) AS o_custkey_join FROM q""")
def augment_modes(spark, d):
    orders = read(spark, d, "orders")
    return augment.join_modes(orders.select(F.col("o_orderpriority").alias("priority")).distinct(), "priority", orders.select("o_orderstatus", "o_orderpriority", "o_custkey"))


@query("SELECT p_brand, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1")
def augment_means(spark, d):
    part = read(spark, d, "part")
    out = augment.join_means(part.select("p_brand").distinct(), "p_brand", part.select("p_type", "p_brand", "p_size", "p_retailprice"))
    return out.select("p_brand", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query("""WITH reg AS (SELECT p_brand AS query_table, p_size % 3 AS query_column, p_type AS candidate_table, p_size % 6 AS n_inter, (p_size % 6) / 5.0 AS cont_q2x, p_partkey AS row_idx, p_size % 3 = 0 AS numeric_q FROM part WHERE p_size % 7 <> 0),
b AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY query_table, query_column, candidate_table ORDER BY cont_q2x DESC, n_inter DESC, row_idx) = 1), prs AS (SELECT p_brand AS query_table, p_size % 3 AS query_column, p_type AS candidate_table, p_partkey % 13 - 1 AS rank FROM part)
SELECT query_table, query_column, candidate_table, rank, n_inter, round(cont_q2x, 6) AS cont_q2x FROM prs LEFT JOIN b USING (query_table, query_column, candidate_table)""")
def table_level_labels(spark, d):
    p = read(spark, d, "part").withColumn("query_column", F.col("p_size") % 3)
    keys = [F.col("p_brand").alias("query_table"), "query_column", F.col("p_type").alias("candidate_table")]
    reg = p.where("p_size % 7 <> 0").select(*keys, (F.col("p_size") % 6).alias("n_inter"), ((F.col("p_size") % 6) / 5.0).alias("cont_q2x"), F.lit(0.0).alias("cont_x2q"), F.col("p_partkey").alias("row_idx"), (F.col("p_size") % 3 == 0).alias("numeric_q"), F.lit("ok").alias("status"))
    out = metrics.labelled_by_table(p.select(*keys, (F.col("p_partkey") % 13 - 1).alias("rank")), reg)
    return out.select("query_table", "query_column", "candidate_table", "rank", "n_inter", F.round("cont_q2x", 6).alias("cont_q2x"))


@query(f"WITH {_RUN} SELECT t.query, t.item, coalesce(j.rank, -1) AS rank FROM tru t LEFT JOIN j ON j.query = t.query AND j.item = t.item")
def hit_pairs(spark, d):
    run, truth = run_and_truth(spark, d)
    return metrics.hit_pairs(truth, run)


_SWEEP = f"""WITH {_RUN}, r2 AS (SELECT c_mktsegment AS query, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) - 1 AS rank, c_custkey AS item FROM customer), w AS (SELECT i / 10.0 AS weight FROM range(0, 11) x(i)),
a AS (SELECT query, rank, item, 0 AS leg FROM run WHERE rank < 40 UNION ALL SELECT query, rank, item, 1 FROM r2 WHERE rank < 40),
s AS (SELECT weight, query, item, sum(CASE leg WHEN 1 THEN weight ELSE 1 - weight END / (60 + rank)) AS score, min(leg * 1000 + rank) AS f FROM a, w GROUP BY 1, 2, 3 HAVING sum(CASE leg WHEN 1 THEN weight ELSE 1 - weight END / (60 + rank)) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY weight, query ORDER BY score DESC, f, item) AS r FROM s),
h AS (SELECT weight, t.query, count(*) AS h FROM t JOIN tru ON tru.query = t.query AND tru.item = t.item WHERE r <= 10 GROUP BY 1, 2)
SELECT weight, round(avg(coalesce(h, 0) / n_rel), 6) AS recall FROM n CROSS JOIN w LEFT JOIN h USING (weight, query) GROUP BY 1"""


@query(_SWEEP)
def fusion_weight_sweep(spark, d):
    run, truth = run_and_truth(spark, d)
    c = read(spark, d, "customer")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_custkey"))
    other = c.select(F.col("c_mktsegment").alias("query"), (F.row_number().over(w) - 1).alias("rank"), F.col("c_custkey").alias("item")).where("rank < 40")
    return experiments.fusion_sweep(run, other, truth, 10).withColumn("recall", F.round("recall", 6))


@query()
def depth_grid(spark, d):
    hits = vectors.nearest(_queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d), 40).select(F.col("query_col").alias("query"), "query_col", "r", "table_id", (-F.col("similarity")).alias("distance"))
    truth = vector_table(spark, d).where("global_id % 20 = 0").select(F.col("colid").alias("query"), ((F.col("table_id") + 1) % 5).alias("item"))
    return experiments.depth_grid(hits, truth, [10, 20, 40], [5, 10, 20], 3)


@query()
def ann_frontier(spark, d):
    return experiments.ann_frontier(_queries(spark, d, "global_id % 20 = 0"), vector_table(spark, d), 10, [(5, 128), (20, 512)]).drop("seconds")


@query()
def encoded_columns(spark, d):
    e = Engine(lake(spark, d), encoders.vector_index(lake(spark, d), names=list(TABLES)))
    q = encoders.query_vectors(spark, read(spark, d, "nation").select("n_name"))
    return e.run(N.SemanticUnion(vectors=q, k=3)).select("rank", "table_id", "score")


# -- profiling -------------------------------------------------------------------------------------


@query(with_cells("""SELECT table_id, colid, round(nf, 6) AS numeric_fraction, round(r, 6) AS cardinality_ratio, round(l, 6) AS avg_char_len, CASE WHEN nf >= 0.8 AND r >= 0.5 THEN 'id' WHEN nf >= 0.8 THEN 'numeric' WHEN r < 0.2 AND l < 30 THEN 'categorical' ELSE 'text' END AS col_type
FROM (SELECT table_id, colid, avg(CAST(TRY_CAST(token AS DOUBLE) IS NOT NULL AS INT)) AS nf, count(DISTINCT token) / count(*) AS r, avg(length(token)) AS l FROM cells WHERE token <> '' GROUP BY 1, 2)"""))
def column_types(spark, d):
    out = profiling.column_types(lake(spark, d).by_row())
    return out.select("table_id", "colid", *[F.round(c, 6).alias(c) for c in ("numeric_fraction", "cardinality_ratio", "avg_char_len")], "col_type")


_FD = """smp AS (SELECT * FROM cells WHERE rowid < 5000), cs AS (SELECT table_id, colid, count(*) AS n, count(DISTINCT token) AS d, avg(CASE WHEN rowid < 200 THEN CAST(regexp_matches(token, '\\D') AS INT) END) >= 0.5 AS txt FROM smp GROUP BY 1, 2),
ks AS (SELECT * FROM cs WHERE d >= 10 AND d / n >= 0.9),
fd AS (SELECT table_id, key, value, sum(top) / sum(n) AS confidence FROM (SELECT table_id, key, value, k, max(c) AS top, sum(c) AS n FROM (SELECT a.table_id, a.colid AS key, b.colid AS value, a.token AS k, b.token AS v, count(*) AS c FROM smp a JOIN ks ON ks.table_id = a.table_id AND ks.colid = a.colid JOIN smp b ON b.table_id = a.table_id AND b.rowid = a.rowid AND b.colid <> a.colid GROUP BY ALL) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""".replace("\\\\", "\\")


@query(with_cells("SELECT table_id, key, value, round(confidence, 6) AS confidence FROM fd", _FD))
def fd_confidence(spark, d):
    return profiling.dependencies(lake(spark, d).first_rows(profiling.SAMPLE_ROWS)).withColumn("confidence", F.round("confidence", 6))


@query(with_cells("SELECT table_id, key, value, round(confidence, 6) AS confidence FROM (SELECT fd.*, row_number() OVER (PARTITION BY fd.table_id ORDER BY a.txt DESC, a.d / a.n DESC, key, round(confidence, 3) DESC, b.txt DESC, b.d DESC, value) AS r FROM fd JOIN ks a ON a.table_id = fd.table_id AND a.colid = key JOIN cs b ON b.table_id = fd.table_id AND b.colid = value WHERE confidence >= 0.95 AND b.d >= 2) WHERE r = 1", _FD))
def key_value_pairs(spark, d):
    return profiling.key_value_pairs(lake(spark, d).first_rows(profiling.SAMPLE_ROWS)).withColumn("confidence", F.round("confidence", 6))


_WANT = [(6, 1, 1, 0), (4, 0, 6, 0), (1, 2, 5, 0), (9, 2, 5, 0), (5, 2, 8, 0), (5, 9, 8, 0), (77, 0, 1, 0), (1, 4, 7, 2)]
_SETS = f"sets AS (SELECT DISTINCT table_id, colid, token FROM cells WHERE token <> ''), sz AS (SELECT table_id, colid, count(*) AS n FROM sets GROUP BY 1, 2), w AS (SELECT * FROM (VALUES {', '.join(map(str, _WANT))}) x(qt, qc, ct, cc))"


@query(with_cells("""SELECT qt AS query_table, qc AS query_col, ct AS candidate_table, cc AS candidate_col, nq AS n_query, nc AS n_cand, i AS n_inter, round(CASE WHEN nq > 0 THEN i / nq ELSE 0 END, 6) AS cont_q2x, round(CASE WHEN nc > 0 THEN i / nc ELSE 0 END, 6) AS cont_x2q, round(CASE WHEN nq + nc - i > 0 THEN i / (nq + nc - i) ELSE 0 END, 6) AS jaccard, status FROM (
SELECT w.*, coalesce(a.n, 0) AS nq, coalesce(b.n, 0) AS nc, (SELECT count(*) FROM sets x JOIN sets y USING (token) WHERE x.table_id = qt AND x.colid = qc AND y.table_id = ct AND y.colid = cc) AS i,
CASE WHEN qt NOT IN (SELECT table_id FROM cells) OR ct NOT IN (SELECT table_id FROM cells) THEN 'missing_table' WHEN a.n IS NULL OR b.n IS NULL THEN 'missing_column' ELSE 'ok' END AS status
FROM w LEFT JOIN sz a ON a.table_id = qt AND a.colid = qc LEFT JOIN sz b ON b.table_id = ct AND b.colid = cc)""", _SETS))
def overlap_pairs(spark, d):
    want = spark.createDataFrame(_WANT, "query_table int, query_col int, candidate_table int, candidate_col int")
    out = profiling.overlap_pairs(lake(spark, d).by_row(), want)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(with_cells("""SELECT query_table, candidate_table, query_col, candidate_col, n_inter, round(containment, 6) AS containment FROM (SELECT *, row_number() OVER (PARTITION BY query_table, candidate_table ORDER BY containment DESC, n_inter DESC, query_col, candidate_col) AS r FROM (
SELECT x.table_id AS query_table, y.table_id AS candidate_table, x.colid AS query_col, y.colid AS candidate_col, count(*) AS n_inter, greatest(count(*) / any_value(a.n), count(*) / any_value(b.n)) AS containment FROM sets x JOIN sets y USING (token) JOIN sz a ON a.table_id = x.table_id AND a.colid = x.colid JOIN sz b ON b.table_id = y.table_id AND b.colid = y.colid
WHERE (x.table_id, y.table_id) IN ((1, 9), (6, 4), (5, 8)) GROUP BY 1, 2, 3, 4)) WHERE r = 1""", _SETS))
def union_best_pair(spark, d):
    t = spark.createDataFrame([(1, 9), (6, 4), (5, 8)], "query_table int, candidate_table int")
    return profiling.best_union_pair(lake(spark, d).by_row(), t).withColumn("containment", F.round("containment", 6))


@query(with_cells("SELECT table_id, colid, round(digits, 6) AS digits, digits > 0.5 AS \"numeric\" FROM (SELECT table_id, colid, sum(length(regexp_replace(token, '[^0-9]', '', 'g'))) / sum(length(token)) AS digits FROM (SELECT *, row_number() OVER (PARTITION BY table_id, colid ORDER BY n DESC, token) AS r FROM (SELECT table_id, colid, token, count(*) AS n FROM cells WHERE token <> '' GROUP BY 1, 2, 3)) WHERE r <= 10 GROUP BY 1, 2)"))
def numeric_column_rule(spark, d):
    return profiling.digit_columns(lake(spark, d).by_row()).withColumn("digits", F.round("digits", 6))


@query(with_cells("SELECT token, count(DISTINCT table_id) AS df FROM cells WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY 1 ORDER BY df DESC, token LIMIT 20"))
def doc_frequency_keywords(spark, d):
    return profiling.keywords(lake(spark, d).cells(), 20)


@query(with_cells("SELECT token, count(DISTINCT table_id) AS df FROM cells WHERE table_id IN (4, 6, 7) AND length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN (SELECT token FROM cells WHERE table_id IN (1, 9)) GROUP BY 1 ORDER BY df DESC, token LIMIT 20"))
def discriminative_tokens(spark, d):
    l = lake(spark, d)
    return profiling.discriminative_cells(l.cells([4, 6, 7]), l.cells([1, 9]), 20)


@query(with_cells("SELECT table_id, colid, cardinality, stratum, turn FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '0', table_id, colid)), table_id, colid) AS turn FROM (SELECT table_id, colid, count(DISTINCT token) AS cardinality, CASE WHEN count(DISTINCT token) < 10 THEN 0 WHEN count(DISTINCT token) < 100 THEN 1 WHEN count(DISTINCT token) < 1000 THEN 2 WHEN count(DISTINCT token) < 10000 THEN 3 ELSE 4 END AS stratum FROM cells GROUP BY 1, 2)) ORDER BY turn, stratum LIMIT 15"))
def stratified_sample(spark, d):
    return profiling.stratified(profiling.cardinalities(lake(spark, d).cells()), 15)


@query("""WITH a AS (SELECT o_custkey AS key, avg(o_totalprice) AS a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS key, avg(c_acctbal) AS b FROM customer GROUP BY 1), j AS (SELECT a, b FROM a JOIN b USING (key)),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def spearman_truth(spark, d):
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"))
    b = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return profiling.spearman(a, b).withColumn("rho", F.round("rho", 6))


@query(with_cells("SELECT table_id FROM (SELECT DISTINCT a.table_id, a.token AS a, b.token AS b FROM cells a JOIN cells b ON a.table_id = b.table_id AND a.rowid = b.rowid AND a.colid = 0 AND b.colid = 1) p GROUP BY 1 HAVING count(*) FILTER ((a, b) IN (SELECT DISTINCT CAST(r_regionkey AS VARCHAR), lower(r_name) FROM region)) < (SELECT count(*) FROM region)"))
def not_supersets(spark, d):
    cells = lake(spark, d).by_row()
    rows = profiling.row_pairs(cells, 0, 1)
    return profiling.not_supersets(rows.where(F.col("table_id") == IDS["region"]), rows)


@query(with_cells(f"SELECT table_id, rowid, token FROM cells WHERE colid = 0 AND token <> '' AND table_id <> 6 AND token NOT IN {URGENT} ORDER BY md5(concat_ws('|', '0', table_id, rowid)), table_id, rowid LIMIT 12"))
def negative_samples(spark, d):
    return profiling.negative_samples(lake(spark, d).by_row(), tokens_of(spark, urgent(spark, d)), IDS["orders"], 12)


# -- imputation and costs ---------------------------------------------------------------------------

_EX = f"ex AS (SELECT {tok('n_nationkey')} AS k, {tok('n_name')} AS v FROM nation WHERE n_nationkey < 5)"
_ALIGN = f"{_EX}, al AS (SELECT table_id, kc, vc, score FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, kc, vc) AS r FROM (SELECT table_id, kc, vc, count(*) AS score FROM (SELECT DISTINCT a.table_id, a.colid AS kc, b.colid AS vc, a.token AS k, b.token AS v FROM cells a JOIN cells b ON b.table_id = a.table_id AND b.rowid = a.rowid AND b.colid <> a.colid JOIN ex ON ex.k = a.token AND ex.v = b.token) GROUP BY 1, 2, 3)) WHERE r = 1)"


def _examples(spark, d) -> DataFrame:
    return read(spark, d, "nation").where("n_nationkey < 5").select(token(F.col("n_nationkey")).alias("k"), token(F.col("n_name")).alias("v"))


def _masked(spark, d) -> DataFrame:
    return read(spark, d, "nation").where("n_nationkey >= 5").select(token(F.col("n_nationkey")).alias("k"), token(F.col("n_name")).alias("v"))


@query(with_cells("SELECT * FROM al", _ALIGN))
def align_columns(spark, d):
    return imputation.align(lake(spark, d).by_row(), _examples(spark, d), lake(spark, d).sidecar())


_VOTE = f"{_ALIGN}, mp AS (SELECT a.table_id, a.token AS k, arg_min(b.token, a.rowid) AS v FROM al JOIN cells a ON a.table_id = al.table_id AND a.colid = kc JOIN cells b ON b.table_id = al.table_id AND b.colid = vc AND b.rowid = a.rowid WHERE a.token <> '' AND b.token <> '' GROUP BY 1, 2), vt AS (SELECT k, v, count(*) AS votes, min(table_id) AS best FROM mp WHERE k IN (SELECT {tok('n_nationkey')} FROM nation WHERE n_nationkey >= 5) GROUP BY 1, 2), pr AS (SELECT k, v, votes FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY votes DESC, best, v) AS r FROM vt) WHERE r = 1)"


@query(with_cells("SELECT * FROM pr", _VOTE))
def impute_majority(spark, d):
    ranked = lake(spark, d).sidecar().select("table_id", F.col("table_id").alias("rank"))
    return imputation.vote(lake(spark, d).by_row(), ranked, _examples(spark, d), _masked(spark, d))


@query(with_cells(f"SELECT count(*) AS n_keys, count(pr.v) AS n_covered, count(*) FILTER (pr.v = t.v) AS n_correct, round(count(pr.v) / count(*), 6) AS coverage, round(count(*) FILTER (pr.v = t.v) / count(pr.v), 6) AS accuracy FROM (SELECT {tok('n_nationkey')} AS k, {tok('n_name')} AS v FROM nation WHERE n_nationkey >= 5) t LEFT JOIN pr USING (k)", _VOTE))
def impute_score(spark, d):
    out = imputation.score(impute_majority(spark, d), _masked(spark, d))
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("accuracy", F.round("accuracy", 6))


_FREQ = "fr AS (SELECT token, count(*) AS n FROM cells GROUP BY 1)"


@query(with_cells(f"SELECT CAST(sum(f) AS BIGINT) AS scan_rows, CAST(min(f) AS BIGINT) AS est_rows, round(product(f), 3) AS worst_case FROM (SELECT col, coalesce(sum(n), 0) AS f FROM (SELECT DISTINCT 0 AS col, {tok('n_nationkey')} AS token FROM nation UNION SELECT DISTINCT 1, {tok('n_name')} FROM nation) LEFT JOIN fr USING (token) GROUP BY 1)", _FREQ))
def mc_cost_score(spark, d):
    n = read(spark, d, "nation")
    ex = n.select(F.lit(0).alias("col"), token(F.col("n_nationkey")).alias("token")).union(n.select(F.lit(1), token(F.col("n_name"))))
    out = imputation.scan_cost(ex, profiling.token_frequencies(lake(spark, d).cells()))
    return out.withColumn("worst_case", F.round("worst_case", 3))


@query(with_cells(f"SELECT 0 AS query, (SELECT count(*) FROM (SELECT DISTINCT n_nationkey, n_name FROM nation)) AS rows, round(exp(avg(ln(f))), 4) AS frequency, count(*) AS columns FROM (SELECT col, coalesce(sum(n), 0) AS f FROM (SELECT DISTINCT 0 AS col, {tok('n_nationkey')} AS token FROM nation UNION SELECT DISTINCT 1, {tok('n_name')} FROM nation) LEFT JOIN fr USING (token) GROUP BY 1)", _FREQ))
def feature_geomean(spark, d):
    n = read(spark, d, "nation")
    cols = n.select(F.lit(0).alias("query"), F.col("n_nationkey").alias("qid"), F.explode(F.array(F.struct(F.lit(0).alias("col"), token(F.col("n_nationkey")).alias("token")), F.struct(F.lit(1).alias("col"), token(F.col("n_name")).alias("token")))).alias("x")).select("query", "qid", "x.*")
    out = costs.features(cols, profiling.token_frequencies(lake(spark, d).cells()))
    return out.withColumn("frequency", F.round("frequency", 4))


_SAMPLES = "SELECT event_type AS kind, value AS seconds, CASE WHEN user_id % 5 = 0 THEN 'censored' WHEN user_id % 17 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM events WHERE value IS NOT NULL"


def _samples(spark, d) -> DataFrame:
    out = F.when(F.col("user_id") % 5 == 0, "censored").when(F.col("user_id") % 17 == 0, "error").otherwise("ok")
    return read(spark, d, "events").where("value is not null").select(F.col("event_type").alias("kind"), F.col("value").alias("seconds"), out.alias("outcome"))


@query(f"""WITH s AS (SELECT * FROM ({_SAMPLES}) WHERE outcome <> 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY outcome = 'censored', seconds) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM s),
g AS (SELECT kind, any_value(n) AS n, {', '.join(f"max(CASE WHEN i = floor({q} * (n - 1)) AND outcome = 'ok' THEN seconds END) AS lo{i}, max(CASE WHEN i = ceil({q} * (n - 1)) AND outcome = 'ok' THEN seconds END) AS hi{i}" for i, q in enumerate((0.5, 0.95)))} FROM r GROUP BY 1)
SELECT kind, n, round(lo0 + (0.5 * (n - 1) - floor(0.5 * (n - 1))) * (hi0 - lo0), 6) AS "q0.5", round(lo1 + (0.95 * (n - 1) - floor(0.95 * (n - 1))) * (hi1 - lo1), 6) AS "q0.95" FROM g""")
def censored_median(spark, d):
    out = costs.censored_quantiles(_samples(spark, d), (0.5, 0.95))
    return out.select("kind", "n", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in ("q0.5", "q0.95")])


@query("WITH m AS (SELECT o_orderpriority AS kind, median(o_totalprice) * (1 + length(o_orderpriority)) AS median FROM orders GROUP BY o_orderpriority) SELECT kind, greatest(1, CAST(round_even(median / (SELECT min(median) FROM m), 0) AS INT)) AS cost FROM m")
def cost_integers(spark, d):
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg((F.median("o_totalprice")).alias("median")).withColumn("median", F.col("median") * (1 + F.length("kind")))
    return costs.cost_integers(m)


_FIT = "SELECT l_linenumber AS n_cols, l_quantity AS k_coarse, l_extendedprice AS ms FROM lineitem"


@query(f"SELECT round(regr_intercept(ms / greatest(n_cols, 1), k_coarse), 4) AS beta, round(regr_slope(ms / greatest(n_cols, 1), k_coarse), 4) AS alpha FROM ({_FIT})")
def exact_line_fit(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("n_cols"), F.col("l_quantity").alias("k_coarse"), F.col("l_extendedprice").alias("ms"))
    return costs.fit_line(p, "k_coarse", "ms", "n_cols").select(F.round("beta", 4).alias("beta"), F.round("alpha", 4).alias("alpha"))


@query(f"SELECT round(regr_intercept(ms, k_coarse), 3) AS a, round(regr_slope(ms, k_coarse), 3) AS c FROM ({_FIT})")
def unfiltered_cost_fit(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("n_cols"), F.col("l_quantity").alias("k_coarse"), F.col("l_extendedprice").alias("ms"))
    c = costs.fit_unfiltered(p, "join")
    return spark.createDataFrame([(round(c["a"], 3), round(c["c"], 3))], "a double, c double")


@query("SELECT coalesce(max(CASE WHEN p_retailprice <= 1200 THEN p_size END), 0) AS crossover, round(avg(least(p_retailprice, 1200)), 4) AS best_mean FROM part")
def crossover(spark, d):
    return costs.crossover(read(spark, d, "part").select(F.col("p_size").alias("columns"), F.col("p_retailprice").alias("seconds")), 1200).withColumn("best_mean", F.round("best_mean", 4))


@query("SELECT round(greatest(0, 1 - (sum(CASE WHEN n > 1 THEN v * n END) / sum(CASE WHEN n > 1 THEN n - 1 END)) / (SELECT var_pop(l_extendedprice) FROM lineitem)), 6) AS ceiling_r2, count(*) FILTER (n > 1) AS replicated FROM (SELECT l_linenumber, l_quantity, count(*) AS n, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)")
def noise_ceiling(spark, d):
    p = read(spark, d, "lineitem").select("l_linenumber", "l_quantity", F.col("l_extendedprice").alias("ms"))
    return costs.noise_ceiling(p, ["l_linenumber", "l_quantity"])


@query("SELECT count(*) AS n, round(avg(CAST(pick = best AS DOUBLE)), 6) AS \"right\", round(avg(pick - best), 4) AS regret, round(avg((l_extendedprice + l_quantity * 1000) / 2 - pick), 4) AS gain_over_coin FROM (SELECT *, CASE WHEN l_linenumber <= l_suppkey % 7 THEN l_extendedprice ELSE l_quantity * 1000 END AS pick, least(l_extendedprice, l_quantity * 1000) AS best FROM lineitem)")
def tiebreak_regret(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("cost_a"), (F.col("l_suppkey") % 7).alias("cost_b"), F.col("l_extendedprice").alias("ms_a"), (F.col("l_quantity") * 1000).alias("ms_b"))
    return costs.regret(p).select("n", F.round("right", 6).alias("right"), F.round("regret", 4).alias("regret"), F.round("gain_over_coin", 4).alias("gain_over_coin"))


@query()
def imputation_legs(spark, d):
    known, masked = _examples(spark, d), _masked(spark, d)
    return experiments.imputation_legs(engine(spark, d), known, masked.select("k"), masked, [1, 5])


@query(f"WITH m AS (SELECT kind, count(*) AS n, median(seconds) AS median FROM ({_SAMPLES.replace(chr(39) + 'censored' + chr(39), chr(39) + 'error' + chr(39))}) WHERE outcome = 'ok' GROUP BY 1) SELECT kind, n, round(median, 6) AS median, greatest(1, CAST(round_even(median / (SELECT min(median) FROM m), 0) AS INT)) AS cost FROM m")
def cost_report(spark, d):
    ok = _samples(spark, d).where("outcome = 'ok'")
    return experiments.cost_report(ok).withColumn("median", F.round("median", 6))


# -- pushdown experiments and streams ------------------------------------------------------------------


@query()
def pushdown_arms(spark, d):
    node = N.Intersection((N.SingleColumn(NAMES, k=4), N.Keyword(WORDS, k=3)), k=5)
    return correctness.compare(engine(spark, d), node, ("optimised", "forward", "backward", "no_pushdown"))


@query(with_cells(f"SELECT DISTINCT table_id FROM cells WHERE token IN {KW} AND table_id IN (SELECT table_id FROM cells WHERE token IN {NM})"))
def full_intersection(spark, d):
    return correctness.full_result(engine(spark, d), N.Intersection((N.SingleColumn(NAMES), N.Keyword(WORDS))))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    out = ingest.event_counts(read(spark, d, "events"))
    return out.select("event_type", F.col("window.start").alias("start"), "n", F.round("value", 4).alias("value"))
