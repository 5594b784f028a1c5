"""Plans are turned into DataFrames here.

Catalyst cannot move a table filter below a top-k, since that changes the result; a plan's semantics
asks for just that. So the planner runs the earlier inputs of an intersection or difference (their at
most k table ids come to the driver) and builds the later ones over the filtered index, where the
filter reaches the Parquet scan. ``pushdown=False`` gives plain set semantics instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import raw_cell
from ..functions.vectors import normalise
from ..operators import rollup, seekers, setops, vectors
from ..operators.filters import IdFilter
from ..operators.vectors import DEFAULT_PLANES
from ..sources.lake import Lake
from . import nodes as N

@dataclass(frozen=True)
class Options:
    pushdown: bool = True
    #: An approximate input that feeds a filter is widened to at least so many tables.
    guard_width: int | None = None
    #: Approximate inputs of an intersection run last.
    exact_first: bool = False
    #: A semantic search of at most so many columns is exact, of more by hashing.
    exact_columns: int = 1035
    #: What a filtered search fetches for each query column.
    filtered_depth: int = 500
    #: Columns fetched beyond those that vote, in place of the query table's own.
    spare: int = 10
    #: Bits of a vector's code for hashing, and candidates of which the cosine is computed, times those fetched.
    hash_bits: int = 512
    hash_refine: int = 20


@dataclass(frozen=True)
class Reach:
    """How far a semantic search looks: the columns fetched for each query column, how many of them
    vote, and whether all searched columns are compared."""

    fetch: int
    vote: int
    exact: bool


def reach(node: N.SemanticUnion, options: Options, stored: int, left: int | None = None) -> Reach:
    """``stored`` columns are in the index; a table filter leaves ``left`` of them (None: no filter).

    A depth set on the node holds as it is. A filter has chosen the candidates already, so all that are
    fetched vote. Otherwise the votes follow from ``k``.
    """
    searched = stored if left is None or not node.prefilter else left
    if node.k_coarse is not None:
        fetch = vote = node.k_coarse
    elif left is not None:
        fetch = vote = min(options.filtered_depth, searched)
    else:
        vote = max(1, round(node.vote_factor * max(node.k, 1)))
        fetch = vote + options.spare
    return Reach(fetch, vote, searched <= options.exact_columns)


@dataclass
class Engine:
    """A lake with its optional vector and code indexes, and results of leaf searches by node and filter."""

    lake: Lake
    vectors: DataFrame | None = None
    codes: DataFrame | None = None
    code_dim: int = 32
    code_bits: int = DEFAULT_PLANES
    code_seed: int = 0
    options: Options = Options()
    _memo: dict = field(default_factory=dict, repr=False)

    # -- running ---------------------------------------------------------------------------------

    def run(self, node: N.Node) -> DataFrame:
        """``rank, table_id`` and, for leaf searches, the score and columns."""
        return self.build(node, IdFilter())

    def ids(self, node: N.Node) -> list[int]:
        return [r["table_id"] for r in self.run(node).orderBy("rank").limit(node.k).collect()]

    def build(self, node: N.Node, keep: IdFilter) -> DataFrame:
        if isinstance(node, N.Intersection):
            return self._intersection(node, keep)
        if isinstance(node, N.Difference):
            return self._difference(node, keep)
        if isinstance(node, N.Union):
            return setops.union([self.build(x, keep) for x in node.inputs], node.k)
        if isinstance(node, N.Counter):
            return setops.counter([self.build(x, keep) for x in node.inputs], node.k)
        if isinstance(node, N.Fusion):
            return setops.fusion([self.build(x, keep) for x in node.inputs], list(node.weights) or None, node.constant, node.k)
        # An approximate search is asked for again and again by experiments; plans are immutable.
        key = (id(node), node.k, keep)
        if key not in self._memo:
            by = "strength" if isinstance(node, N.Correlation) else "score"
            # Of equal votes the table that was seen first wins.
            self._memo[key] = (node, seekers.top(self.scored(node, keep), node.k, by, ties=("first", "table_id", "colid", "numcol")))
        return self._memo[key][1]

    def scored(self, node: N.Node, keep: IdFilter = IdFilter()) -> DataFrame:
        """All matches of a leaf search with their scores, neither ranked nor cut."""
        if isinstance(node, N.Keyword):
            return seekers.keyword(self.lake, node.values, keep)
        if isinstance(node, N.SingleColumn):
            return seekers.single_column(self.lake, node.values, keep)
        if isinstance(node, N.MultiColumn):
            return seekers.multi_column(self.lake, node.rows, keep)
        if isinstance(node, N.Correlation):
            return seekers.correlation(self.lake, node.source, node.target, keep)
        if isinstance(node, N.SimHash):
            return self._simhash(node, keep)
        if isinstance(node, N.SemanticUnion):
            return self._semantic(node, keep)
        raise TypeError(f"not a leaf search: {node!r}")

    # -- combiners -------------------------------------------------------------------------------

    def order(self, node: N.Intersection) -> list[N.Node]:
        """Cheapest first, then by predicted runtime; stable."""
        if node.fixed:
            return list(node.inputs)
        late = lambda x: x.approximate if self.options.exact_first else False
        return sorted(node.inputs, key=lambda x: (late(x), x.ordering, x.runtime))

    def _widened(self, node: N.Node) -> N.Node:
        w = self.options.guard_width
        return node.cut(max(node.k, w)) if w and node.approximate else node

    def _found(self, node: N.Node, keep: IdFilter) -> list[int]:
        r = self.build(node, keep)
        return [x["table_id"] for x in r.orderBy("rank").limit(node.k).select("table_id").collect()]

    def _intersection(self, node: N.Intersection, keep: IdFilter) -> DataFrame:
        order = self.order(node)
        if not self.options.pushdown:
            out = setops.pure_intersection([self.build(x, keep) for x in [order[-1], *order[:-1]]])
            return setops.cut(out, node.k)
        allowed = keep
        for x in order[:-1]:
            x = self._widened(x)
            allowed = keep.also(allow=self._found(x, allowed))
            if allowed.empty:
                break
        return self.build(order[-1].cut(node.k), allowed)

    def _difference(self, node: N.Difference, keep: IdFilter) -> DataFrame:
        left, right = node.inputs
        if not self.options.pushdown:
            return setops.cut(setops.pure_difference(self.build(left, keep), self.build(right, keep)), node.k)
        gone = self._found(self._widened(right), keep)
        return self.build(left.cut(node.k), keep.also(deny=gone))

    # -- approximate searches --------------------------------------------------------------------

    def _simhash(self, node: N.SimHash, keep: IdFilter) -> DataFrame:
        if self.codes is None:
            raise ValueError("the lake has no code index")
        if node.table_id is not None and node.colid is not None:
            query = self.codes.where((F.col("table_id") == node.table_id) & (F.col("colid") == node.colid))
        else:
            values = node.values if isinstance(node.values, DataFrame) else self.lake.spark.createDataFrame([(None if v is None else str(v),) for v in node.values], "value string")
            rows = values.select(F.lit(-1).alias("table_id"), F.lit(0).alias("colid"), F.monotonically_increasing_id().alias("rowid"), raw_cell(F.col(values.columns[0])).alias("value"))
            query = vectors.code_index(rows, self.code_dim, self.code_bits, seed=self.code_seed)
        return seekers.code_overlap(self.codes, query, keep)

    def query_vectors(self, node: N.SemanticUnion) -> DataFrame:
        """``query_col, query_table, embedding`` of the node's query columns."""
        if node.vectors is not None:
            return node.vectors.select("query_col", F.lit(-1 if node.table_id is None else node.table_id).alias("query_table"), "embedding")
        own = self.vectors.where(F.col("table_id") == node.table_id)
        if node.colid is not None:
            own = own.where(F.col("colid") == node.colid)
        if own.limit(1).count() == 0:
            raise KeyError(f"query column not indexed: table {node.table_id}, column {node.colid}")
        return own.select(F.col("colid").alias("query_col"), F.col("table_id").alias("query_table"), "embedding")

    def _stored(self, keep: IdFilter) -> int:
        """Stored columns that the filter leaves; counted once."""
        key = ("stored", keep)
        if key not in self._memo:
            self._memo[key] = keep.on(self.vectors).count()
        return self._memo[key]

    def _semantic(self, node: N.SemanticUnion, keep: IdFilter) -> DataFrame:
        if self.vectors is None:
            raise ValueError("the lake has no vector index")
        q = self.query_vectors(node)
        d = reach(node, self.options, self._stored(IdFilter()), self._stored(keep) if keep != IdFilter() else None)
        before = keep if node.prefilter else IdFilter()
        if d.exact:
            hits = vectors.nearest(q, self.vectors, d.fetch, before)
        else:
            hits = vectors.lsh_nearest(q, before.on(self.vectors), d.fetch, self.options.hash_refine, self.options.hash_bits)
        hits = hits.select(F.lit(0).alias("query"), "query_col", "r", "table_id", (-F.col("similarity")).alias("distance"))
        if node.rollup == "max_pool":
            out = rollup.max_pool(hits)
        elif node.rollup == "munkres":
            unit = self.vectors.select("table_id", normalise(F.col("embedding")).alias("embedding"))
            out = rollup.munkres(q.select(F.lit(0).alias("query"), normalise(F.col("embedding")).alias("embedding")), hits.select("query", "table_id"), unit, node.threshold)
        elif node.rollup in ("decay_vote", "default"):
            out = rollup.decay_vote(hits, d.vote)
        else:
            raise ValueError(f"unknown roll-up: {node.rollup}")
        return keep.on(out)
