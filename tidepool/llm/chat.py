"""Chat formatting in budgeted, turn-aligned windows.

Each turn becomes ``<|im_start|>role\\n text <|im_end|>\\n``. In texts every ``<|``, also with
backslashes between, gets one more backslash, so control strings cannot be forged and the original
is got back by taking one away; a line feed in a role is written ``<|nl|>``.

Prefix sums of turn tokens choose the windows: a turn belongs to the window in whose stride its sum
starts. A window repeats the conversation's system turn and, before its own turns, those whose tokens
fit in ``history``; both are outside the loss mask, which covers the texts of the window's own
assistant turns. So every turn is new in exactly one window. A stride is half of the room that the
history leaves, so a window fits the budget unless one turn is longer than that (``over_budget``).

Scale: one shuffle, by conversation; prefix sums are window functions, which spill. A row holds one
window, whose turns are bounded by the budget; a single turn is never cut.

Defined cases: null roles and texts are empty. Turns are ordered by ``turn`` (nulls last), role, text;
repeated turns stay repeated. A null ``conv_id`` is one conversation. A system turn counts as such
only in the first place. Other columns are not read. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import let

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
BUDGET, HISTORY = 512, 96


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))


def tokens(text: Column) -> Column:
    """An estimate without a tokenizer: four for the template, one for each four bytes."""
    return (F.lit(4) + F.ceil(F.octet_length(text) / 4)).cast("long")


def stride(budget: int, history: int) -> int:
    return max(history, (budget - history) // 2, 1)


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, n_turns, n_repeats, text, loss, n_tokens, over_budget``.

    ``n_repeats`` leading turns of the window are repeats; ``loss`` lists ``start, length`` in
    characters of ``text``.
    """
    step = stride(budget, history)
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    t = t.withColumn("ord", F.row_number().over(order))
    t = t.withColumn("sys", (F.col("ord") == 1) & (F.col("role") == "system")).withColumn("tok", tokens(F.col("text")))
    t = t.withColumn("s", F.coalesce(F.sum(F.when(F.col("sys"), 0).otherwise(F.col("tok"))).over(conv.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    t = t.withColumn("window", F.dense_rank().over(conv.orderBy(F.floor(F.col("s") / step))))
    t = t.withColumn("next", F.min("s").over(conv.orderBy("window").rangeBetween(1, 1)))
    again = ~F.col("sys") & F.coalesce(F.col("next") - F.col("s") <= history, F.lit(False))
    own = F.array(F.struct(F.col("window"), F.lit(False).alias("rep")))
    later = F.array(F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("rep")))
    t = t.withColumn("x", F.explode(F.when(again, F.concat(own, later)).otherwise(own)))
    seg = F.struct("ord", F.col("x.rep").alias("rep"), head(F.col("role")).alias("head"), (F.col("role") == "assistant").alias("says"), escape(F.col("text")).alias("body"), "tok")
    w = t.groupBy("conv_id", F.col("x.window").alias("window")).agg(F.sort_array(F.collect_list(seg)).alias("segs"), F.max(F.when(F.col("sys"), F.struct(seg.alias("seg")))).alias("sys"))
    w = w.withColumn("sys", F.max("sys.seg").over(Window.partitionBy("conv_id")))
    lead = F.struct(*[F.lit(True).alias(c) if c == "rep" else F.col("sys")[c].alias(c) for c in ("ord", "rep", "head", "says", "body", "tok")])
    w = w.withColumn("segs", F.when(F.col("sys").isNotNull() & (F.col("window") > 1), F.concat(F.array(lead), "segs")).otherwise(F.col("segs")))

    size = lambda s: F.length(s["head"]) + F.length(s["body"]) + len(END)

    def spans(segs: Column) -> Column:
        start = F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), F.array().cast("array<struct<start:int,length:int>>"))
        one = lambda a, s: F.array(F.struct((a["at"] + F.length(s["head"])).alias("start"), F.length(s["body"]).alias("length")))
        return F.aggregate(
            segs, start,
            lambda a, s: F.named_struct(F.lit("at"), a["at"] + size(s), F.lit("out"), F.when(s["says"] & ~s["rep"], F.concat(a["out"], one(a, s))).otherwise(a["out"])),
        )["out"]

    n_tokens = F.aggregate("segs", F.lit(0).cast("long"), lambda a, s: a + s["tok"])
    return w.select(
        "conv_id", "window",
        F.size(F.filter("segs", lambda s: ~s["rep"])).cast("long").alias("n_turns"),
        F.size(F.filter("segs", lambda s: s["rep"])).alias("n_repeats"),
        F.array_join(F.transform("segs", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "").alias("text"),
        spans(F.col("segs")).alias("loss"),
        n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"),
    )


def parse(text: Column) -> Column:
    """Array of ``role, text`` of the turns in a formatted window."""

    def one(piece: Column) -> Column:
        at = F.locate("\n", piece)
        body = F.substring(piece, at + 1, F.length(piece) - at - len(END))
        return F.struct(unescape(F.replace(F.substring(piece, F.lit(1), at - 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(let(F.split(text, r"<\|im_start\|>"), lambda p: F.slice(p, F.lit(2), F.size(p))), one)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns, loss_text, formatted_chars`` from the windows alone: new turns in
    order, and all text under the loss masks."""
    turns = F.array_join(F.transform(let(parse(F.col("text")), lambda p: F.slice(p, F.col("n_repeats") + 1, F.size(p))), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda x: unescape(F.substring("text", x["start"] + 1, x["length"]))), "")
    rows = formatted.select("conv_id", F.struct("window", turns.alias("turns"), masked.alias("masked")).alias("x"), F.size(parse(F.col("text"))).alias("n"), "n_repeats", F.length("text").cast("long").alias("chars"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"), F.sum(F.col("n") - F.col("n_repeats")).alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    join = lambda name: F.array_join(F.transform("xs", lambda x: x[name]), "")
    return rows.select("conv_id", "n_turns", join("turns").alias("turns"), join("masked").alias("loss_text"), "formatted_chars")
