"""Quality rules: base counts, and divergence of a document from its language's reference.

Each language has two references: a histogram of character classes and a histogram of the language's
common words (all others are one bin). They are constants, fitted once on documents labelled good, or
the caller's own (``fit_references``), and never the judged table, so a document's verdict does not
depend on which others are in it. A document is compared with its language's references by
Jensen-Shannon distance (base 2, so 0 to 1). A distance counts only above a minimum length: the
character test needs MIN_CHARS characters, the word test MIN_WORDS words. A document whose language
has no reference is judged by the base counts only.

A projection: nothing is shuffled, joined or broadcast.

Defined cases: null and empty texts have no words and fail the base test; very long texts are used
whole. A null language counts as unknown. Rows are judged one by one, so ties and repeated rows get
equal verdicts, and other columns pass through ``keep`` untouched. If a table is empty, so is the
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import let, whole_row, words

# Common words of each language.
COMMON = {
    "en": "the of and to in a is that for it was on are as with at be this from or by an not have".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como es o ha".split(),
}
# Character classes, as patterns of what is outside; the rest, white space included, is a class each.
CLASSES = {"upper": r"\P{Lu}+", "lower": r"\P{Ll}+", "digit": "[^0-9]+", "mark": r"[^.,;:?!'\"()-]+", "symbol": r"[^#*$%\&\|<>]+"}

# Of 10,000 characters, those of each class of CLASSES, white space and others; of 10,000 words,
# the common words in order and all others. From 3,409 documents labelled good.
REFERENCES = {
    "en": {
        "chars": [138, 7952, 6, 237, 0, 1667, 0],
        "words": [553, 286, 232, 168, 117, 138, 105, 92, 77, 79, 68, 65, 45, 52, 58, 41, 48, 45, 37, 24, 48, 32, 0, 0, 7589],
    },
    "de": {
        "chars": [128, 8103, 4, 218, 0, 1546, 0],
        "words": [547, 287, 230, 167, 143, 116, 99, 96, 80, 77, 67, 65, 53, 49, 47, 46, 45, 45, 36, 1, 0, 0, 34, 0, 7671],
    },
    "fr": {
        "chars": [140, 7946, 8, 238, 0, 1667, 0],
        "words": [551, 300, 221, 169, 140, 118, 113, 95, 79, 72, 66, 62, 64, 50, 51, 0, 44, 0, 43, 44, 43, 0, 0, 39, 7635],
    },
    "es": {
        "chars": [135, 8011, 8, 230, 0, 1616, 0],
        "words": [551, 288, 222, 165, 142, 114, 0, 105, 76, 90, 86, 68, 69, 47, 57, 55, 50, 48, 44, 36, 0, 42, 0, 0, 7643],
    },
}

MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_JS, MAX_WORD_JS = 0.24, 0.30


def _count(text: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(text, outside, "")).cast("long")


def char_counts(text: Column) -> Column:
    """Array of counts: the classes in order, white space, other."""
    per = [_count(text, outside) for outside in CLASSES.values()]
    space = F.length(text).cast("long") - F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")
    return let(F.array(*per, space), lambda a: F.concat(a, F.array(F.length(text).cast("long") - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))


def word_counts(ws: Column, lang: Column) -> Column:
    """Counts of the language's common words and of all other words, null for an unknown language.

    The common words are filtered from the array once; each is then counted in their joined string.
    """
    low = F.transform(ws, F.lower)

    def counts(common: list[str]) -> Column:
        hits = F.concat(F.lit(" "), F.array_join(F.filter(low, lambda w: w.isin(common)), "  "), F.lit(" "))
        one = lambda s, w: ((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")
        counted = let(hits, lambda s: F.array(*[one(s, w) for w in common]))
        return let(counted, lambda a: F.concat(a, F.array(F.size(ws).cast("long") - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))

    out = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for name, common in COMMON.items():
        out = out.when(lang == name, counts(common))
    return out


def repeat_words(ws: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more in the array.

    Windows are hashed and sorted with their positions; equal neighbours mark covered positions.
    Texts without an equal pair (most) skip the sort. n log n in the length of the text.
    """
    n = F.size(ws)
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))))

    def covered(s: Column) -> Column:
        at = lambda j: F.get(s, j)["h"]
        seq = F.sequence(F.lit(0), F.size(s) - 1)
        marked = F.filter(seq, lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False)))
        return let(
            F.sort_array(F.transform(marked, lambda j: F.get(s, j)["p"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b
            ),
        )

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return F.coalesce(let(grams, lambda g: F.when(g.isNull(), F.lit(0).cast("long")).otherwise(count(g))), F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
        lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is empty of counts."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2))

    norm = lambda a: let(total(a), lambda s: F.when(s > 0, F.transform(a, lambda x: x / s)))
    return let(F.struct(norm(p).alias("p"), norm(q).alias("q")), lambda s: F.when(s["p"].isNotNull() & s["q"].isNotNull(), of(s["p"], s["q"])))


def features(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """What the verdict needs of each document, and its whole row as ``_row``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(whole_row(docs), docs[id_col].alias("doc_id"), t.alias("_text"), docs[lang_col].alias("_lang"))
    return rows.select(
        "_row", "doc_id", "_lang",
        F.length("_text").cast("long").alias("_chars"),
        char_counts(F.col("_text")).alias("_c"),
        dup_lines(F.col("_text")).alias("n_dup_lines"),
        let(
            words(F.col("_text")),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("wc"),
                repeat_words(w).alias("rep"), word_counts(w, F.col("_lang")).alias("h"),
            ),
        ).alias("_w"),
    )


def fit_references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, list[float]]]:
    """References of other documents, such as ones labelled good: sums over the whole table, of which
    one row for each language of COMMON comes to the driver."""
    feats = features(docs, id_col=text_col, text_col=text_col, lang_col=lang_col).where(F.col("_lang").isin(list(COMMON)))
    n, k = len(CLASSES) + 2, len(next(iter(COMMON.values()))) + 1
    sums = [F.sum(F.get("_c", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("_w.h", F.lit(i))).alias(f"w{i}") for i in range(k)]
    return {r["_lang"]: {"chars": [float(r[f"c{i}"]) for i in range(n)], "words": [float(r[f"w{i}"]) for i in range(k)]} for r in feats.groupBy("_lang").agg(*sums).collect()}


def judge(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False, refs: dict | None = None) -> DataFrame:
    """One row for each document: the base counts, the two distances and the verdict.

    ``keep``: return the input's own columns of the documents that are kept instead. ``refs``: other
    references than the constants, as ``fit_references`` gives them.
    """
    feats = features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    refs = REFERENCES if refs is None else refs
    doubles = lambda xs: F.lit([float(x) for x in xs])

    def verdict(f: Column) -> Column:
        """All that is derived from one document's features, which are bound once."""
        c, h = (F.transform(x, lambda v: v.cast("double")) for x in (f["_c"], f["_w"]["h"]))
        char_js = word_js = F.when(F.lit(False), F.lit(0.0))
        for lang, ref in refs.items():
            char_js = char_js.when(f["_lang"] == lang, js_distance(c, doubles(ref["chars"])))
            word_js = word_js.when(f["_lang"] == lang, js_distance(h, doubles(ref["words"])))
        n, rep = f["_w"]["n"], f["_w"]["rep"]
        js = F.struct(F.when(f["_chars"] >= MIN_CHARS, char_js).alias("char"), F.when(n >= MIN_WORDS, word_js).alias("word"))
        failed = (n < 50) | (100 * rep > 50 * n)
        far = lambda x: F.coalesce(x["char"] > MAX_CHAR_JS, F.lit(False)) | F.coalesce(x["word"] > MAX_WORD_JS, F.lit(False))
        return let(js, lambda x: F.struct(
            n.alias("n_words"), f["_w"]["wc"].alias("word_chars"), F.get(f["_c"], F.lit(list(CLASSES).index("symbol"))).alias("n_symbols"), f["n_dup_lines"].alias("n_dup_lines"),
            rep.alias("n_repeat_words"), x["char"].alias("char_js"), x["word"].alias("word_js"), failed.alias("base_failed"), (~(failed | far(x))).alias("kept"),
        ))

    judged = let(F.struct("_chars", "_c", "_lang", "_w", "n_dup_lines"), verdict)
    if keep:
        return feats.where(judged["kept"]).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return feats.select("doc_id", judged.alias("v")).select("doc_id", "v.*")
