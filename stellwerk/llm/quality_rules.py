"""Quality rules: repetition and length rules, then divergence from the language, in DataFrame operations only.

Each text gets two histograms: its code points by character class, and its words by the `words_kept`
commonest words of its language (and all others). Both are compared with those of all documents of the
language by Jensen-Shannon distance (the square root of the divergence in bits). A text is rejected where a
distance exceeds its level; texts below a minimum length are not judged by that histogram. All words of all
documents are counted, before any shuffle, to find the commonest ones of each language.

The text is read twice, by map stages with partial aggregates; only counts and histograms are written and compared.

Defined results: null text counts as empty (no words: fails the base rules); a null lang is a language of
its own; a null id is carried; repeated rows get the same result; empty tables give empty results; extra
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import SPACE_CHARS, one_space, small_or_shuffled, stored, text_of

#: Characters counted as symbols, and as punctuation.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()\\-"
CLASSES = ("upper", "digit", "punctuation", "symbol", "space", "beyond_ascii", "rest")
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
WORDS_KEPT, MOST_LANGS = 12, 1000
#: Levels of the distances, and the least number of code points or words to be judged.
CHAR_LEVEL, CHAR_LEAST, WORD_LEVEL, WORD_LEAST = 0.3, 200, 0.36, 80


def _only(text: Column, kind: str) -> Column:
    """How many code points of the text are of this kind (the inside of a character class)."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def _repeated(words: Column, n: Column) -> Column:
    """Words (given as hashes) that lie in a window of WINDOW words which occurs more than once in the text."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["p"]))

        def length(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

        return _bound(_bound(ranked, places), length)

    return _bound(_bound(words, windows), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the numbers of the base rules: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.col("__text")
    rows = docs.withColumn("__text", text_of(text_col)).withColumn("__norm", F.trim(one_space(text)))
    words = F.when(F.col("__norm") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("__norm", " "), lambda w: F.xxhash64(w)))
    rows = rows.withColumn("__words", words).withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    n = F.size("__words")
    return rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.greatest(F.length("__norm") - n + 1, F.lit(0)).cast("long"),
            "n_symbols": _only(text, SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(n >= WINDOW, _repeated(F.col("__words"), n)).otherwise(0).cast("long"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def class_counts() -> Column:
    """The text's code points by CLASSES, beside the base numbers; bytes beyond one for a code point count as a class."""
    text = F.col("__text")
    found = [_only(text, r"\p{Lu}"), _only(text, "0-9"), _only(text, PUNCTUATION), F.col("n_symbols"), F.length(text) - F.col("word_chars"), F.octet_length(text) - F.length(text)]
    return F.array(*found, F.greatest(F.length(text) - sum(found[1:], found[0]), F.lit(0))).cast("array<long>")


def common_words(docs: DataFrame, kept: int, text_col: str, lang_col: str) -> DataFrame:
    """ref_lang, words (hashes): the commonest words of each language, as they are written; ties by hash."""
    words = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.explode(F.split(one_space(text_of(text_col)), " ")).alias("word"))
    counts = words.filter("word != ''").groupBy("lang", F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= kept).groupBy(F.col("lang").alias("ref_lang"))
    return top.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda t: t["word"]).alias("words"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of counts."""
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0).cast("long"), lambda s, y: s + y))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(share(p), share(q), lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def histograms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, lang, the base numbers and both histograms of each row of docs, written to the shared folder."""
    refs = stored(common_words(docs, kept, text_col, lang_col), "common-words")
    rows = base_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")), "doc_id", "text")
    rows = rows.join(small_or_shuffled(refs, MOST_LANGS), F.col("lang") == F.col("ref_lang"), "left")
    count = lambda w: F.col("n_words") - F.size(F.array_remove("__words", w))
    rows = rows.withColumn("__common", F.transform(F.coalesce("words", F.array().cast("array<long>")), count))
    others = F.col("n_words") - F.aggregate("__common", F.lit(0).cast("long"), lambda s, x: s + x)
    return stored(
        rows.select(
            "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            class_counts().alias("classes"), F.concat("__common", F.array(F.greatest(others, F.lit(0).cast("long")))).alias("common"),
        ),
        "histograms",
    )


def judged(found: DataFrame) -> DataFrame:
    """found (see `histograms`) with base_failed, both distances and kept."""
    sums = lambda c, n: F.array(*[F.sum(F.coalesce(F.get(c, F.lit(k)), F.lit(0))) for k in range(n)])
    refs = found.groupBy(F.col("lang").alias("ref_lang")).agg(sums("classes", len(CLASSES)).alias("ref_classes"), sums("common", WORDS_KEPT + 1).alias("ref_common"))
    rows = found.join(small_or_shuffled(stored(refs, "references"), MOST_LANGS), F.col("lang") == F.col("ref_lang"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumns(
        {
            "base_failed": base_failed(),
            "char_distance": F.when(total("classes") >= CHAR_LEAST, _distance(F.col("classes"), F.col("ref_classes"))),
            # a language with fewer words than are kept has a shorter histogram
            "word_distance": F.when(F.col("n_words") >= WORD_LEAST, _distance(F.col("common"), F.slice("ref_common", F.lit(1), F.size("common")))),
        }
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LEVEL) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LEVEL)
    return rows.withColumn("kept", ~F.col("base_failed") & near)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base numbers, base_failed, both distances and kept for each row of docs."""
    return judged(histograms(docs, id_col, text_col, lang_col)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"
    )
