"""Spelling variants: words one edit apart, and for each word the much more frequent form that it is a variant of.

The vocabulary is counted in the JVM. It is then dealt to acceptors twice: words by their first letters, where pairs that
differ later meet, and reversed words by their last letters, where the pairs that differ within the first three meet.
A start of the automaton with more than `HOT` words below it is opened by one letter: the pairs that are edited right there
read the same rest afterwards, so they meet in an equi-join on start and rest, whose groups hold one word for each letter
of the alphabet; all others are edited further on and meet below the longer starts. This goes on until no start is hot.
Starts are bundled to acceptors of about `BIN` words, each composed in one task (see acceptors.py). Tasks return one row a
word: how many near words it met, and the most frequent of them.

Defined results: null texts have no words; a null id counts as an empty one in the hash; repeated rows count as often as
they occur; of near words with equal counts the first in code-point order is the form; words of any length are taken whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.acceptors import near_pairs
from stellwerk.llm.common import small_or_shuffled, stored

#: Letters of words: all below U+0100, so that a word's Latin-1 bytes are its code points.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many runs, by its hash, loses a letter.
TYPO_EVERY = 31
#: First letters of a start, and last ones; pairs that differ within the first three share the last four, as words have seven.
HEAD, TAIL = 3, 4
BIN, HOT = 16_384, 65_536
FOUND = "word string, near long, best string, best_n long"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY) -> DataFrame:
    """word, n: distinct words of at least seven letters that occur at least twice, with their numbers.

    Only A-Z become small. A run whose hash with its document's id is divisible by `every` has lost one letter.
    """
    #: Shorter runs cannot become words; longer ones are matched whole.
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), 0)).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.length("run") == F.octet_length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", upper, upper.lower())).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    found = runs.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _best(most: Column, word: Column) -> Column:
    """To be made least: the larger count, then the first word."""
    return F.struct((-most).alias("less"), word.alias("best"))


def composed(block: pd.DataFrame, reverse: bool) -> pd.DataFrame:
    """FOUND of the words of one acceptor: word, n, p (the letters of the start, from which on words may be edited)."""
    codes = np.array([w.encode("latin-1") for w in block["word"]], dtype=object)
    read = [w[::-1] for w in codes] if reverse else list(codes)
    order = sorted(range(len(read)), key=read.__getitem__)
    codes, n = codes[order], block["n"].to_numpy()[order]
    i, j = near_pairs([read[k] for k in order], block["p"].to_numpy()[order], HEAD - 1 if reverse else None)
    if reverse:
        starts = np.array([w[:HEAD] for w in codes])
        apart = starts[i] != starts[j]
        i, j = i[apart], j[apart]
    #: Every pair from both sides, each word's near words by number and then by code points.
    rank = np.empty(len(codes), np.int64)
    rank[sorted(range(len(codes)), key=codes.__getitem__)] = np.arange(len(codes))
    own, other = np.concatenate([i, j]), np.concatenate([j, i])
    by = np.lexsort((rank[other], -n[other], own))
    own, other = own[by], other[by]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    near = np.diff(np.append(first, len(own)))
    text = lambda k: pd.Series([w.decode("latin-1") for w in codes[k]], dtype=object)
    return pd.DataFrame({"word": text(own[first]), "near": near, "best": text(other[first]), "best_n": n[other[first]]})


def _met_here(rows: DataFrame, p: int, reverse: bool) -> DataFrame:
    """FOUND of the pairs that are edited right after their hot start of p letters: they have start and rest in common."""
    r, length = F.col("r"), F.length("r")
    longer = rows.filter(length > p).select("word", "n", F.substring(r, 1, p).alias("start"), F.substring(r, F.lit(p + 2), length).alias("rest"), F.substring(r, p + 1, 1).alias("letter"))
    without = rows.select("word", "n", F.substring(r, 1, p).alias("start"), F.substring(r, F.lit(p + 1), length).alias("rest"), F.lit("").alias("letter"))
    both = longer.unionByName(without)
    if reverse:
        both = both.filter(F.length("rest") < HEAD)
    groups = both.groupBy("start", "rest").agg(F.collect_list(F.struct("letter", "n", "word")).alias("members")).filter(F.size("members") > 1)
    member = groups.select("members", F.substring("rest", 1, 1).alias("next"), F.explode("members").alias("m"))

    def met(o: Column) -> Column:
        """Another letter; and where one has none, the other's is not the one that follows, as they would differ later then."""
        ok = (o["letter"] != F.col("m.letter")) & ~((o["letter"] == "") & (F.col("m.letter") == F.col("next"))) & ~((F.col("m.letter") == "") & (o["letter"] == F.col("next")))
        return ok & (F.substring(o["word"], 1, HEAD) != F.substring(F.col("m.word"), 1, HEAD)) if reverse else ok

    found = member.withColumn("others", F.filter("members", met)).filter(F.size("others") > 0)
    found = found.select(F.col("m.word").alias("word"), F.size("others").cast("long").alias("near"), F.array_min(F.transform("others", lambda o: _best(o["n"], o["word"]))).alias("b"))
    return found.select("word", "near", "b.best", (-F.col("b.less")).alias("best_n"))


def _near_one_way(vocabulary: DataFrame, bins: int, reverse: bool, hot: int) -> list[DataFrame]:
    """FOUND of one reading direction, as several relations."""
    p = TAIL if reverse else HEAD
    rows = vocabulary.withColumn("r", F.reverse("word") if reverse else F.col("word"))
    cool, found = [], []
    while True:
        start = F.substring("r", 1, p)
        large = stored(rows.groupBy(start.alias("start")).agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > hot), "hot-starts")
        if large.isEmpty():
            cool.append(rows.withColumn("p", F.lit(p)))
            break
        inside = small_or_shuffled(large.select("start"), 100_000)
        cool.append(rows.join(inside, start == F.col("start"), "left_anti").withColumn("p", F.lit(p)))
        rows = stored(rows.join(inside, start == F.col("start"), "left_semi"), "hot-words")
        found.append(_met_here(rows, p, reverse))
        rows = rows.filter(F.length("r") > p)
        p += 1
    dealt = reduce(DataFrame.unionByName, cool).select("word", "n", "p", F.pmod(F.xxhash64(F.expr("substring(r, 1, p)")), F.lit(bins)).alias("bin"))
    found.append(dealt.groupBy("bin").applyInPandas(lambda b: composed(b.drop(columns="bin"), reverse), FOUND))
    return found


def near_words(vocabulary: DataFrame, bin_words: int = BIN, hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n for each word of vocabulary (word, n; a stored table)."""
    bins = max(1, -(-vocabulary.count() // bin_words))
    found = reduce(DataFrame.unionByName, [f for reverse in (False, True) for f in _near_one_way(vocabulary, bins, reverse, hot)])
    met = found.groupBy(F.col("word").alias("m_word")).agg(F.sum("near").alias("near"), F.min(_best(F.col("best_n"), F.col("best"))).alias("b"))
    is_form = -F.col("b.less") >= TIMES * F.col("n")
    return vocabulary.join(met, F.col("word") == F.col("m_word"), "left").select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("b.best")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n")
    )


def with_roots(found: DataFrame) -> DataFrame:
    """found (word, form, ...; a stored table) with root: the last of the forms from a word on, or the word itself.

    A form has ten times its word's number, so no chain of 64-bit numbers has more than 18 links; each round doubles the step.
    """
    links = stored(found.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        on = links.join(ahead, F.col("root") == F.col("a_word"), "left").select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved"))
        on = stored(on, "forms")
        links = on.drop("moved")
        if on.filter("moved").isEmpty():
            break
    roots = links.select(F.col("word").alias("r_word"), F.col("root").alias("r_root"))
    return found.join(roots, F.col("word") == F.col("r_word"), "left").withColumn("root", F.coalesce("r_root", "word")).drop("r_word", "r_root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = TYPO_EVERY, bin_words: int = BIN, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the documents."""
    vocabulary = stored(words(docs, id_col, text_col, every), "vocabulary")
    found = with_roots(stored(near_words(vocabulary, bin_words, hot), "near-words"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
