"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a target number of words. As many complete epochs of the source as fit come first;
what is left of the target is filled by weighted sampling without replacement: every document has an
exponential key, -ln(u) / quality, with u from a hash of its id, and the documents of the source are
taken by ascending key until their words reach what is left. The last one is taken if at least half of
it fits, so the error is at most half a document.

The order within a source is never sorted in one task. Words are summed by source and by 1024 ranges
of the key, the range where the sum crosses the budget is cut into 1024 again, and only the documents
of that last range are sorted. What comes out is one cut-off key for each source; the documents meet
it in a join with one row per source.

Defined results: null text counts as empty and null source is a source of its own, the last one;
rows that share an id share its draw (rows without an id, too), and those of equal keys are taken in
the order of a hash of the text, equal texts by count, so that the sample can end between them; texts without
words are in every sample and add nothing; a source without words has target 0; empty tables give
empty results; extra columns are carried through `mix`, whatever their names, and read only to tell apart rows of one id
and text between which the sample ends. Sources are few labels: their list, one row each, is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import SPACE_CHARS, WORD, small_or_shuffled, stored, text_of, unused

WEIGHTS, SHARE, MOST_EPOCHS, RANGES = (5, 2, 1), 1.5, 2, 1024
#: ASCII digits and marks.
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The least weight, so that every document can be drawn; shares of letters and of marks that prose has; words with fewer or more letters in the mean count half.
LEAST, LETTERS, FEW_MARKS, WORD_LENGTHS = 0.05, 0.75, 0.05, (2.0, 25.0)
#: Sources up to this number are broadcast; beyond it, the joins shuffle.
MOST_SOURCES = 10_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality(text: Column) -> Column:
    """0.05 to 1, the product of three signals, each 1 for ordinary prose.

    Letters: the share of characters that are neither blanks, digits nor marks, in full from 0.75 on. Marks: 1 less three times the
    share beyond 0.05 of what is neither a letter nor one blank for each word. Length: one half if words have fewer than 2 or more
    than 25 letters in the mean. All come from one pass for letters and the count of words, which the mix needs anyway.
    """
    every, n = F.greatest(F.length(text), F.lit(1)), words(text)
    letters = F.length(F.translate(text, SPACE_CHARS + MARKS, ""))
    marks = F.greatest(F.lit(0), F.length(text) - letters - n) / every
    clean = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(3.0) * F.greatest(F.lit(0.0), marks - F.lit(FEW_MARKS)))
    length = F.when((letters / F.greatest(n, F.lit(1))).between(*WORD_LENGTHS), F.lit(1.0)).otherwise(F.lit(0.5))
    return F.greatest(F.lit(LEAST), F.least(F.lit(1.0), letters / every / F.lit(LETTERS)) * clean * length)


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u from 52 bits of a hash of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10)
    return -F.ln((bits.cast("double") + 0.5) / 2.0**52) / weight


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """totals (source, source_size: one row per source) with weight, target.

    Weights repeat by the sources' code points. A target stops at `most` times its source; sorted by
    the level at which they stop, the sources that stop are those whose level is below the one that
    the rest would reach.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = (
        ranked.withColumn("cap", F.col("source_size") * most)
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * share - F.col("capped")) / F.col("rest"))
        .withColumn("stops", F.col("cap") / F.col("weight") <= F.col("level"))
        .withColumn("final", F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(Window.partitionBy())["level"])
    )
    return ranked.select("source", "source_size", "weight", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def cutoffs(rows: DataFrame, goals: DataFrame, ranges: int = RANGES) -> DataFrame:
    """For each source: size, target, epochs, the greatest (key, id, tie, size) of the sample (null if it is empty), and how many of its `tied` rows are taken.

    rows: source, id, size, key, tie.
    """
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    #: Ranges are laid over key / (1 + key): fine for the small keys of heavy texts, and not used up by the large keys of light ones.
    place = F.col("key") / (F.lit(1.0) + F.col("key")) * ranges
    cut = stored(goals, "targets").withColumn("before", F.lit(0).cast("long"))
    left = rows.withColumn("range", F.least(F.floor(place), F.lit(ranges - 1)))
    left = left.withColumn("subrange", F.least(F.floor((place - F.col("range")) * ranges), F.lit(ranges - 1)))
    for level in ("range", "subrange"):
        left = left.join(small_or_shuffled(cut.select(F.col("source").alias("c_source"), F.col("before").alias("c_before"), F.col("budget").alias("c_budget"), *[F.col("cut").alias("c_cut")] * (level == "subrange")), MOST_SOURCES),
                         F.col("source").eqNullSafe(F.col("c_source")) & ((F.col("range") == F.col("c_cut")) if level == "subrange" else F.lit(True)))
        sums = left.groupBy("source", level, "c_before", "c_budget").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("c_before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        found = sums.filter("start <= c_budget").groupBy(F.col("source").alias("f_source")).agg(F.max(level).alias("cut"), F.max_by("start", level).alias("start"))
        cut = stored(cut.drop("cut", "before").join(found, F.col("source").eqNullSafe(F.col("f_source"))).drop("f_source").withColumnRenamed("start", "before"), f"cut-{level}")
        left = left.drop("c_source", "c_before", "c_budget", "c_cut")
    last = left.join(small_or_shuffled(cut.select(F.col("source").alias("c_source"), "before", "budget", F.col("cut").alias("c_cut")), MOST_SOURCES), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("subrange") == F.col("c_cut")))
    step, whole = F.struct("key", "id"), F.struct("key", "id", "tie", "size")
    last = stored(last.select("source", "before", "budget", "key", "id", "tie", "size"), "last-range")
    cut = _reached(last, "step", step)
    left = _at(last, cut, "step", step)
    for level, place in (("tie_range", F.shiftright("tie", 53)), ("tie_subrange", F.shiftright("tie", 43))):
        cut = _reached(left, level, place)
        left = _at(left, cut, level, place)
    tied = left.groupBy("source", "before", "budget", whole.alias("at")).agg(F.count(F.lit(1)).alias("tied"))
    size, budget = F.col("at.size"), F.col("budget")
    up = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("start", F.col("before") + F.coalesce(F.sum(size * F.col("tied")).over(up), F.lit(0)))
    guess = F.floor((budget - F.col("start")) / size + 0.5)
    fits = lambda n: F.col("start") + n * size + size / 2 <= budget
    exact = F.when(fits(guess), guess + 1).when(fits(guess - 1), guess).otherwise(guess - 1)
    room = F.when(size == 0, F.when(F.col("start") <= budget, F.col("tied")).otherwise(0)).otherwise(exact)
    tied = tied.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("tied"), room)).cast("long"))
    ends = tied.groupBy(F.col("source").alias("t_source")).agg(F.max(F.when(F.col("taken") > 0, F.struct("at", "taken", "tied"))).alias("last"), F.min("at").alias("first"))
    #: Where none of the last range is taken, the sample ends before the first of it.
    return goals.select("source", "source_size", "target", "epochs").join(ends, F.col("source").eqNullSafe(F.col("t_source")), "left").select(
        "source", "source_size", "target", "epochs", F.coalesce("last.at", "first").alias("cut"), F.col("last").isNotNull().alias("within"), "last.taken", "last.tied"
    )


def _reached(rows: DataFrame, name: str, place: Column) -> DataFrame:
    """c_source, c_place, c_before: the last place of each source that begins within the budget, and the words before it."""
    sums = rows.groupBy("source", "before", "budget", place.alias(name)).agg(F.sum("size").alias("n"))
    up = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(up), F.lit(0))).filter("start <= budget")
    found = sums.groupBy(F.col("source").alias("c_source")).agg(F.max(name).alias("c_place"), F.max_by("start", name).alias("c_before"))
    return stored(found, f"cut-{name}")


def _at(rows: DataFrame, cut: DataFrame, name: str, place: Column) -> DataFrame:
    """The rows of that place."""
    here = rows.withColumn("place", place).join(small_or_shuffled(cut, MOST_SOURCES), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("place") == F.col("c_place")))
    return here.withColumn("before", F.col("c_before")).drop("place", "c_source", "c_place", "c_before")


def added(docs: DataFrame) -> list[str]:
    """Names of what `copies` adds: __size, __source_size, __target and __copies, with more underscores where docs has such columns."""
    return unused(docs, "__size", "__source_size", "__target", "__copies")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, weight=quality) -> DataFrame:
    """docs with the columns of `added`: words, words of the source, words the mix wants of it, and how often it takes the row."""
    size, source_size, target, taken = added(docs)
    text, source = text_of(text_col), F.col(f"`{source_col}`").cast("string")
    own, end, chosen = unused(docs, "__own", "__end", "__chosen")
    #: What decides about a row, and the end of its source's sample, as one column each.
    values = F.struct(
        sampling_key(F.col(f"`{id_col}`"), weight(text), seed).alias("key"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("tie"), words(text).alias("size"),
    )
    whole = docs.withColumn(own, values)
    rows = stored(docs.select(source.alias("source"), values.alias("v")).select("source", "v.*"), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    ends = stored(cutoffs(rows, goals), "cutoffs")
    joined = whole.join(small_or_shuffled(ends.select(F.struct(*ends.columns).alias(end)), MOST_SOURCES), source.eqNullSafe(F.col(end)["source"]))
    of = lambda c: F.col(end)[c]
    within = F.coalesce(F.when(of("within"), F.col(own) <= of("cut")).otherwise(F.col(own) < of("cut")), F.lit(False))
    if not ends.filter("taken < tied").isEmpty():
        #: Only rows of one id and text that the cut-off splits are counted; the sample takes the first of them by all their columns.
        split = F.coalesce((F.col(own) == of("cut")) & (of("taken") < of("tied")), F.lit(False))
        kinds = dict(docs.dtypes)
        order = [F.col(f"`{c}`") for c in docs.columns if "map<" not in kinds[c] and kinds[c] != "variant"]
        nth = F.row_number().over(Window.partitionBy(of("source")).orderBy(*order))
        counted = joined.filter(split).withColumn(chosen, nth <= of("taken"))
        joined = joined.filter(~split).withColumn(chosen, within).unionByName(counted)
    else:
        joined = joined.withColumn(chosen, within)
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(own)["size"].alias(size), of("source_size").alias(source_size), of("target").alias(target),
        (of("epochs") + F.col(chosen).cast("long")).alias(taken),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    times = added(docs)[3]
    taken = copies(docs, id_col, text_col, source_col, **options).filter(F.col(times) > 0)
    again = F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], again.alias(times)).drop(times)
