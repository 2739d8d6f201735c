"""Scores of predicted quantiles and transfer chances, in one pass over the scored rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.checkpoints import kept
from stellwerk.functions.risk import pinball
from stellwerk.schema import DRAWS, QCOLS, QUANTILES


def scored_rows(rows: DataFrame, target: str = "delay") -> DataFrame:
    """Rows with a known target and a prediction, with their losses."""
    losses = {f"loss_{c}": pinball(F.col(target), F.col(c), q) for c, q in zip(QCOLS, QUANTILES, strict=True)}
    out = rows.filter(F.col(target).isNotNull() & F.col("q50").isNotNull()).withColumns(losses)
    return out.withColumn("loss", (F.col("loss_q50") + F.col("loss_q80") + F.col("loss_q95")) / 3)


def _weighted(value: Column) -> Column:
    """Sum of value times weight by the sum of weights; rows without a value still weigh."""
    return F.sum(value * F.col("weight")) / F.sum("weight")


def score_columns(target: str = "delay") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *[_weighted(F.col(f"loss_{c}")).alias(f"pinball_{c}") for c in QCOLS],
        _weighted(F.col("loss")).alias("pinball"),
        _weighted(F.abs(F.col(target) - F.col("q50"))).alias("mae"),
        *[_weighted((F.col(target) <= F.col(c)).cast("double")).alias(f"coverage_{c}") for c in QCOLS],
    ]


def scores(scored: DataFrame, *by: str, target: str = "delay") -> DataFrame:
    return scored.groupBy(*by).agg(*score_columns(target))


def score_report(scored: DataFrame, target: str = "delay") -> DataFrame:
    """Scores by method, by method and case, and by method and train group, with one grouping-sets aggregate."""
    sets = [["model", "method"], ["model", "case", "method"], ["model", "group", "method"]]
    out = scored.groupingSets([[F.col(c) for c in s] for s in sets], "model", "method", "case", "group")
    return out.agg(*score_columns(target))


def methods_of(results: DataFrame, methods: list[str], key: str = "request_id") -> DataFrame:
    """key, has, n: which of the methods have results for a key, as a bitmap (bit k for the k-th), and how many rows it has."""
    bits = F.create_map(*[x for k, m in enumerate(methods) for x in (F.lit(m), F.lit(2**k).cast("long"))])
    has = F.bit_or(F.coalesce(F.try_element_at(bits, F.col("method")), F.lit(0)))
    return results.groupBy(key).agg(has.alias("has"), F.count(F.lit(1)).alias("n"))


def shared_keys(results: DataFrame, methods: list[str], key: str = "request_id") -> DataFrame:
    """key, n of the keys that every one of the methods has scored (relational division); one shuffle."""
    return methods_of(results, methods, key).filter(F.col("has") == 2 ** len(methods) - 1).select(key, "n")


def loss_pivot(scored: DataFrame, methods: list[str], *keys: str) -> DataFrame:
    """One row per scored event with a loss column for each method."""
    return scored.groupBy(*keys).pivot("method", methods).agg(F.first("loss"))


#: Keys of a bucket, on average, within which draws are dealt out to single keys.
BUCKET_KEYS = 256


def resampled(splits: np.ndarray, total: int, keys: int, bucket: int, draws: int, seed: int) -> np.ndarray:
    """How often each of a bucket's keys is in each draw (draws by keys), of draws of `total` keys with replacement.

    splits: for each level of the tree of hash ranges above the bucket, the keys of its node and those of the node's lower
    half. A node gives its lower half a binomial number of what it has; nodes are drawn alike wherever they are drawn, so
    all buckets agree without meeting, and every draw has exactly `total` keys.
    """
    left, depth = np.full(draws, total, np.int64), len(splits)
    for level, (node_keys, lower_keys) in enumerate(splits):
        node = bucket >> (depth - level)
        lower = np.random.default_rng([seed, level, node]).binomial(left, lower_keys / node_keys)
        left = lower if (bucket >> (depth - level - 1)) % 2 == 0 else left - lower
    return np.random.default_rng([seed, depth, bucket]).multinomial(left, np.full(keys, 1 / keys))


def _splits(per_key: DataFrame, depth: int) -> DataFrame:
    """s_bucket, splits: for each bucket the numbers of keys of the nodes above it and of their lower halves, from the root on."""
    sizes = per_key.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    above = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.struct(k.alias("level"), F.floor(F.col("bucket") / F.pow(F.lit(2), F.lit(depth) - k)).cast("long").alias("node")))
    nodes = sizes.select("n", F.explode(above).alias("a")).groupBy("a.level", "a.node").agg(F.sum("n").alias("n"))
    lower = nodes.filter("node % 2 = 0 and level > 0").select((F.col("level") - 1).alias("l_level"), F.expr("node div 2").alias("l_node"), F.col("n").alias("lower"))
    halves = nodes.join(lower, (F.col("level") == F.col("l_level")) & (F.col("node") == F.col("l_node")), "left").select("level", "node", "n", F.coalesce("lower", F.lit(0)).alias("lower"))
    paths = sizes.select(F.col("bucket").alias("s_bucket"), F.explode(F.slice(above, 1, depth)).alias("a")) if depth else None
    if paths is None:
        return sizes.select(F.col("bucket").alias("s_bucket"), F.array().cast("array<struct<level:int,n:bigint,lower:bigint>>").alias("splits"))
    met = paths.join(halves, (F.col("a.level") == F.col("level")) & (F.col("a.node") == F.col("node")))
    return met.groupBy("s_bucket").agg(F.sort_array(F.collect_list(F.struct("level", "n", "lower"))).alias("splits"))


def bootstrap_difference(losses: DataFrame, method: str, reference: str, key: str = "request_id", draws: int = DRAWS, seed: int = 0, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Mean difference of losses of two methods with its 95 % interval, resampling keys with replacement.

    A draw has exactly as many keys as there are, dealt down a tree of ranges of the keys' hashes to buckets and there to
    keys (see `resampled`). Keys are summed first, a bucket returns one row a draw, and no index of all keys is made.
    """
    hashed = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    per_key = kept(losses.groupBy(key).agg(F.sum(F.col(method) - F.col(reference)).alias("d"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("h", hashed))
    total = per_key.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / bucket_keys)))
    per_key = per_key.select(F.col(key).cast("string").alias("key"), "d", "n", "h", F.shiftrightunsigned("h", 64 - depth).alias("bucket") if depth else F.lit(0).cast("long").alias("bucket"))

    def drawn(keys: pd.DataFrame, splits: pd.DataFrame) -> pd.DataFrame:
        keys = keys.sort_values(["h", "key"])
        path = np.array([(x["n"], x["lower"]) for x in splits["splits"].iloc[0]], np.int64).reshape(-1, 2)
        times = resampled(path, total, len(keys), int(keys["bucket"].iloc[0]), draws, seed)
        return pd.DataFrame({"draw": np.arange(draws), "d": times @ keys["d"].to_numpy(), "n": times @ keys["n"].to_numpy()})

    sums = per_key.groupBy("bucket").cogroup(_splits(per_key, depth).groupBy("s_bucket")).applyInPandas(drawn, "draw long, d double, n double")
    means = sums.groupBy("draw").agg((F.sum("d") / F.sum("n")).alias("mean"))
    interval = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("i"))
    point = per_key.agg((F.sum("d") / F.sum("n")).alias("difference"), F.count(F.lit(1)).alias("keys"))
    return point.crossJoin(interval).select("difference", "keys", F.col("i")[0].alias("low"), F.col("i")[1].alias("high"))


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, standard deviation (of a sample), least, quartiles and most of the values that are not null."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), quartiles.alias("q"), F.max(value).alias("most"))
    return out.select(*by, "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "least", *[F.col("q")[k].alias(f"p{25 * k + 25}") for k in range(3)], "most")


def brier(changes: DataFrame) -> DataFrame:
    """By method: number and mean squared difference of the chance and what happened."""
    return changes.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("held").cast("double"), 2)).alias("brier"))


def calibration(changes: DataFrame) -> DataFrame:
    """By method and level: number, mean chance, share held, share of the method's transfers."""
    out = changes.groupBy("method", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("held").cast("double")).alias("mean_held"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("method")))
