"""The configurations of linear grouping, and the weights of the mix, against plain computations."""

import bisect
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import bag_minhash, mixing, packing


def best_fit_decreasing(counts, length):
    rooms, n = [], 0
    for size in range(length - 1, 0, -1):
        for _ in range(int(counts[size])):
            at = bisect.bisect_left(rooms, size)
            room = rooms.pop(at) if at < len(rooms) else length
            n += room == length
            bisect.insort(rooms, room - size)
    return n


def test_least_fractional_cover():
    # prices 2/3, 1/3, 1/3 make no configuration dearer than 1, so 6 * 4/3 is the least
    found = packing.configurations([6, 4, 3], [6, 6, 6], 10)
    assert sum(u for u, _ in found) == pytest.approx(8)
    for k in range(3):
        assert sum(u * c[k] for u, c in found) >= 6 - 1e-6
    assert all(np.dot(c, [6, 4, 3]) <= 10 for _, c in found)


@pytest.mark.parametrize("seed", range(8))
def test_cover_equals_the_best_corner_of_prices(seed):
    """The least cover is worth the demand at the best prices by which no configuration is dearer than 1: all corners are tried."""
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.choice(np.arange(15, 70), 4, replace=False).tolist(), reverse=True)
    demand = rng.integers(1, 30, 4)
    configs = [[]]
    for s in sizes:
        configs = [c + [n] for c in configs for n in range(100 // s + 1)]
    configs = [c for c in configs if 100 - min(sizes) < np.dot(c, sizes) <= 100]
    sides = np.array([*configs, *np.eye(4)])
    values = np.array([1.0] * len(configs) + [0.0] * 4)
    picks = np.array(list(itertools.combinations(range(len(sides)), 4)))
    picks = picks[np.abs(np.linalg.det(sides[picks])) > 1e-9]
    corners = np.linalg.solve(sides[picks], values[picks][..., None])[..., 0]
    corners = corners[(corners >= -1e-9).all(axis=1) & (corners @ np.array(configs).T <= 1 + 1e-9).all(axis=1)]
    found = packing.configurations(sizes, demand.tolist(), 100)
    assert sum(u for u, _ in found) == pytest.approx((corners @ demand).max())
    assert all(sum(u * c[k] for u, c in found) >= demand[k] - 1e-6 for k in range(4))


def test_plan_beats_plain_best_fit():
    counts = np.zeros(2049, int)
    np.add.at(counts, np.random.default_rng(0).integers(520, 1000, 5000), 1)
    plan = packing.plan(counts)
    held = np.zeros(2049, int)
    for n, shape in plan:
        assert sum(shape) <= 2048
        for size in shape:
            held[size] += n
    assert (held == counts).all() and sum(n for n, _ in plan) <= 0.96 * best_fit_decreasing(counts, 2048)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_plain_best_fit_at_worst(seed):
    counts = np.zeros(2049, int)
    np.add.at(counts, np.random.default_rng(seed).integers(1, 2048, 40 * 4**seed), 1)
    assert sum(n for n, _ in packing.plan(counts)) <= 1.01 * best_fit_decreasing(counts, 2048) + 1


def weight(text):
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    letters = sum(not (c in " \t\n\x0b\x0c\r" or "!" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~") for c in text)
    every = max(len(text), 1)
    clean = max(0.0, 1 - 3 * max(0.0, max(0, len(text) - letters - n) / every - 0.05))
    return max(0.05, min(1.0, letters / every / 0.75) * clean * (1 if 2 <= letters / max(n, 1) <= 25 else 0.5))


def test_weights(spark):
    texts = ["", "   ", "plain words of an ordinary sentence", "buy now " * 200, "1 2 3 4 5 6", "a b c d e f", "x" * 90, "<<<>>> ### menu | home | about", "tab\tand\x0bline\nends é ü", "don't [stop] `now` {ok} ~ \\ ^_"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.quality(F.col("text")).alias("w")).collect()
    for r in found:
        assert r.w == pytest.approx(weight(r.text)), r.text
    by = {r.text: r.w for r in found}
    assert by[texts[2]] == 1 and by[texts[7]] < 0.5 and by[texts[4]] == by[""] == 0.05


def test_copies_share_a_signature(spark):
    """Copies of a text, in and across batches and among others, all get the keys of the text; empty texts get none."""
    rows = [(i, ["one two three four five six seven", "", f"own words of row {i} and some more"][i % 3]) for i in range(60)] + [(5, None), (5, None)]
    found = bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == 62
    for r in found:
        want = 0 if r.doc_id % 3 == 0 else 1 if r.doc_id % 3 == 1 and r.doc_id != 5 else r.doc_id
        assert r.rep_id == want or r.doc_id == 5 and r.rep_id in (1, 5)
