"""Quality classifier: a generalised additive model with pairwise interactions.

Eighteen measures of each whole text are taken in the tasks (numpy over byte arrays, no loop over words)
and written once. On a bounded sample of labelled documents the measures are cut into quantile bins and
shallow trees are boosted in cycles, one measure at a time, each tree adding to that measure's lookup
table; the pairs of measures that explain most of what is left get two-dimensional tables in the same
way. A score is the logistic of the sum of the looked-up values, in one vectorised pass per batch.

Defined results: null text counts as empty; an empty text has all measures 0 and is scored like any
other; without labels of both kinds every score is the share of label 1 (0.5 without labels); a null id
is carried and never learned from; of texts that share a labelled id the one with the least measures is
learned from; repeated rows get the same score; empty tables give empty results;
extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import stored
from stellwerk.llm.labelled import one_each, sampled
from stellwerk.llm.textarrays import LETTERS, SPACES, Bytes, counted, shingles, slices

SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAVES = 20_000, 32, 8, 6, 120, 0.1, 3
MEASURES = (
    "log_words", "word_bytes", "upper", "symbols", "exclamations", "bars", "digits", "stops", "commas", "distinct_words",
    "repeated_next", "capital_words", "repeated_lines", "line_words", "repeated_shingles", "longest_word", "letters", "short_words",
)


def _of(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


UPPER, LOWER, DIGITS = _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("abcdefghijklmnopqrstuvwxyz"), _of("0123456789")
SYMBOLS, STOPS, COMMAS, BARS, EXCLAMATIONS = _of("#*$%&|<>"), _of(".?"), _of(",;:"), _of("|"), _of("!")
LINES = np.ones(256, bool)
LINES[10] = False


def measures(text: Bytes) -> np.ndarray:
    """One row of MEASURES for each document."""
    n = text.docs
    per = lambda table: text.per_doc(table[text.data]).astype(float)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    starts, ends, doc = text.words(~SPACES)
    words = np.bincount(doc, minlength=n).astype(float)
    hashes, length = text.hashes(starts, ends), ends - starts
    upper_sum = np.concatenate([[0], np.cumsum(UPPER[text.data])])
    letter_sum = np.concatenate([[0], np.cumsum(LETTERS[text.data])])
    capital = (letter_sum[ends] - letter_sum[starts] >= 2) & (upper_sum[ends] - upper_sum[starts] == letter_sum[ends] - letter_sum[starts])
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (hashes[1:] == hashes[:-1])
    by = lambda mask: np.bincount(doc[mask], minlength=n).astype(float)
    distinct = np.bincount(counted(doc, hashes)[0], minlength=n)
    l_starts, l_ends, l_doc = text.words(LINES)
    lines = np.bincount(l_doc, minlength=n).astype(float)
    distinct_lines = np.bincount(counted(l_doc, text.hashes(l_starts, l_ends))[0], minlength=n)
    s_doc, _, s_count = shingles(text)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    size, letters = np.diff(text.offsets).astype(float), per(LETTERS)
    return np.stack(
        [
            np.log1p(words), share(np.bincount(doc, weights=length, minlength=n), words), share(per(UPPER), letters), share(per(SYMBOLS), size),
            share(per(EXCLAMATIONS), size), share(per(BARS), size), share(per(DIGITS), size), share(per(STOPS), words), share(per(COMMAS), words),
            share(distinct, words), share(by(again), words), share(by(capital), words), share(lines - distinct_lines, lines), share(words, lines),
            share(np.bincount(s_doc, weights=s_count - 1, minlength=n), words), np.log1p(longest), share(letters, size), share(by(length <= 3), words),
        ],
        axis=1,
    ).astype(np.float32)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1)):
            x = measures(Bytes(batch.column(1).slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c) for c in x.T]], names=["doc_id", *MEASURES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measures of each row of docs, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} float" for m in MEASURES)), "measures")


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Up to bins - 1 cut points for each column, at quantiles of its distinct values."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Step values over ordered bins: the best cuts, one after the other, of sums of gradients and curvatures."""
    edges, gain_of = [0, len(g)], lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    for _ in range(leaves - 1):
        best = max(((gain_of(a, m) + gain_of(m, b) - gain_of(a, b), m) for a, b in zip(edges, edges[1:], strict=False) for m in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-dimensional table into four, with its gain."""
    cg, ch = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1), np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    a, b = g.shape
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, a):
        for j in range(1, b):
            box = [(0, i, 0, j), (0, i, j, b), (i, a, 0, j), (i, a, j, b)]
            s = [(cg[y, v] - cg[x, v] - cg[y, u] + cg[x, u], ch[y, v] - ch[x, v] - ch[y, u] + ch[x, u]) for x, y, u, v in box]
            gain = sum(p * p / (q + 1.0) for p, q in s)
            if gain > best + 1e-9:
                best, out = gain, np.zeros_like(g)
                for (x, y, u, v), (p, q) in zip(box, s, strict=True):
                    out[x:y, u:v] = p / (q + 1.0)
    return best, out


@dataclass
class Additive:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.cuts:
            b = binned(x, self.cuts)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            c = binned(x, self.pair_cuts)
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[c[:, i], c[:, j]]
        return sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Additive:
    """Boosts in cycles over the measures, then over the strongest pairs."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Additive(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    x = x.astype(float)
    model.cuts, model.pair_cuts = cuts_of(x, BINS), cuts_of(x, PAIR_BINS)
    b, c = binned(x, model.cuts), binned(x, model.pair_cuts)
    model.tables = [np.zeros(len(k) + 1) for k in model.cuts]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = sigmoid(z)
            step = RATE * _tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), LEAVES)
            t += step
            z += step[b[:, j]]
    sums = lambda i, j, v, shape: np.bincount(c[:, i] * shape[1] + c[:, j], v, shape[0] * shape[1]).reshape(shape)
    shape = lambda i, j: (len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)
    p = sigmoid(z)
    gains = [(_quadrants(sums(i, j, y - p, shape(i, j)), sums(i, j, p * (1 - p), shape(i, j)))[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 0]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            p = sigmoid(z)
            step = RATE * _quadrants(sums(i, j, y - p, t.shape), sums(i, j, p * (1 - p), t.shape))[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def train(features: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Additive:
    """A model from at most `sample` labelled documents."""
    rows = one_each(features, sampled(labels, label, sample), MEASURES).drop("doc_id").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable").to_numpy(dtype=float)
    return fit(rows[:, 1:], rows[:, 0])


def scored(features: DataFrame, model: Additive) -> DataFrame:
    """doc_id and score for each row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(batch.schema.get_field_index(m)), dtype=float) for m in MEASURES], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(model.score(x))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")
