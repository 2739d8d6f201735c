"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are the 2- and 3-byte grams inside words (with their borders) and the words themselves, hashed
to 16,384 buckets. A text is the average of its subwords' embeddings over the whole text. Embeddings and
softmax are trained by stochastic gradient descent in numpy on a bounded sample of the labelled
documents: at most `sample` of them, dealt evenly over the languages by a hash of the id. A fifth of the
sample is held back to fit a temperature and the score below which a text is rejected.

The two linear layers are multiplied once, so a subword is one table row; scoring is a map over the
documents with numpy in each task and shuffles nothing.

Defined results: null text and text without a letter are `und` with score 0 and rejected; rows with a
null lang are scored but never learned from; without any labelled row all texts are `und`; a null id
is carried; repeated rows get the same result; empty tables give empty results; extra columns are
never read, and `identified` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from stellwerk.llm.common import fold_of, small_or_shuffled, stored, unused
from stellwerk.llm.textarrays import LETTERS, U, Bytes, mixed, slices

BUCKET_BITS, WIDTH, SAMPLE, EPOCHS = 14, 16, 2000, 6
#: Languages up to this number are broadcast with their counts; beyond it, the join shuffles.
MOST_LANGS = 10_000
UND = "und"
#: Share of rightly labelled held-back documents that may score below the rejection level, and its highest value.
REJECTED, HIGHEST = 0.001, 0.5


def subwords(text: Bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and position of every subword."""
    d = np.where(LETTERS[text.data], text.data, np.uint8(32)).astype(U)
    on = d != 32
    shift = U(64 - BUCKET_BITS)
    border = np.zeros(len(d) + 1, bool)
    border[text.offsets] = True
    out, where = [], []
    if len(d) > 1:
        pair = (on[1:] | on[:-1]) & ~border[1 : len(d)]
        h = mixed(d[:-1] * U(257) + d[1:])
        at = np.flatnonzero(pair)
        out.append(h[at])
        where.append(at)
    if len(d) > 2:
        three = on[1:-1] & ~border[1 : len(d) - 1] & ~border[2 : len(d)]
        at = np.flatnonzero(three)
        out.append(mixed((d[at] * U(257) + d[at + 1]) * U(257) + d[at + 2] + U(1 << 40)))
        where.append(at)
    starts, ends, _ = text.words(LETTERS)
    out.append(text.hashes(starts, ends))
    where.append(starts)
    return (np.concatenate(out) >> shift).astype(np.int64), np.concatenate(where)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    level: float

    def scores(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities from the sums of the table's rows over a text's subwords."""
        return softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lowered(texts: pa.Array) -> Bytes:
    return Bytes(pc.utf8_lower(pc.cast(texts, pa.large_string())))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts for each labelled document."""
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, _ = subwords(_lowered(batch.column(1).slice(i, 1)))
            found, n = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found.astype(np.int32)]), pa.array([n.astype(np.int32)])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 7) -> Model | None:
    """A model from at most about `sample` of the rows for which learn holds, of the languages in it."""
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    rows = docs.filter(learn & lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"))
    counts = stored(rows.groupBy(F.col("lang").alias("c_lang")).agg(F.count(F.lit(1)).alias("n")), "languages")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**40)) + 1) / float(2**40)
    keyed = rows.join(small_or_shuffled(counts, MOST_LANGS), F.col("lang") == F.col("c_lang")).withColumn("key", u * F.col("n"))
    last = keyed.select("key").orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if last is None:
        return None
    found = keyed.filter(F.col("key") <= last).select("lang", "text").mapInArrow(_bags, "lang string, bucket array<int>, n array<int>").toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    bags = [(langs.index(b["lang"].as_py()), np.asarray(b["bucket"].values, np.int64), np.asarray(b["n"].values, float)) for t in found.to_batches() for b in _rows(t)]
    bags = sorted((b for b in bags if len(b[1])), key=lambda b: (b[0], b[2].sum(), b[1].sum()))
    return _fit(langs, bags, seed) if bags else None


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(batch.num_rows):
        yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _fit(langs: list[str], bags: list, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held = {int(i) for i in order[: len(bags) // 5]} if len(bags) >= 50 else set()
    learn = [i for i in order if int(i) not in held]
    emb = rng.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
    out = np.zeros((WIDTH, len(langs)))
    bias = np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = 2.0 * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            y, b, n = bags[i]
            w = n / n.sum()
            h = w @ emb[b]
            g = softmax((h @ out + bias)[None])[0]
            g[y] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            emb[b] -= rate * np.minimum(1.0, 20 * w)[:, None] * back
    table = (emb @ out).astype(np.float32)
    model = Model(langs, table, bias, 1.0, HIGHEST)
    check = [bags[i] for i in (held or learn)]
    raw = np.array([(n / n.sum()) @ table[b] + bias for _, b, n in check])
    truth = np.array([y for y, _, _ in check])
    loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(raw / model.temperature)
    right = p.argmax(axis=1) == truth
    model.level = float(min(HIGHEST, np.quantile(p.max(axis=1)[right], REJECTED))) if right.any() else HIGHEST
    return model


def predict(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    langs, scores, rejected = [], [], []
    for a, b in slices(texts, 1 << 18):
        text = _lowered(texts.slice(a, b - a))
        letters = text.per_doc(LETTERS[text.data]) > 0
        if letters.any():
            none = np.asarray(pc.match_substring_regex(texts.slice(a, b - a), r"\p{L}").fill_null(False))
            letters &= none
        p = np.zeros((text.docs, 1))
        if model is not None:
            bucket, at = subwords(text)
            doc = np.searchsorted(text.offsets, at, side="right") - 1
            n = np.bincount(doc, minlength=text.docs)
            p = model.scores(np.stack([np.bincount(doc, weights=column[bucket], minlength=text.docs) for column in model.table.T], axis=1), n)
        known = letters & (model is not None)
        best = p.argmax(axis=1)
        langs += [model.langs[k] if ok else UND for k, ok in zip(best, known, strict=True)]
        score = np.where(known, p.max(axis=1), 0.0)
        scores.append(score)
        rejected.append(~known | (score < (model.level if model is not None else 1.0)))
    return langs, np.concatenate(scores or [np.zeros(0)]), np.concatenate(rejected or [np.zeros(0, bool)])


def added(docs: DataFrame) -> list[str]:
    """Names of what `identified` adds: __lang_pred, __score and __rejected, with more underscores where docs has such columns."""
    return unused(docs, "__lang_pred", "__score", "__rejected")


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with the columns of `added`: language, score, and whether the text is rejected."""
    names = added(docs)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType()), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, rejected = predict(pc.cast(batch.column(at), pa.string()), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    found = identified(docs, train(docs, learn, id_col, text_col, lang_col), text_col)
    return found.filter(~F.col(added(docs)[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def learned(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: three of four, by crc32 of the id."""
    return F.coalesce(fold_of(F.col(id_col), 4) != 2, F.lit(True))
