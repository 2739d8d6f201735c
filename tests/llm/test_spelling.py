"""Spelling variants against plain Python: the words, near words, forms and roots, with cold and hot starts."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from stellwerk.llm import spelling
from stellwerk.llm.acceptors import near_pairs

SF = "/root/testdata/sf0.001"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def plain_words(docs, every=31):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(n):
    def near(w):
        cut = {w[:k] + w[k + 1 :] for k in range(len(w))}
        changed = {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in LETTERS}
        grown = {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in LETTERS}
        return [x for x in (cut | changed | grown) - {w} if x in n]

    around = {w: near(w) for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def same_start(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(24))
def test_composition(seed):
    r = random.Random(seed)
    made = {"".join(r.choice("ab" if seed % 2 else "abc") for _ in range(r.randint(1, 7))).encode() for _ in range(r.randint(1, 80))}
    words = sorted(made)
    for least in (0, 2):
        i, j = near_pairs(words, np.full(len(words), least))
        want = [(x, y) for x, y in itertools.combinations(range(len(words)), 2) if one_edit(words[x], words[y]) and same_start(words[x], words[y]) >= least]
        assert sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("bin_words, hot", [(16_384, 65_536), (300, 50), (2_000, 5)])
def test_documents(spark, bin_words, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert found(spelling.variants(docs, bin_words=bin_words, hot=hot)) == want


def test_dense_words(spark):
    """Words over two letters, most of them near each other, with runs of one letter; every start is hot."""
    r = random.Random(5)
    words = ["".join(r.choice("aab") for _ in range(r.randint(7, 11))) for _ in range(400)]
    rows = [(k, " ".join([w] * r.choice([2, 3, 30, 400]))) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_variants(plain_words(rows))
    assert any(w[1] and w[2] != w[1] for w in want), "a chain of two forms"
    assert found(spelling.variants(docs, bin_words=50, hot=4)) == want


def test_awkward_rows(spark):
    long = "z" * 3_000
    rows = [(1, None), (2, ""), (None, "Straße Straßen Straßen straßen ÉCOLEée ÉCOLEée école"), (None, "Straße"), (3, f"{long} {long}"), (3, f"{long} {long}y"), (3, f"{long}y abc"), (4, "×÷" * 4), (4, "×÷" * 4)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string")
    assert found(spelling.variants(docs)) == plain_variants(plain_words(rows))
    assert found(spelling.variants(docs, every=1)) == plain_variants(plain_words(rows, 1))
    assert found(spelling.variants(docs.limit(0))) == []
