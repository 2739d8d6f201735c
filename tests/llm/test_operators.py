"""Corpus operators against brute force, round trips and held-out accuracy, with the awkward rows of small tables."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stellwerk.llm import bag_minhash, chat_format, exact_dedup, language_id, line_dedup, mixing, packing, quality_gam, quality_rules, textarrays, toxicity
from stellwerk.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, hash int, rank int, score double"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = [f"word{i}" for i in range(60)]
NEAR = [*BASE[:30], "changed", *BASE[31:]]
ODD = [
    (1, "a  b\tc", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, LONG, "en", "s1"), (6, " ".join(BASE), "en", "s1"),
    (7, " ".join(NEAR), "de", "s2"), (7, " ".join(NEAR), "de", "s2"), (None, "no id at all here", "en", None), (8, "one", "en", "s3"), (9, "\n\n", "en", "s3"), (10, " ".join(BASE), "en", "s3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, 0, 0.0) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter(tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1))))


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def test_exact_classes(odd, empty):
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(odd).collect()}
    assert found[1] == (1, 2, True) and found[2] == (1, 2, False)
    assert found[3] == (3, 2, True) and found[4] == (3, 2, False)
    assert found[7] == (7, 2, True) and found[None] == (None, 1, True)
    assert found[6] == (6, 2, True) and found[10] == (6, 2, False)
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 7").count() == 1 and kept.count() == 8
    assert exact_dedup.classes(empty).count() == 0


def test_collisions_are_told_apart(odd):
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.classes(odd, hash_of=lambda text: F.unhex(F.lit("00"))).collect()}
    assert found[1] == (1, 2) and found[2] == (1, 2) and found[4] == (3, 2) and found[10] == (6, 2) and found[8] == (8, 1)


def test_near_duplicates_match_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    own = {r.doc_id: shingles(r.text) for r in rows}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and jaccard(own[a], own[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r.doc_id: r.cluster_id for r in bag_minhash.near_duplicates(docs).collect()}
    assert found == {i: root(i) for i in ids}


def test_near_duplicates_in_large_buckets(spark):
    """A family whose members are often near each other but not near its hub: whole buckets must be compared."""
    rng = np.random.default_rng(7)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(texts[rng.integers(len(texts))]) if i % 3 == 2 else list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(words)
    own = [shingles(" ".join(w)) for w in texts]
    parent = list(range(len(own)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            if root(a) != root(b) and jaccard(own[a], own[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.cluster_id for r in bag_minhash.near_duplicates(rows).collect()}
    assert len(set(found.values())) > 10 and found == {i: root(i) for i in range(len(own))}


def test_block_links_span_all_components():
    words = [" ".join(BASE), " ".join(NEAR), " ".join(f"other{i}" for i in range(60)), " ".join([*BASE[:50], *"abcdefghij"]), None]
    block = pa.table({"id": pa.array([4, 2, 9, 7, 11]), "component": pa.array([4, 2, 9, 7, 11]), "hub": [True, False, False, False, False], "norm": words})
    assert bag_minhash._block_links(block, 5, 0.8).to_pylist() == [{"a": 2, "b": 4}]
    assert bag_minhash._block_links(block, 5, 0.5).to_pylist() == [{"a": 2, "b": 4}, {"a": 4, "b": 7}]
    assert bag_minhash._block_links(block.slice(1), 5, 0.5).num_rows == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    found = {r.doc_id: r.cluster_id for r in bag_minhash.near_duplicates(odd).collect()}
    assert jaccard(shingles(ODD[5][1]), shingles(ODD[6][1])) >= 0.8
    assert found[6] == found[7] == found[10] == 6 and found[3] == found[4] == found[9] == 3 and found[5] == 5
    kept = bag_minhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 8]
    assert bag_minhash.near_duplicates(empty).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    key = textarrays.mixed(np.arange(50, dtype=np.uint64))
    both = bag_minhash.signatures(2, np.repeat([0, 1], 50), np.tile(key, 2), np.concatenate([a, b]), 40_000)
    assert (both[0] == both[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.012)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[103] == found[101] == found[100] == 100


def test_mixing(docs, odd, empty):
    rows = mixing.copies(docs).select("source", "__size", "__source_size", "__target", "__copies").collect()
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["__copies"] <= 2
        taken[r.source] += r["__copies"] * r["__size"]
    longest = max(r["__size"] for r in rows)
    for r in rows:
        assert abs(taken[r.source] - r["__target"]) <= longest / 2 + 1e-6 and r["__target"] <= 2 * r["__source_size"]
    assert sum({r.source: r["__target"] for r in rows}.values()) == pytest.approx(1.5 * sum(r["__size"] for r in rows))
    assert mixing.copies(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_packing(odd, empty):
    exact = packing.encoder(packing.vocabulary()).exact
    rows = packing.pack(odd, with_ids=True).collect()
    places = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    for doc_id, text in {r[0]: r[1] for r in ODD if r[0] != 7}.items():
        ids = [t for r in sorted(by_doc[doc_id], key=lambda r: r.piece) for t in r.ids]
        assert ids == [*exact.encode(text or "", add_special_tokens=False).ids, 0]
    assert len(by_doc[7]) == 2 and packing.pack(empty).count() == 0


def test_encoder_matches_the_library():
    own = packing.encoder(packing.vocabulary())
    texts = ["It's  a\n\n test…\t'll", "naïve Ünï ß 12½ ٣٤ 你好   x\x85y \x1c z", "<|endoftext|> end", "a" * 5000, "   b", "Ǆ ĳ ŉ ª º"]
    for text in texts:
        assert own.ids(text).tolist() == own.exact.encode(text, add_special_tokens=False).ids
    for c in [*range(32, 0x250), *range(0x2010, 0x2028), 0x20AC]:
        text = f"a{chr(c)}b {chr(c)} 1{chr(c)}"
        assert own.ids(text).tolist() == own.exact.encode(text, add_special_tokens=False).ids


def test_plan_holds_every_piece_near_the_bound():
    counts = np.zeros(2049, int)
    np.add.at(counts, np.clip(np.random.default_rng(0).lognormal(6, 0.8, 5000).astype(int), 1, 2047), 1)
    held = np.zeros(2049, int)
    plan = packing.plan(counts)
    for n, shape in plan:
        assert sum(shape) <= 2048
        for size in shape:
            held[size] += n
    assert (held == counts).all()
    assert sum(n for n, _ in plan) <= 1.01 * -(-(counts * np.arange(2049)).sum() // 2048)


def test_language_id(docs, odd, empty):
    model = language_id.train(docs, language_id.learned())
    rows = language_id.identified(docs, model).filter(~language_id.learned()).collect()
    assert np.mean([r.lang == r["__lang_pred"] for r in rows]) >= 0.95
    found = {r.doc_id: r for r in language_id.identified(odd, model).collect()}
    assert found[3]["__lang_pred"] == found[4]["__lang_pred"] == found[9]["__lang_pred"] == "und" and found[3]["__rejected"]
    assert language_id.train(empty, F.lit(True)) is None
    assert language_id.accepted(empty, F.lit(True)).columns == empty.columns


def test_quality_rules(docs, odd, empty):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.rules(docs).collect():
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]), [x for x in text[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text[r.doc_id])), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)
    found = {r.doc_id: r for r in quality_rules.rules(odd).collect()}
    assert found[3].n_words == 0 and found[3].base_failed and found[5].n_words == 30_000
    assert quality_rules.rules(empty).count() == 0


def test_classifiers_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for table, n in ((odd, len(ODD)), (empty, 0)):
        for own in (labels, none):
            features = quality_gam.measured(table)
            assert quality_gam.scored(features, quality_gam.train(features, own)).filter("score between 0 and 1").count() == n
            assert toxicity.scored(*toxicity.train(table, own)).filter("score between 0 and 1").count() == n


def test_toxic_words_in_disguise():
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    texts = pa.array(["you are an idiot", "you are an 1d10t!", "a fine day, isn't it?", None])
    hits = toxicity.features(texts, lexicon)[:, toxicity.FEATURES.index("fixed_hits")]
    assert (hits > 0).tolist() == [True, True, False, False]


def test_isotonic():
    levels, values = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([0, 1, 2, 3, 4], levels, values).tolist() == [0, 0.5, 0.5, 1, 1]


def test_line_dedup(spark, empty):
    rows = [(k, f"own line {k}\n shared line \n\nlast", f"s{k}") for k in range(5)] + [(9, None, None), (10, "", "s1"), (11, "shared line\nrare", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r["__clean"], r["__lines"], r["__removed"]) for r in line_dedup.cleaned(docs).collect()}
    assert found[0] == ("own line 0\n", 4, 2) and found[11] == ("rare", 2, 1) and found[9] == ("", 1, 0)
    assert line_dedup.cleaned(docs, sites=6).agg(F.sum("__removed")).first()[0] == 0
    assert line_dedup.cleaned(empty).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, None, None), (5, 0, "user", "ho"), (None, 0, "user", "x"), (5, 0, "user", "ho")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {r.conv_id: (r.n_turns, r.kept) for r in chat_format.collapsed(turns).collect()}
    assert found == {1: (1, False), 2: (2, True), 3: (2, False), 4: (1, True), 5: (1, True)}
    text = {r.conv_id: r.text for r in chat_format.formatted(turns).collect()}
    assert text[2] == "<|user|>\nhi\n<|assistant|>\nyes\n" and chat_format.collapsed(turns.limit(0)).count() == 0
