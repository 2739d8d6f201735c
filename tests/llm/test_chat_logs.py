"""Snapshot logs made by growing, forking, repeating and cutting conversations, collapsed as a plain comparison of all of them does."""

import random

import pytest

from stellwerk.llm import chat_format


def logs(seed, n):
    """Snapshots of conversations: some go on from a snapshot, some leave it at an earlier turn, some repeat it whole."""
    r = random.Random(seed)
    seen, rows = [], []
    for conv in range(n):
        way = r.random()
        base = list(r.choice(seen)) if seen and way < 0.75 else []
        if 0.45 <= way < 0.6:
            base = base[: r.randint(0, len(base))]
        if way >= 0.15:
            base += [(r.choice(["user", "assistant", None]), r.choice(["yes", "no", "", None, "a longer text"])) for _ in range(r.choice([1, 1, 2, 4]))]
        base = base or [("user", "hello")]
        seen.append(base)
        start = r.choice([0, 0, 1, 5])
        own = [(conv, start + k, role, text) for k, (role, text) in enumerate(base)]
        rows += own + ([r.choice(own)] if r.random() < 0.1 else [])
    r.shuffle(rows)
    return rows


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, set()).add((turn, role or "", text or ""))
    said = {conv: tuple(x[1:] for x in sorted(t)) for conv, t in turns.items()}
    longer = {s[:k] for s in set(said.values()) for k in range(1, len(s))}
    first = {}
    for conv in sorted(said):
        first.setdefault(said[conv], conv)
    return {conv: (len(s), s not in longer and first[s] == conv) for conv, s in said.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_logs(spark, seed):
    rows = logs(seed, 400)
    want = plain(rows)
    kept = sum(k for _, k in want.values())
    assert 50 < kept < 350
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    assert {r.conv_id: (r.n_turns, r.kept) for r in chat_format.collapsed(turns).collect()} == want
