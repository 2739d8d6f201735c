"""Best-fit packing of tokenised documents by the linear grouping scheme.

Texts are tokenised in the tasks, closed with an end token and, if longer than a sequence, cut into
full pieces behind a first, shorter one. From here on only lengths matter, and there are at most as many
as a sequence has tokens: the plan is made on their histogram, so the driver holds a few thousand
numbers however many documents there are.

* Pieces as long as a sequence stand alone.
* Large lengths (above `large` tokens) are sorted and cut into groups of equal cardinality; each is
  rounded up to the largest of its group. How often each configuration of these few sizes is used is the
  linear programme of fewest sequences, solved by column generation: prices of the sizes follow from the
  configurations in use, and the configuration of the greatest price comes in until none is worth more than a
  sequence. Whole uses are taken; what fractions leave, fewer pieces than a few for each size, goes one
  configuration after the other, always the one that fills a sequence best.
* Actual lengths replace the rounded ones, from the longest of a group on.
* The remaining lengths go, in descending order, where they fit best: into the fullest sequences that
  still have room, then into new ones.

The plan is a list of patterns (lengths and how many sequences look like that). Each piece gets its rank
among the pieces of its length and with that its sequence and offset by a range lookup; ranks come from
counts by partition and length of the written table of pieces, in a merge join, as they grow with the input.

Defined results: null text is an empty document, which is its end token alone; repeated rows are
packed as often as they occur; a null id is carried; empty tables give empty results; extra columns
are never read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.llm.common import TEXT_ROWS, stored

LENGTH, END = 2048, 0
#: Tried one after the other; the plan with the fewest sequences is taken. FEW: numbers of groups whose configurations are optimised; with
#: GROUPS they are chosen one after the other, which rounds less with many groups.
LARGE, GROUPS, FEW = (342, 512, 683, 1024), (64, 256), (16, 64)
#: The fast encoder is used for texts of these characters without a long run of non-space; all else goes to `tokenizers`.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]*\Z")
LONG_RUN = 400
_encoders: dict[str, object] = {}


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a byte-level vocabulary file of `tokenizers`, as its own encoder gives them without special tokens.

    Plain texts take a faster encoder with the same merges, built from the same file; texts with other
    characters, with the text of a special token or with very long words take the library's.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        special = {x["content"] for x in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if PLAIN.match(text) and max(map(len, text.split()), default=0) < LONG_RUN and not (self.special and self.special.search(text)):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    """The default vocabulary file, looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, length: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = encoder(path or vocabulary())
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        doc, piece, start, size, crc, held, kept, rows = [], [], [], [], [], 0, [], batch.num_rows
        for i in range(rows):
            ids = np.append(own.ids(texts[i].as_py()), np.uint32(end)).astype("<u4")
            first = len(ids) % length or length
            edges = [0, *range(first, len(ids) + 1, length)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                doc.append(i)
                piece.append(k)
                start.append(a)
                size.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                if with_ids:
                    kept.append(ids[a:b].astype(np.int32))
            held += len(ids)
            if doc and (held > 1 << 20 or i == rows - 1):
                columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                doc, piece, start, size, crc, held, kept = [], [], [], [], [], 0, []


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the documents' pieces."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _cut(it, tokenizer, length, end, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _groups(counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """Ranges (low, high] of lengths, from the longest down, each with about as many pieces."""
    total, out, high, held = counts.sum(), [], len(counts) - 1, 0
    for n in range(len(counts) - 1, -1, -1):
        held += counts[n]
        if held and (held >= total / groups or n == 0):
            out.append((n - 1, high))
            high, held = n - 1, 0
    return out


def _configuration(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size, within what is left, fill the room best: reachable sums, size by size."""
    sums: dict[int, list[tuple[int, int]]] = {0: []}
    for k, size in enumerate(sizes):
        new: dict[int, list[tuple[int, int]]] = {}
        for s, used in sums.items():
            for c in range(1, min(left[k], (room - s) // size) + 1):
                if s + c * size not in sums:
                    new.setdefault(s + c * size, [*used, (k, c)])
        sums |= new
        if room in sums:
            break
    best = max(sums)
    out = [0] * len(sizes)
    for k, c in sums[best]:
        out[k] = c
    return out


def _dearest(sizes: np.ndarray, price: np.ndarray, room: int) -> np.ndarray:
    """How many of each size, within the room, are worth most together: best values by room, one piece more each time."""
    value, steps = np.zeros(room + 1), []
    for _ in range(room // int(sizes.min())):
        more, chosen = value.copy(), np.full(room + 1, -1)
        for k, size in enumerate(sizes):
            with_k = value[: room + 1 - size] + price[k]
            better = with_k > more[size:] + 1e-12
            more[size:][better] = with_k[better]
            chosen[size:][better] = k
        if (chosen < 0).all():
            break
        steps.append(chosen)
        value = more
    out, at = np.zeros(len(sizes)), room
    for chosen in reversed(steps):
        if chosen[at] >= 0:
            out[chosen[at]] += 1
            at -= int(sizes[chosen[at]])
    return out


def configurations(sizes: list[int], demand: list[int], room: int, rounds: int = 500) -> list[tuple[float, list[int]]]:
    """(uses, how many of each size) of the least total that covers the demand, uses being fractions.

    The simplex method on as many configurations as sizes. It is feasible in every round, so `rounds` bounds the time, not what is packed.
    """
    size, want = np.asarray(sizes), np.asarray(demand, dtype=float)
    basis, cost = np.diag((room // size).astype(float)), np.ones(len(size))
    #: Groups of equal cardinality tie; shifted apart, no round stands still.
    apart = want * (1 + 1e-5 * (np.arange(1, len(size) + 1) * 0.618034 % 1))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, cost)
        column = _dearest(size, np.maximum(price, 0), room)
        # a size whose price is below 0 is covered more than it must be; then its surplus comes in
        surplus = int(price.argmin()) if price.min() < -1e-9 else None
        if surplus is not None:
            column, gain = -np.eye(len(size))[surplus], -price[surplus]
        else:
            gain = column @ price - 1
        if gain <= 1e-7:
            break
        uses, change = np.linalg.solve(basis, apart), np.linalg.solve(basis, column)
        ratio = np.full(len(size), np.inf)
        np.divide(np.maximum(uses, 0), change, out=ratio, where=change > 1e-9)
        if not np.isfinite(ratio).any():
            break
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, 1.0 if surplus is None else 0.0
    uses = np.linalg.solve(basis, want)
    return [(float(u), basis[:, i].astype(int).tolist()) for i, u in enumerate(uses) if cost[i]]


Pattern = tuple[int, tuple[int, ...]]


def plan(counts: np.ndarray, length: int = LENGTH, large: tuple[int, ...] = LARGE, groups: tuple[int, ...] = GROUPS, few: tuple[int, ...] = FEW) -> list[Pattern]:
    """The plan with the fewest sequences for any of these bounds of large lengths and numbers of groups."""
    tries = [(min(b, length), g, best) for b in large for best, numbers in ((True, few), (False, groups)) for g in numbers]
    return min((grouped_plan(counts, length, *t) for t in tries), key=lambda p: sum(n for n, _ in p))


def grouped_plan(counts: np.ndarray, length: int, large: int, groups: int, optimised: bool = True) -> list[Pattern]:
    """Patterns (number of sequences, their lengths in order) that hold exactly counts[n] pieces of every length n < length.

    optimised: begin with the whole uses of the linear programme's configurations.

    counts has length + 1 entries; pieces of the full length are not part of the plan.
    """
    counts = counts.astype(np.int64).copy()
    counts[length:] = 0
    upper = counts.copy()
    upper[: large + 1] = 0
    ranges = _groups(upper, groups)
    # the actual lengths of each group as runs (length, number), longest first
    runs = [[[n, int(upper[n])] for n in range(high, low, -1) if upper[n]] for low, high in ranges]
    sizes, left = [r[0][0] for r in runs], [sum(n for _, n in r) for r in runs]
    bins: dict[tuple[int, ...], int] = {}
    chosen = [(int(u + 1e-6), c) for u, c in configurations(sizes, left, length) if u >= 1 - 1e-6] if optimised and left else []
    while any(left):
        if chosen:
            wanted, config = chosen.pop()
        else:
            # the longest size that is left opens the sequence; the rest of it is filled best
            k0 = next(k for k, n in enumerate(left) if n)
            rest = [n - (k == k0) for k, n in enumerate(left)]
            config = _configuration(sizes, rest, length - sizes[k0])
            config[k0] += 1
            wanted = None
        times = min(left[k] // c for k, c in enumerate(config) if c)
        times = times if wanted is None else min(times, wanted)
        slots = [k for k, c in enumerate(config) for _ in range(c)]
        while times:
            # each slot takes the next actual length of its group; a step ends where one of their runs ends
            need: dict[int, int] = {}
            for k in slots:
                need[k] = need.get(k, 0) + 1
            step, shape = times, []
            for k, c in need.items():
                if runs[k][0][1] >= c:
                    step = min(step, runs[k][0][1] // c)
            if all(runs[k][0][1] >= c for k, c in need.items()):
                for k, c in need.items():
                    shape += [runs[k][0][0]] * c
                    _use(runs[k], c * step)
            else:
                step = 1
                for k, c in need.items():
                    for _ in range(c):
                        shape.append(runs[k][0][0])
                        _use(runs[k], 1)
            key = tuple(sorted(shape, reverse=True))
            bins[key] = bins.get(key, 0) + step
            times -= step
            for k, c in need.items():
                left[k] -= c * step
    return _best_fit(bins, counts[: large + 1], length)


def _use(run: list[list[int]], n: int) -> None:
    """Takes n pieces from the front of the runs."""
    while n:
        take = min(n, run[0][1])
        run[0][1] -= take
        n -= take
        if not run[0][1]:
            run.pop(0)


def _best_fit(bins: dict[tuple[int, ...], int], small: np.ndarray, length: int) -> list[Pattern]:
    """Puts small lengths, in descending order, into the sequences with the least room that is enough."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    keys: list[int] = []

    def put(shape: tuple[int, ...], n: int) -> None:
        room = length - sum(shape)
        if room not in rooms:
            rooms[room] = {}
            bisect.insort(keys, room)
        rooms[room][shape] = rooms[room].get(shape, 0) + n

    for shape, n in bins.items():
        put(shape, n)
    for size in range(len(small) - 1, 0, -1):
        left = int(small[size])
        while left:
            at = bisect.bisect_left(keys, size)
            if at == len(keys):
                whole, odd = divmod(left, length // size)
                if whole:
                    put((size,) * (length // size), whole)
                if odd:
                    put((size,) * odd, 1)
                break
            room = keys[at]
            shape, n = next(iter(rooms[room].items()))
            fit = room // size
            times = min(n, left // fit)
            if times:
                each = fit
            else:
                each, times = left, 1
            rooms[room][shape] -= times
            if not rooms[room][shape]:
                del rooms[room][shape]
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(at)
            put(shape + (size,) * each, times)
            left -= each * times
    return [(n, shape) for by in rooms.values() for shape, n in by.items()]


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, each, first sequence, first offset): where the pieces of a length go, by rank."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for n, shape in patterns:
        offset = 0
        for size in sorted(set(shape), reverse=True):
            each = shape.count(size)
            first = next_rank.get(size, 0)
            out.append((size, first, n * each, each, sequence, offset))
            next_rank[size] = first + n * each
            offset += each * size
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces (see `pieces`) with sequence_id and offset."""
    cut = pieces(docs, id_col, text_col, tokenizer, length, end, with_ids)
    rows = stored(cut.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pieces", TEXT_ROWS)
    found = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = stored(found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = np.zeros(length + 1, dtype=np.int64)
    for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        counts[r["length"]] = r["n"]
    places = slots(plan(counts, length))
    sequences = max((s[4] + -(-s[2] // s[3]) for s in places), default=0)
    places.append((length, 0, int(counts[length]), 1, sequences, 0))
    nth = F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1
    ranked = rows.withColumn("nth", nth).join(
        ranks.select(F.col("part").alias("r_part"), F.col("length").alias("r_length"), "before").hint("merge"), (F.col("part") == F.col("r_part")) & (F.col("length") == F.col("r_length"))
    ).withColumn("rank", F.col("before") + F.col("nth"))
    return _placed(ranked, places, length).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def _placed(ranked: DataFrame, places: list[tuple[int, int, int, int, int, int]], length: int) -> DataFrame:
    """Looks up the place of each (length, rank) among the slots; their number is bound by the plan, not by the data."""
    by = np.array(sorted(places), dtype=np.int64)
    first = by[:, 0] * (1 << 48) + by[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "rank"))
            at = np.searchsorted(first, size * (1 << 48) + rank, side="right") - 1
            place = rank - by[at, 1]
            sequence = by[at, 4] + place // by[at, 3]
            offset = by[at, 5] + place % by[at, 3] * size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes) + ", sequence_id long, offset long")
