"""Text batches as byte arrays: words, their hashes and their 5-word shingles without a Python loop over words.

Everything here works on one slice of one Arrow batch inside a task; slices hold about a
megabyte of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random 64-bit value for each byte, an odd base and its inverse modulo 2**64.
BYTE = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters: ASCII letters and all bytes of longer code points.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers modulo 2**64; those beyond KEPT_POWERS, for texts of that size, are not kept."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, KEPT_POWERS), base, dtype=U)
        steps[0] = 1
        kept = np.multiply.accumulate(steps)
        _powers[base] = kept[:KEPT_POWERS].copy() if len(kept) > KEPT_POWERS else kept
    return kept[:n]


def slices(texts: pa.Array, most_bytes: int = 1 << 20, *others: pa.Array, most_docs: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each, and at most so many rows; a longer text is a range of its own.

    others: more columns whose bytes count.
    """
    sizes = sum(np.nan_to_num(np.asarray(pc.binary_length(x).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64) for x in (texts, *others))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most_bytes or i - start == most_docs):
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


class Bytes:
    """The texts' UTF-8 bytes in one array. Null texts are empty."""

    def __init__(self, texts: pa.Array):
        a = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        a = pa.concat_arrays([a])
        _, offsets, data = a.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
        self.offsets = at - at[0]
        n = int(self.offsets[-1])
        self.data = np.frombuffer(data, dtype=np.uint8)[int(at[0]) : int(at[0]) + n] if n else np.zeros(0, np.uint8)
        self.docs = len(a)
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, dtype=U)
            np.cumsum(BYTE[self.data] * powers(BASE, n), out=self._sums[1:])
        return self._sums

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number per byte, by document."""
        total = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document of the longest runs of bytes for which inside holds; none crosses documents."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        on = inside[self.data]
        new = np.zeros(n + 1, bool)
        new[self.offsets] = True
        first = on.copy()
        first[1:] &= ~on[:-1] | new[1:n]
        last = on.copy()
        last[:-1] &= ~on[1:] | new[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, the same wherever the bytes stand."""
        s = self.sums
        raw = (s[ends] - s[starts]) * powers(INVERSE, len(self.data) + 1)[starts]
        return mixed(raw + (ends - starts).astype(U))


#: Odd multipliers for the places in a shingle.
PLACE = mixed(np.arange(101, 117, dtype=U)) | U(1)


def shingles(text: Bytes, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles of so many words: document, 64-bit hash, count, sorted by document and hash.

    A text of fewer words than a shingle, but one at least, is one shingle.
    """
    starts, ends, doc = text.words(SPACES == False)  # noqa: E712
    words = text.hashes(starts, ends)
    n = np.bincount(doc, minlength=text.docs)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(len(words)) - first[doc]
    left = n[doc] - place
    take = (left >= width) | (place == 0)
    at = np.flatnonzero(take)
    total = np.zeros(len(at), dtype=U)
    for k in range(width):
        there = left[at] > k
        total += np.where(there, words[np.minimum(at + k, max(len(words) - 1, 0))], U(k + 1)) * PLACE[k] if len(words) else U(0)
    return counted(doc[at], mixed(total))


def counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) with counts, sorted. Keys keep their upper 44 bits."""
    if not len(doc):
        return doc.astype(np.int64), key, np.zeros(0, np.int64)
    bits = U(20)
    if int(doc[-1]) >> 20:
        raise ValueError("a slice holds more than 2**20 documents")
    both = (doc.astype(U) << (U(64) - bits)) | (key >> bits)
    both.sort()
    new = np.ones(len(both), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    at = np.flatnonzero(new)
    kept = both[at]
    return (kept >> (U(64) - bits)).astype(np.int64), kept << bits, np.diff(np.append(at, len(both)))
