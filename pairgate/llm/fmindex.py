"""Substring dedup by compressed FM-indexes: one per shard, searched backward over a wavelet matrix.

Shards are cut by content, not by document: segments of equal anchors (see ``repeats``) meet in one
shard, so a window is searched in a single shard and never in all of them.  A shard's index is the
Burrows-Wheeler transform of its segments as word numbers, held as a wavelet matrix of packed bits
with counts per 64 (rank in constant time, log2 of the vocabulary in levels).  Segments stream
through it: each is matched backward from an end word, all at once in step; the interval of the
index shrinks until what it stands for occurs only once.  That gives the matching statistic of the
end, the longest string ending there that occurs again, and every interval of at least the
threshold is reported.  Windows inside a reported interval need no search of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from pairgate.llm.repeats import Unit, remove_repeats

THRESHOLD = 35
#: Words of a window's front that are tried first.
FRONT = 4


@dataclass
class Bits:
    """A bit vector with constant-time rank."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, bits: np.ndarray) -> Bits:
        packed = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bool)), bitorder="little").view("<u8")
        return cls(packed, np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class Wavelet:
    """Symbol counts in any prefix of a sequence, a bit level at a time."""

    def __init__(self, sequence: np.ndarray, n_symbols: int) -> None:
        self.height = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in reversed(range(self.height)):
            bit = (sequence >> b) & 1
            self.levels.append(Bits.of(bit.astype(bool)))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        every = np.arange(n_symbols)
        self.first = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.height - 1 - level)) & 1 == 1
            ones = bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._walk(symbol, i) - self.first[symbol]


class Index:
    """The FM-index of segments (arrays of word numbers from 1), each with a count."""

    def __init__(self, segments: list[np.ndarray], counts: np.ndarray, n_symbols: int) -> None:
        sizes = np.array([len(s) for s in segments])
        text = np.concatenate([np.append(s, 0) for s in segments])
        owner = np.repeat(np.arange(len(segments)), sizes + 1)
        order = suffix_order(text, int(sizes.max()) + 1)
        self.below = np.append(0, np.cumsum(np.bincount(text, minlength=n_symbols)))
        self.wavelet = Wavelet(text[order - 1], n_symbols)
        self.size = len(text)
        # Occurrences in the corpus of the suffixes before each place: segments count as often as they occur.
        self.weight = np.append(0, np.cumsum(counts[owner[order]]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with one more symbol in front."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.below[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, as far as ``depth`` symbols decide it."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(0, np.diff(text[order]) != 0))
    length = 1
    while length < depth and rank[order[-1]] < n - 1:
        ahead = np.full(n, 0, np.int64)
        ahead[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        length *= 2
    return order


def matching_intervals(index: Index, segments: list[np.ndarray], queries: np.ndarray, threshold: int) -> list:
    """(query, from, to) of maximal intervals, at least ``threshold`` long, that occur again.

    A query walks over its windows from the last to the first; ``end`` is the last undecided
    window's.  That window is first tried by its front only: if the backward search from ``probe``,
    a few words into the window, finds a unique string there, every window that holds the string
    falls with it.  If the front occurs again, a longer front is tried, at last the window itself.
    """
    text = np.concatenate(segments)
    ends = np.cumsum([len(s) for s in segments])
    start = (ends - [len(s) for s in segments])[queries]
    end = ends[queries].copy()
    front = np.full(len(queries), min(FRONT, threshold))
    probe = end - threshold + front
    at, which = probe.copy(), np.arange(len(queries))
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), index.size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(which):
        whole = probe == end
        limit = np.where(whole, start, end - threshold)
        more = at > limit
        symbol = text[np.maximum(at - 1, 0)]
        fresh = more & (at == probe)
        a = np.where(fresh, index.below[symbol], low)
        b = np.where(fresh, index.below[symbol + 1], high)
        step = more & ~fresh
        a[step], b[step] = index.extend(symbol[step], low[step], high[step])
        grows = more & (index.occurrences(a, b) > 1)
        low, high = np.where(grows, a, 0), np.where(grows, b, index.size)
        at = np.where(grows, at - 1, at)
        stuck = ~grows
        long = stuck & whole & (probe - at >= threshold)
        if long.any():
            out.append((queries[which[long]], (at - start)[long], (end - start)[long]))
        # A front that occurs again asks for a longer one.
        longer = stuck & ~whole & ~more
        front = np.where(longer, np.minimum(2 * front, threshold), np.where(stuck, min(FRONT, threshold), front))
        # A unique string that ends at the probe rules out all windows that hold it; what stopped a
        # reported interval is the first word of the next window.
        end = np.where(long, at - 1 + threshold, np.where(stuck & ~longer, probe - 1, end))
        probe = np.where(stuck, end - threshold + front, probe)
        at = np.where(stuck, probe, at)
        left = (end - start >= threshold) & ~(long & ~more)
        which, start, end, probe, at, low, high, front = (
            x[left] for x in (which, start, end, probe, at, low, high, front)
        )
    return out


def by_index(parts: list[tuple[bytes, int, int]], threshold: int = THRESHOLD) -> list[np.ndarray]:
    """A mask of repeated windows for each (content, windows, count)."""
    numbers: dict[bytes, int] = {}
    segments = [
        np.array([numbers.setdefault(w, len(numbers) + 1) for w in p.split()], np.int64) for p, _, _ in parts
    ]
    counts = np.array([c for _, _, c in parts])
    masks = [np.full(n, c > 1) for _, n, c in parts]
    queries = np.flatnonzero(counts == 1)
    if len(queries):
        index = Index(segments, counts, len(numbers) + 1)
        for which, lo, hi in matching_intervals(index, segments, queries, threshold):
            for q, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True):
                masks[q][a : b - threshold + 1] = True
    return masks


def unit(threshold: int = THRESHOLD) -> Unit:
    gram = 1 << max(0, (threshold // 8).bit_length() - 1)
    widths = tuple(w for w in (8, 2, 1) if w <= max(1, threshold // 4))
    return Unit(window=threshold, gram=gram, widths=widths, words=True)


def substring_dedup(
    docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, n_spans, kept_sha256."""
    made = remove_repeats(docs, unit(threshold), lambda parts: by_index(parts, threshold), id_col, text_col)
    return made.withColumnRenamed("n_symbols", "n_words")
