"""Pattern packing of tokenised documents by non-negative least squares.

Documents are tokenised where they are scanned and cut into pieces; a piece is a few numbers.
Only the histogram of piece lengths (at most ``capacity`` counts) reaches the driver.  There,
patterns of a few lengths that nearly fill a sequence are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded, and what is left is packed
largest first, each sequence completed by the largest lengths that fit, again as repeated
patterns.  The work depends on the number of lengths and not on the number of documents.

Pieces then find their place without being sorted or gathered: a piece is numbered within its
length by its scan partition's offset and its rank there, and the patterns own ranges of numbers.

Defined cases: null text is empty; an empty text is its end token alone; a document longer than
``capacity`` is cut into full pieces, the first piece takes the remainder; repeated documents are
packed each; null ids are kept; texts of any length and of any one character are encoded whole; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairgate.llm.common import small_text_batches, stash

CAPACITY = 2048
END = 0
#: Fixed value: the public word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The faster encoder's pattern engine recurses along white space and dies of very long runs.
LONG_SPACE = re.compile(r"\s{10000}")
#: Second lengths tried for each first length of a pattern of three.
SECONDS = 24
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def encoder(vocabulary: str, ranks: str | None = None) -> Callable[[], Callable[[str], list[int]]]:
    """A picklable maker of text -> ids by the ``tokenizers`` file at ``vocabulary``.

    The files (a megabyte or two) are read by the driver and travel with the task.  With ``ranks``,
    the same vocabulary in the other library's form, texts without special-token strings take that
    library's faster encoder, which gives the same ids, unless they have very long runs of white
    space.
    """
    with open(vocabulary, encoding="utf-8") as f:
        described = f.read()
    ranked = open(ranks, "rb").read() if ranks else None

    def make() -> Callable[[str], list[int]]:
        slow = Tokenizer.from_str(described)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

        def plain(text: str) -> list[int]:
            return slow.encode(text, add_special_tokens=False).ids

        if ranked is None:
            return plain
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranked.splitlines())}
        fast = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

        def quick(text: str) -> list[int]:
            slowly = any(s in text for s in special) or LONG_SPACE.search(text)
            return plain(text) if slowly else fast.encode_ordinary(text)

        return quick

    return make


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame, make: Callable, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, nth: nth of its length within the partition."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = make(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(END)
                raw = memoryview(np.array(ids, "<u4")).cast("B")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    out.append((doc_id, k, start, length, crc, int(seen[length])))
                    seen[length] += 1
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, PIECE)


def fitting(sorted_lengths: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest length that fits into each room; 0 if none."""
    at = np.searchsorted(sorted_lengths, room, "right") - 1
    return np.where(at >= 0, sorted_lengths[np.maximum(at, 0)], 0)


def enumerate_patterns(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns of one to four lengths, zero-filled rows, fullest first: every length completed by
    the largest that fits, directly or after a second length from a grid of present lengths."""
    present = np.flatnonzero(histogram)
    grid = present[np.unique(np.linspace(0, len(present) - 1, SECONDS).astype(int))]
    a, b = (x.ravel() for x in np.meshgrid(present, np.concatenate([[0], grid]), indexing="ij"))
    good = a + b <= capacity
    a, b = a[good], b[good]
    c = fitting(present, capacity - a - b)
    d = fitting(present, capacity - a - b - c)
    rows = -np.sort(-np.stack([a, b, c, d], axis=1), axis=1)
    rows = np.unique(rows, axis=0)
    return rows[np.argsort(-rows.sum(axis=1), kind="stable")]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram, by accelerated projected
    gradients over the patterns' few entries."""
    size = len(histogram)
    target = histogram.astype(float).copy()
    target[0] = 0.0
    used = patterns > 0
    # The largest eigenvalue of A'A is at most the largest row sum times the largest column sum.
    rows = np.bincount(patterns.ravel(), minlength=size)[1:].max()
    step = 1.0 / (rows * patterns.shape[1])
    x = np.zeros(len(patterns))
    y, momentum = x.copy(), 1.0
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), np.repeat(y, patterns.shape[1]), size)
        made[0] = 0.0
        gradient = ((made - target)[patterns] * used).sum(axis=1)
        new = np.maximum(0.0, y - step * gradient)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram (index: length) exactly."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], most: int) -> None:
        need = Counter(lengths)
        n = min(most, *(int(left[k]) // m for k, m in need.items()))
        if n > 0:
            out.append((lengths, n))
            for k, m in need.items():
                left[k] -= n * m

    if left[1:].any():
        patterns = enumerate_patterns(left, capacity)
        for row, n in zip(patterns.tolist(), np.floor(fit_counts(patterns, left)).astype(int).tolist(), strict=True):
            if n and sum(row) > 0.99 * capacity:
                take(tuple(v for v in row if v), n)
    while len(present := np.flatnonzero(left)):
        lengths, spare = [int(present[-1])], left.copy()
        spare[lengths[0]] -= 1
        room = capacity - lengths[0]
        while room > 0:
            fits = np.flatnonzero(spare[: room + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            n = min(int(spare[k]), room // k)
            lengths += [k] * n
            spare[k] -= n
            room -= k * n
        take(tuple(lengths), int(left[lengths[0]]))
    return out


@dataclass
class Places:
    """Per length the ranges of numbers that patterns own, as flat arrays sorted by (length, from)."""

    first: np.ndarray  # by length, where its ranges begin
    low: np.ndarray
    base: np.ndarray
    many: np.ndarray
    slots: np.ndarray  # where the range's offsets begin
    offsets: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> Places:
        ranges: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        used = [0] * (capacity + 1)
        offsets: list[int] = []
        sequence = 0
        for lengths, n in patterns:
            starts: dict[int, list[int]] = {}
            at = 0
            for k in lengths:
                starts.setdefault(k, []).append(at)
                at += k
            for k, places in starts.items():
                ranges[k].append((used[k], sequence, len(places), len(offsets)))
                offsets += places
                used[k] += n * len(places)
            sequence += n
        flat = [r for of in ranges for r in of]
        low, base, many, slots = (np.array(c, np.int64) for c in (zip(*flat, strict=True) if flat else [[]] * 4))
        first = np.cumsum([0, *map(len, ranges)])
        return cls(first, low, base, many, slots, np.array(offsets, np.int64))

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces numbered within their length."""
        at = np.empty(len(length), np.int64)
        for k in np.unique(length):
            own = length == k
            lo, hi = self.first[k], self.first[k + 1]
            at[own] = lo + np.searchsorted(self.low[lo:hi], number[own], "right") - 1
        turn = number - self.low[at]
        return self.base[at] + turn // self.many[at], self.offsets[self.slots[at] + turn % self.many[at]]


def pack(
    docs: DataFrame, make: Callable, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stash(
        pieces(docs, make, capacity, id_col, text_col).withColumn("part", F.spark_partition_id())
    )
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[row.length] = row.n
    places = rows.sparkSession.sparkContext.broadcast(Places.of(plan(histogram, capacity), capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = places.value.find(batch.column("length").to_numpy(), number)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in range(5)] + [pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    numbered = rows.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "nth", "before"
    )
    return numbered.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
