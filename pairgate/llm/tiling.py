"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

Texts are compared as lower-cased words of letters and digits.  Benchmark items are indexed by
the rolling hash of their ``min_match`` successive words; a document's rolling hashes are joined
with that index where the document is scanned, and every hash hit is verified word by word.  For
each item met, hits on one diagonal that follow each other form maximal matches; the longest ones
are marked, everything that touches a marked word is struck out, and the search repeats until no
match of ``min_match`` words is left.  Tiles never overlap, on either side, so reordered passages
add up, while one passage repeated in a document covers the item once.  A document is contaminated
if the tiles cover at least ``threshold`` of some item's words.

The benchmark is a stated set.  It is read in blocks of about ``BLOCK_WORDS`` words (by a hash of
the item), so what a task holds is bounded; documents pass through one block after the other, and
a larger benchmark means more passes, not more memory.  No document leaves its partition.

Defined cases: null and empty texts have no words: coverage 0, item null; items of fewer words
than ``min_match`` can't be tested and never match; of equally covered items the smallest id is
reported; a null item id takes part and orders last; repeated items and repeated documents are
judged each; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import small_text_batches

WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK_WORDS = 2_000_000
RESULT = "item_id long, n_tiles int, n_covered int, n_item_words int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` ids, modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = value * BASE + ids[k : k + n].astype(np.uint64)
    return value


@dataclass
class Index:
    """A block of items: word numbers, and the sorted hashes of all item windows."""

    vocabulary: dict[str, int]
    item_ids: list
    items: list[np.ndarray]
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    min_match: int

    @classmethod
    def of(cls, rows: list[tuple], min_match: int) -> Index:
        vocabulary: dict[str, int] = {}
        ids, items, hashes, owner, place = [], [], [], [], []
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            item = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int64)
            h = rolling(item, min_match)
            owner.append(np.full(len(h), len(items)))
            place.append(np.arange(len(h)))
            hashes.append(h)
            ids.append(item_id)
            items.append(item)
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])[order]
        return cls(vocabulary, ids, items, h[order], join(owner), join(place), min_match)

    def seeds(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the document, place in the item) of all verified window hits."""
        h = rolling(doc, self.min_match)
        known = doc > 0
        whole = np.ones(len(h), bool)
        for k in range(self.min_match):
            whole &= known[k : k + len(h)]
        at = np.flatnonzero(whole)
        lo = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        i = np.repeat(at, n)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner, j = self.owner[entry], self.place[entry]
        return owner, i, j


def tile(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> tuple[int, int]:
    """(tiles, covered item words) from the window hits (i, j) of one document and item."""
    same = np.ones(len(i), bool)
    for k in range(width):
        same &= doc[i + k] == item[j + k]
    i, j = i[same], j[same]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    tiles = covered = 0
    while len(i):
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)]))
        lengths = np.diff(np.concatenate([starts, [len(i)]])) + width - 1
        longest = lengths.max()
        doc_marked: list[tuple[int, int]] = []
        item_marked: list[tuple[int, int]] = []
        for s in starts[lengths == longest].tolist():
            a, b = int(i[s]), int(j[s])
            if all(abs(a - x) >= longest for x, _ in doc_marked) and all(
                abs(b - x) >= longest for x, _ in item_marked
            ):
                doc_marked.append((a, a + longest))
                item_marked.append((b, b + longest))
        tiles += len(item_marked)
        covered += int(longest) * len(item_marked)
        free = np.ones(len(i), bool)
        for places, marked in ((i, doc_marked), (j, item_marked)):
            for lo, hi in marked:
                free &= (places + width <= lo) | (places >= hi)
        i, j = i[free], j[free]
    return tiles, covered


def judge(index: Index, text: str | None) -> tuple | None:
    """The best covered item of the block: (item_id, tiles, covered, item words)."""
    get = index.vocabulary.get
    doc = np.array([get(w, 0) for w in words_of(text)], np.int64)
    owner, i, j = index.seeds(doc)
    if not len(owner):
        return None
    best = None
    met: dict[int, list[int]] = defaultdict(list)
    for at, o in enumerate(owner.tolist()):
        met[o].append(at)
    for o in sorted(met):
        at = np.array(met[o])
        tiles, covered = tile(doc, index.items[o], i[at], j[at], index.min_match)
        found = (index.item_ids[o], tiles, covered, len(index.items[o]))
        if covered and (best is None or covered * best[3] > best[2] * found[3]):
            best = found
    return best


def benchmark_blocks(
    benchmark: DataFrame, min_match: int, id_col: str = "item_id", text_col: str = "text"
) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, one at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\W+")))).first()[0] or 0
    n = -(-n_words // BLOCK_WORDS) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Index.of([tuple(r) for r in rows.toLocalIterator()], min_match)


def tiled(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, n_tiles, n_covered, n_item_words: each row's best covered item."""
    small_text_batches(docs.sparkSession)
    spark = docs.sparkSession
    state = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.lit(None).cast("long").alias("item_id"),
        *[F.lit(0).alias(c) for c in ("n_tiles", "n_covered", "n_item_words")],
    )
    for index in benchmark_blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.select(["item_id", "n_tiles", "n_covered", "n_item_words"]).to_pylist()
                for at, text in enumerate(batch.column("text").to_pylist()):
                    found = judge(shared.value, text)
                    was = tuple(rows[at].values())
                    ahead = found and (
                        not was[2]
                        or (-found[2] * was[3], found[0] is None, found[0] or 0)
                        < (-was[2] * found[3], was[0] is None, was[0] or 0)
                    )
                    if ahead:
                        rows[at] = dict(zip(rows[at], found, strict=True))
                fields = batch.schema.field
                best = [
                    pa.array([r[c] for r in rows], fields(c).type)
                    for c in ("item_id", "n_tiles", "n_covered", "n_item_words")
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), *best], schema=batch.schema
                )

        state = state.mapInArrow(run, state.schema)
    return state.drop("text")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5
) -> DataFrame:
    """One row per document: the best covered item, its coverage, and the decision."""
    coverage = F.when(F.col("n_item_words") > 0, F.col("n_covered") / F.col("n_item_words")).otherwise(0.0)
    return tiled(docs, benchmark, min_match).select(
        "doc_id",
        "item_id",
        "n_tiles",
        "n_covered",
        "n_item_words",
        coverage.alias("coverage"),
        (coverage >= threshold).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that no item is found in, all columns, filtered where they are scanned."""
    small_text_batches(docs.sparkSession)
    for index in benchmark_blocks(benchmark, min_match):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [judge(shared.value, t) for t in pc.cast(batch.column(text_col), pa.string()).to_pylist()]
                yield batch.filter(pa.array([not f or f[2] < threshold * f[3] for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
