"""Repeated windows of a corpus: what substring dedup by words and by bytes share.

A window is a fixed number of consecutive symbols (words or bytes) of one text.  It is repeated if
its content also starts anywhere else.  Each window has an *anchor*: the smallest hash among its
short grams.  Equal windows have equal anchors, and neighbouring windows mostly share theirs, so
a text falls into *segments*: runs of windows with one anchor.  That bounds all the work:

1. Anchors are counted over the whole corpus; a segment whose anchor occurs once holds no repeat.
2. Segments of repeated anchors are counted by anchor and content.  All windows of a segment that
   occurs twice are repeated.
3. Only anchors with several different segments are left.  Each such segment's text is fetched
   once, and segments of one anchor meet in a *pool*, where a solver (the caller's method) finds
   the repeated windows.
4. An anchor with more than ``POOL`` different segments (a line in a third of all documents) is not
   pooled.  Its windows are cut into blocks by their distance to the anchor, and blocks meet by
   the content all their windows share, in ever narrower blocks and so ever longer contents, until
   a block is alone, fits a pool, or is one window wide, where meeting is being equal.

Texts are named by their digest; copies of a text share one result.  Every count is combined
before it is shuffled, no step gathers a group of unbounded size, and pairs are never formed.

Defined cases: null text is empty; texts shorter than a window have no windows; nothing crosses
texts; null and repeated ids are kept, row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import raw_texts, small_text_batches, stash

#: Different segments of one anchor that are pooled; beyond, blocks are narrowed.
POOL = 200
#: Windows in one segment at most: longer runs (periodic texts) are cut.
RUN = 1024
#: Symbols that a pool solver works on at once.
BATCH = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BYTE_HASH = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Unit:
    """What a window is made of."""

    window: int
    gram: int  # a power of two, well below the window
    widths: tuple[int, ...]  # of blocks, narrowing, the last is 1
    words: bool


class Symbols:
    """One text as symbols: their hashes, and the canonical bytes of any range."""

    def __init__(self, text: bytes, unit: Unit) -> None:
        self.words = unit.words
        self.canon = b" ".join(text.split()) if unit.words else text
        self.n = self.canon.count(b" ") + bool(self.canon) if unit.words else len(text)

    @cached_property
    def raw(self) -> np.ndarray:
        return np.frombuffer(self.canon, np.uint8)

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each word ends."""
        return np.append(np.flatnonzero(self.raw == 32), len(self.raw))[: self.n]

    @cached_property
    def starts(self) -> np.ndarray:
        return np.append(0, self.ends[:-1] + 1)[: self.n]

    @cached_property
    def hashes(self) -> np.ndarray:
        if not self.words:
            return BYTE_HASH[self.raw]
        power, inverse = powers(len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(BYTE_HASH[self.raw] * power[: len(self.raw)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return h ^ (h >> np.uint64(32))

    def part(self, a: int, b: int) -> bytes:
        """Canonical bytes of the symbols a to b."""
        if not self.words:
            return self.canon[a:b]
        return self.canon[self.starts[a] : self.ends[b - 1]] if b > a else b""


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    out = []
    for base in (BASE, inverse):
        values = np.full(size, base)
        values[0] = 1
        out.append(np.cumprod(values, dtype=np.uint64))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for a size rounded up."""
    return _powers(max(1 << 15, 1 << (size - 1).bit_length()))


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every gram, by doubling its length."""
    k, base = 1, BASE
    with np.errstate(over="ignore"):
        while k < gram:
            hashes = hashes[:-k] * base + hashes[k:]
            base, k = base * base, 2 * k
        hashes = (hashes ^ (hashes >> np.uint64(31))) * MIX
    return hashes ^ (hashes >> np.uint64(29))


def sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` successive values, in two running passes."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, worst, np.uint64)]).reshape(-1, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    back = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def segments(symbols: Symbols, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, windows, tie) of a text; tie: the anchor is there more than once."""
    if symbols.n < unit.window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = gram_hashes(symbols.hashes, unit.gram)
    reach = unit.window - unit.gram + 1
    lowest = sliding(grams, reach, np.minimum, 2**64 - 1)
    cut = np.concatenate([[True], lowest[1:] != lowest[:-1]])
    start = np.flatnonzero(cut)
    n = np.diff(np.append(start, len(lowest)))
    if n.max() > RUN:
        start = np.concatenate([np.arange(s, s + k, RUN) for s, k in zip(start.tolist(), n.tolist(), strict=True)])
        n = np.diff(np.append(start, len(lowest)))
    anchor = lowest[start]
    # A gram is an anchor if it is the lowest of some window that holds it.
    edge = np.zeros(reach - 1, np.uint64)
    held = sliding(np.concatenate([edge, lowest, edge]), reach, np.maximum, 0)
    values = grams[held == grams]
    tie = np.zeros(len(start), bool)
    ordered = np.sort(values)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        for k in np.flatnonzero(np.isin(anchor, again)).tolist():
            own = grams[start[k] : start[k] + n[k] + reach - 1]
            tie[k] = np.count_nonzero(own == anchor[k]) > 1
    return anchor, start, n, tie


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def segment_rows(docs: DataFrame, unit: Unit) -> DataFrame:
    """One row per segment: anchor, tie, s1, s2 (its content), and its place: digest, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            anchors, starts, runs, ties, owners, content = [], [], [], [], [], []
            for at, text in enumerate(texts):
                symbols = Symbols(text, unit)
                a, s, n, t = segments(symbols, unit)
                for column, values in zip((anchors, starts, runs, ties, owners), (a, s, n, t, np.full(len(a), at)), strict=True):
                    column.append(values)
                content += [
                    xxhash.xxh3_128_digest(symbols.part(i, i + k + unit.window - 1))
                    for i, k in zip(s.tolist(), n.tolist(), strict=True)
                ]
            flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            ids = np.frombuffer(b"".join(content), "<i8").reshape(-1, 2)
            names = pa.array([digest(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(flat(anchors, np.uint64).view(np.int64)),
                    "tie": pa.array(flat(ties, bool)),
                    "s1": pa.array(ids[:, 0].copy()),
                    "s2": pa.array(ids[:, 1].copy()),
                    "digest": names.take(pa.array(flat(owners, np.int64))),
                    "start": pa.array(flat(starts, np.int64)),
                    "n": pa.array(flat(runs, np.int64)),
                }
            )

    return docs.mapInArrow(
        run, "anchor long, tie boolean, s1 long, s2 long, digest binary, start long, n long"
    )


def packed_texts(docs: DataFrame) -> DataFrame:
    """(digest, z): compressed texts, each once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=1), set()
        for batch in batches:
            names, packed = [], []
            for text in raw_texts(batch.column("text")):
                name = digest(text)
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    packed.append(pack.compress(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "z"]
            )

    return docs.mapInArrow(run, "digest binary, z binary")


PART = "k1 long, k2 long, d long, c long, digest binary, start long, n long, part binary"


def fetch(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The text of each wanted segment (anchor, d, c, digest, start, n), as rows of ``PART``."""
    asked = wanted.groupBy("digest").agg(F.collect_list(F.struct("anchor", "d", "c", "start", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("digest", "z", "asked")), strict=True)
            for name, z, asked in rows:
                symbols = Symbols(unpack.decompress(z), unit)
                for a in asked:
                    part = symbols.part(a["start"], a["start"] + a["n"] + unit.window - 1)
                    out.append((a["anchor"], 0, a["d"], a["c"], name, a["start"], a["n"], part))
            yield part_batch(out)

    met = packed_texts(docs).join(asked, "digest").dropDuplicates(["digest"])
    return met.select("digest", "z", "asked").mapInArrow(run, PART)


def part_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    kinds = [*[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names = ["k1", "k2", "d", "c", "digest", "start", "n", "part"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


#: A solver gets (content, windows, count) of segments and gives a mask of repeated windows each.
Solver = Callable[[list[tuple[bytes, int, int]]], list[np.ndarray]]
#: Windows s to s + n - 1 of a text, for every s of starts.
SPAN = "digest binary, starts array<long>, n long"


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def solve_pools(parts: DataFrame, solver: Solver) -> DataFrame:
    """Repeated windows of pooled segments as ``SPAN``; pools stay whole, and a batch of
    them is solved at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[dict]) -> pa.RecordBatch:
            masks = solver([(r["part"], r["n"], r["c"]) for r in rows])
            out = [
                (r["digest"], [r["start"] + a], k)
                for r, mask in zip(rows, masks, strict=True)
                if r["c"] == 1
                for a, k in spans_of(mask)
            ]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "starts", "n"]
            )

        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                other = held and (row["k1"], row["k2"]) != (held[-1]["k1"], held[-1]["k2"])
                if other and size >= BATCH:
                    yield solved(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["part"])
        if held:
            yield solved(held)

    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(run, SPAN)


BLOCK = (
    "k1 long, k2 long, p1 long, p2 long, c long, own boolean, digest binary, starts array<long>, n long, part binary"
)


def narrow(parts: DataFrame, unit: Unit, width: int) -> DataFrame:
    """Cut segments into blocks of windows by their distance to the anchor: (k1, k2) names the block
    and the content that all its windows share, (p1, p2) the content of the windows it has.  Blocks
    of one segment that are alike (a line repeated over and over) are one row with all their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = [], []
            for row in batch.to_pylist():
                symbols = Symbols(row["part"], unit)
                grams = gram_hashes(symbols.hashes, unit.gram)
                reach = unit.window - unit.gram + 1
                anchor = grams[:reach].min()
                places = np.flatnonzero(grams == anchor)
                at = np.arange(row["n"])
                place = places[np.searchsorted(places, at)]
                block = (place - at) // width
                new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(block) != 0)])
                first = np.flatnonzero(new)
                alike: dict[bytes, tuple[list[int], int, bytes]] = {}
                for i, k in zip(first.tolist(), np.diff(np.append(first, row["n"])).tolist(), strict=True):
                    near = int(block[i]) * width
                    core = symbols.part(int(place[i]) - near, int(place[i]) - near - width + 1 + unit.window)
                    part = symbols.part(i, i + k + unit.window - 1)
                    name = int(anchor).to_bytes(8, "little") + near.to_bytes(8, "little") + core
                    name = xxhash.xxh3_128_digest(name) + xxhash.xxh3_128_digest(part)
                    alike.setdefault(name, ([], k, part))[0].append(row["start"] + i)
                for name, (starts, k, part) in alike.items():
                    names.append(name)
                    out.append((row["c"] * len(starts), row["c"] == 1, row["digest"], starts, k, part))
            keys = np.frombuffer(b"".join(names), "<i8").reshape(-1, 4)
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, i].copy()) for i in range(4)]
                + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in BLOCK.split(", ")],
            )

    return parts.mapInArrow(run, BLOCK)


def solve_crowds(parts: DataFrame, unit: Unit, solver: Solver) -> list[DataFrame]:
    """Repeated windows of segments whose anchor has too many for a pool."""
    found = []
    for width in unit.widths:
        cut = stash(narrow(parts, unit, width))
        if width == 1:
            met = cut.groupBy("k1", "k2").agg(F.sum("c").alias("n")).where("n > 1")
            same = cut.where("own").join(met, ["k1", "k2"], "left_semi")
            found.append(same.select("digest", "starts", "n"))
            break
        # Blocks of one content go on as one, which counts as often as it needs to: their windows
        # are repeated.
        by = ["k1", "k2", "p1", "p2"]
        different = stash(
            cut.groupBy(*by).agg(
                F.sum("c").alias("c"),
                F.min(F.struct("digest", F.col("starts")[0].alias("start"), "n")).alias("at"),
                F.first("part").alias("part"),
            )
        )
        copied = different.where("c > 1").select(*by)
        found.append(cut.where("own").join(copied, by, "left_semi").select("digest", "starts", "n"))
        met = stash(different.groupBy("k1", "k2").agg(F.count("*").alias("d")).where("d > 1"))
        parts = different.join(met, ["k1", "k2"]).select(
            "k1", "k2", "d", F.least("c", F.lit(2)).alias("c"), "at.digest", "at.start", "at.n", "part"
        )
        found.append(solve_pools(parts.where(F.col("d") <= POOL), solver))
        if met.where(F.col("d") > POOL).isEmpty():
            break
        parts = parts.where(F.col("d") > POOL)
    return found


def repeated_windows(docs: DataFrame, unit: Unit, solver: Solver) -> DataFrame:
    """The repeated windows of every text as rows of ``SPAN``, which may overlap."""
    every = stash(segment_rows(docs, unit))
    anchors = every.groupBy("anchor").agg(F.count("*").alias("c"), F.max("tie").alias("tie"))
    anchors = stash(anchors.where("c > 1 OR tie").select("anchor"))
    rows = stash(every.join(anchors, "anchor"))
    by = ["anchor", "s1", "s2"]
    different = stash(
        rows.groupBy(*by).agg(
            F.count("*").alias("c"), F.min(F.struct("digest", "start", "n")).alias("at"), F.max("tie").alias("tie")
        )
    )
    copied = different.where("c > 1").select(*by)
    found = [rows.join(copied, by, "left_semi").select("digest", F.array("start").alias("starts"), "n")]
    pools = different.groupBy("anchor").agg(F.count("*").alias("d"), F.max("tie").alias("tie"))
    pools = stash(pools.where("d > 1 OR tie").select("anchor", "d"))
    wanted = different.join(pools, "anchor").select("anchor", "d", "c", "at.digest", "at.start", "at.n")
    parts = stash(fetch(docs, wanted, unit))
    found.append(solve_pools(parts.where(F.col("d") <= POOL), solver))
    crowds = parts.where(F.col("d") > POOL)
    if not pools.where(F.col("d") > POOL).isEmpty():
        found += solve_crowds(crowds, unit, solver)
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans.distinct()


RESULT = "n_symbols long, n_removed long, n_spans long, kept_sha256 string"


def removed(symbols: Symbols, spans: list[dict] | None, unit: Unit) -> tuple[int, int, int, str]:
    """Sizes, maximal removed runs and the digest of what stays."""
    if not spans:
        return symbols.n, 0, 0, hashlib.sha256(symbols.canon).hexdigest()
    change = np.zeros(symbols.n + 1, np.int64)
    start = np.concatenate([s["starts"] for s in spans])
    n = np.repeat([s["n"] for s in spans], [len(s["starts"]) for s in spans])
    np.add.at(change, start, 1)
    np.add.at(change, start + n - 1 + unit.window, -1)
    gone = np.cumsum(change[:-1]) > 0
    kept = [symbols.part(a, a + k) for a, k in spans_of(~gone)]
    text = (b" " if unit.words else b"").join(kept)
    return symbols.n, int(gone.sum()), len(spans_of(gone)), hashlib.sha256(text).hexdigest()


def remove_repeats(
    docs: DataFrame, unit: Unit, solver: Solver, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_symbols, n_removed, n_spans, kept_sha256."""
    small_text_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    spans = repeated_windows(texts, unit, solver)
    spans = spans.groupBy("digest").agg(F.collect_list(F.struct("starts", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            z, found = batch.column("z").to_pylist(), batch.column("spans").to_pylist()
            out = [removed(Symbols(unpack.decompress(t), unit), s, unit) for t, s in zip(z, found, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["digest", "n_symbols", "n_removed", "n_spans", "kept_sha256"],
            )

    judged = packed_texts(texts).join(spans, "digest", "left").select("digest", "z", "spans")
    result = judged.mapInArrow(run, f"digest binary, {RESULT}").dropDuplicates(["digest"])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest(t) for t in raw_texts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "digest"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = ids.mapInArrow(names, "doc_id long, digest binary")
    return ids.join(stash(result), "digest").drop("digest")
