"""Katz backoff language model, counted and evaluated by Spark in blocks of n-grams.

P(w | h) is the discounted relative frequency of (h, w) where training holds it, and
bow(h) P(w | h without its first word) where it does not; below the words there is one class for
everything unseen.  Counts are discounted by Good-Turing (``discounts``), and bow(h) gives exactly
the mass that the seen words of h leave free to the others, so that every distribution sums to 1.

Documents are scanned once, in chunks of neighbouring documents.  A chunk keeps its words as local
numbers (its program, a row of a table bucketed by chunk, so that answers join it without its being
shuffled) and asks for each of its distinct n-grams once: sorted 64-bit keys, cut by
their leading bits into buckets.  A bucket's task counts its n-grams over all chunks, writes its
part of the model table (level, bucket, keys, counts), and answers every chunk.  For each order the
chunks then add up, over the n-grams they own (each belongs to one chunk), what the seen words of a
history take; the history's bucket sums that and answers with the history's total and bow, which is
the table of histories.  At last a chunk evaluates its n-grams order by order, the shorter before
the longer, and its documents add up the logarithms.

Hot words and n-grams come once per chunk, keys are hashed, so buckets are alike; very long
documents are split among chunks with the words before them as history.  Nothing about the corpus
reaches the driver but the counts of counts up to ``MOST_DISCOUNTED`` + 1.  Two n-grams of one
64-bit key would be counted as one (one pair in 10**9 distinct n-grams is expected to at 3 %).

Defined cases: null text is empty and has the end token alone; repeated rows, null and repeated ids
are documents of their own; without training tokens every probability is 1; an unseen word is the
one class of unseen words; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import FOLD, raw_texts, shared_dir, small_text_batches, stash

#: Words in an n-gram.
ORDER = 2
#: Tokens of a chunk, and text bytes that a bucket is planned for.
CHUNK, BUCKET_BYTES = 2_000_000, 16 << 20
#: Counts up to this one are discounted by Good-Turing.
MOST_DISCOUNTED = 7
#: Fixed values of the base score.
ADDED = 0.1
#: No words of a text: its end, and what stands before it.
END, BEFORE = b"\n", b"\t"
#: Tasks that chunks are dealt to, at most; bytes of text for a token, to plan with.
MOST_CHUNK_BUCKETS, BYTES_OF_TOKEN = 20_000, 6
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LITTLE = 1e-12


def packed(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """An array as compressed planes of bytes; sorted keys as differences."""
    if sorted_keys and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(blob: bytes, dtype: type, sorted_keys: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if sorted_keys else values


def mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the keys of its history and its last word."""
    x = (history * MIX[0]) ^ (word + MIX[1])
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    return x ^ (x >> np.uint64(32))


class Level(NamedTuple):
    """Distinct m-grams of a chunk: key, history and shorter m-gram (numbers one level below), and
    which one ends at each position."""

    keys: np.ndarray
    history: np.ndarray
    shorter: np.ndarray
    at: np.ndarray
    rank: np.ndarray  # number of the key in key order -> m-gram


class Chunk(NamedTuple):
    """words: key per local word; stream: local word per position; pieces: parts of documents
    (uid, doc_id, held_out, first position, first scored position)."""

    words: np.ndarray
    stream: np.ndarray
    uid: np.ndarray
    doc_id: list
    held_out: np.ndarray
    first: np.ndarray
    scored: np.ndarray

    def levels(self, order: int) -> list[Level]:
        """Levels 1 to ``order``; where a piece begins, an m-gram of more words is 'nothing before'."""
        n = len(self.words)
        before = np.uint64(xxhash.xxh3_64_intdigest(BEFORE))
        everything = np.arange(n)
        out = [Level(self.words, everything, everything, self.stream, np.argsort(self.words, kind="stable"))]
        empty = before
        for _ in range(2, order + 1):
            low = out[-1]
            empty = mixed(np.array([empty]), np.array([before]))[0]
            code = np.empty(len(self.stream), np.int64)
            code[1:] = low.at[:-1].astype(np.int64) * n + self.stream[1:]
            code[self.first] = -1
            found, index, at = np.unique(code, return_index=True, return_inverse=True)
            at = at.astype(np.int32)
            history, word = found // n, found % n
            keys = mixed(low.keys[history], self.words[word])
            if len(found) and found[0] < 0:
                keys[0] = empty
            out.append(Level(keys, history, low.at[index], at, np.argsort(keys, kind="stable")))
        return out

    def is_scored(self) -> np.ndarray:
        """Positions that are tokens; the others are history only."""
        marks = np.zeros(len(self.stream) + 1, np.int64)
        np.add.at(marks, self.first, 1)
        np.add.at(marks, self.scored, -1)
        return np.cumsum(marks)[:-1] == 0

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.stream)))


ROW = (
    "chunk long, kind int, level int, bucket int, a binary, b binary, c binary, d binary, "
    "uid array<long>, doc_id array<long>, held_out array<boolean>, first array<long>, scored array<long>"
)
NAMES = [f.split()[0] for f in ROW.split(", ")]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
SCHEMA = pa.schema(list(zip(NAMES, TYPES)))
PROGRAM, ASKED, COUNTED, SUMMED, HISTORY, TABLE = range(6)


PROGRAM_COLUMNS = ["kind", "a", "b", "uid", "doc_id", "held_out", "first", "scored"]
ANSWER = ["kind", "level", "bucket", "a", "b"]


def row_of(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema=SCHEMA)


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys by their leading bits."""
    lead = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(lead, np.arange((1 << bits) + 1))
    for bucket in range(1 << bits):
        if cuts[bucket] < cuts[bucket + 1]:
            yield bucket, slice(cuts[bucket], cuts[bucket + 1])


def scan(order: int, size: int) -> Callable:
    """(doc_id, text, held_out) to the programs of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        chunks, docs = 0, 0
        known: dict[bytes, int] = {}
        stream: list[np.ndarray] = []
        pieces: list[tuple] = []
        held = 0

        def start() -> None:
            nonlocal held
            known.clear()
            known.update({END: 0, BEFORE: 1})
            stream.clear()
            pieces.clear()
            held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal chunks
            if not pieces:
                return
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            place = np.argsort(words, kind="stable")
            number = np.empty(len(words), np.uint32)
            number[place] = np.arange(len(words))
            uid, doc_id, held_out, first, scored = zip(*pieces)
            name = task + chunks
            chunks += 1
            yield row_of(
                chunk=name, kind=PROGRAM, a=packed(words[place], True), b=packed(number[np.concatenate(stream)]),
                uid=list(uid), doc_id=list(doc_id), held_out=list(held_out), first=list(first), scored=list(scored),
            )

        start()
        for batch in batches:
            for doc_id, held_out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), raw_texts(batch.column("text"))):
                tokens = text.translate(FOLD).split()
                tokens.append(END)
                uid, at = task + docs, 0
                docs += 1
                while at < len(tokens):
                    if held >= size:
                        yield from closed()
                        start()
                    back = min(at, order - 1)
                    part = tokens[at - back : at + size - held]
                    if at < order - 1:  # the document's beginning is among the words before
                        part.insert(0, BEFORE)
                        back += 1
                    for w in part:
                        if w not in known:
                            known[w] = len(known)
                    numbers = np.fromiter(map(known.__getitem__, part), np.int32, len(part))
                    total = pieces[-1][3] + len(stream[-1]) if pieces else 0
                    pieces.append((uid, doc_id, held_out, total, total + back))
                    stream.append(numbers)
                    at += len(part) - back
                    held += len(part) - back
        yield from closed()

    return run


def ask(order: int, bits: int) -> Callable:
    """Programs to what their chunks ask for: distinct n-grams and how often training has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, _ = read_chunk([row])
                learnt = chunk.is_scored() & ~np.repeat(chunk.held_out, chunk.sizes())
                for m, level in enumerate(chunk.levels(order), 1):
                    n = np.bincount(level.at[learnt], minlength=len(level.keys))[level.rank].astype(np.uint32)
                    keys = level.keys[level.rank]
                    for bucket, part in by_bucket(keys, bits):
                        yield row_of(
                            chunk=row["chunk"], kind=ASKED, level=m, bucket=bucket, a=packed(keys[part], True), b=packed(n[part])
                        )

    return run


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of a sorted stream, key by key."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of n-grams: the model's part, and counts and ownership for every chunk."""
    for (level, bucket), rows in grouped(batches, "level", "bucket"):
        keys = [unpacked(r["a"], np.uint64, True) for r in rows]
        asked = [unpacked(r["b"], np.uint32) for r in rows]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(asked), len(found)).astype(np.int64)
        # The first chunk that learnt an n-gram owns it.
        flat = np.flatnonzero(np.concatenate(asked))
        owner = np.full(len(found), -1)
        owner[at[flat[::-1]]] = flat[::-1]
        owns = np.zeros(len(at), np.uint8)
        owns[owner[owner >= 0]] = 1
        cut = np.cumsum([len(k) for k in keys])[:-1]
        for r, numbers, mine in zip(rows, np.split(at, cut), np.split(owns, cut)):
            yield row_of(chunk=r["chunk"], kind=COUNTED, level=level, bucket=bucket, a=packed(n[numbers]), b=packed(mine))
        seen = n > 0
        hist = np.bincount(np.minimum(n[seen], MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)
        yield row_of(kind=TABLE, level=level, bucket=bucket, c=packed(found[seen], True), d=packed(n[seen]),
                     first=[int(n.sum()), int(seen.sum())], scored=[int(x) for x in hist])


class Discount(NamedTuple):
    """Factors of counts 1, 2, ... (greater ones stay), or a constant taken from every count."""

    factors: tuple[float, ...]
    taken: float

    def mass(self, n: np.ndarray) -> np.ndarray:
        """What of each count its n-gram keeps."""
        if self.factors:
            table = np.array([0.0, *self.factors, 1.0])
            return n * table[np.minimum(n, len(table) - 1)]
        return np.where(n > 0, n - self.taken, 0.0)


def discounts(of: list[int]) -> Discount:
    """Good-Turing by Katz from the numbers of n-grams seen once, twice, ... (``of[r]``), with the
    greatest bound up to MOST_DISCOUNTED for which all factors lie in (0, 1); where there is none
    (too few n-grams, or copied texts), the constant n1 / (n1 + 2 n2), or a half if either is 0."""
    for k in range(MOST_DISCOUNTED, 1, -1):
        if all(of[1 : k + 2]):
            last = (k + 1) * of[k + 1] / of[1]
            if last < 1:
                factors = [((r + 1) * of[r + 1] / (r * of[r]) - last) / (1 - last) for r in range(1, k + 1)]
                if all(0 < f < 1 for f in factors):
                    return Discount(tuple(factors), 0.0)
    return Discount((), of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5)


class Model(NamedTuple):
    """What every task knows: tokens and distinct words of training, discounts by level."""

    total: int
    distinct: int
    discount: list[Discount]
    of_words: list[int]

    def words(self, n: np.ndarray) -> np.ndarray:
        """P(w) by the word's count; count 0 is the class of unseen words."""
        if not self.total:
            return np.ones(len(n))
        kept = self.discount[0].mass(n)
        lost = self.lost()
        whole = self.total + (lost < LITTLE)
        return np.where(n > 0, kept, whole - (self.total - lost)) / whole

    def lost(self) -> float:
        """What the words lose to the unseen ones, out of ``total``."""
        d = self.discount[0]
        if not d.factors:
            return d.taken * self.distinct
        return sum((1 - f) * r * self.of_words[r] for r, f in enumerate(d.factors, 1))


def read_chunk(rows: list[dict]) -> tuple[Chunk, dict]:
    """A chunk and its answers: (kind, level) to arrays in key order."""
    chunk, answers = None, {}
    for r in sorted(rows, key=lambda r: (r["kind"], r.get("level") or 0, r.get("bucket") or 0)):
        if r["kind"] == PROGRAM:
            chunk = Chunk(
                unpacked(r["a"], np.uint64, True), unpacked(r["b"], np.uint32).astype(np.int32), np.array(r["uid"]),
                r["doc_id"], np.array(r["held_out"], bool), np.array(r["first"]), np.array(r["scored"]),
            )
        else:
            kinds = (np.int64, np.uint8) if r["kind"] == COUNTED else (np.float64, np.float64)
            answers.setdefault((r["kind"], r["level"]), []).append([unpacked(r[x], t) for x, t in zip("ab", kinds)])
    return chunk, {k: [np.concatenate(x) for x in zip(*v)] for k, v in answers.items()}


def known_levels(chunk: Chunk, answers: dict, model: Model, order: int) -> tuple[list[Level], list[list[np.ndarray]], list[np.ndarray]]:
    """Levels, their counts and ownership, and the probabilities as far as histories are answered."""
    levels, counted, p = chunk.levels(order), [], []

    def local(level: Level, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[level.rank] = values
        return out

    for m, level in enumerate(levels, 1):
        counted.append([local(level, x) for x in answers[COUNTED, m]])
        n = counted[-1][0]
        if m == 1:
            p.append(model.words(n))
        elif (HISTORY, m) in answers:
            whole, bow = (local(levels[m - 2], x)[level.history] for x in answers[HISTORY, m])
            seen = n > 0
            p.append(np.where(seen, model.discount[m - 1].mass(n) / np.where(seen, whole, 1), bow * p[-1][level.shorter]))
    return levels, counted, p


def sum_histories(model: Model, m: int, order: int, bits: int) -> Callable:
    """Chunks to the sums of the histories of m-grams: total, mass kept, shorter probability."""

    def run(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        chunk, answers = read_chunk(rows)
        levels, counted, p = known_levels(chunk, answers, model, order)
        level, below = levels[m - 1], levels[m - 2]
        n, mine = counted[m - 1]
        own = np.flatnonzero((mine > 0) & (n > 0))
        at = level.history[own]
        sums = [
            np.bincount(at, x, len(below.keys))[below.rank]
            for x in (n[own], model.discount[m - 1].mass(n[own]), p[m - 2][level.shorter[own]])
        ]
        keys = below.keys[below.rank]
        for bucket, part in by_bucket(keys, bits):
            a, *rest = packed(keys[part], True), *[packed(x[part]) for x in sums]
            yield row_of(chunk=rows[0]["chunk"], kind=SUMMED, level=m, bucket=bucket, a=a, **dict(zip("bcd", rest)))

    return run


def close_histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of histories: (divisor, bow) for the model's table and for every chunk."""
    for (level, bucket), rows in grouped(batches, "level", "bucket"):
        keys = [unpacked(r["a"], np.uint64, True) for r in rows]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, kept, shorter = (
            np.bincount(at, np.concatenate([unpacked(r[x], np.float64) for r in rows]), len(found)) for x in "bcd"
        )
        # A history that loses nothing (all counts great) reserves one count for the others.
        whole = total + (total - kept < LITTLE * np.maximum(total, 1))
        bow = np.where(total > 0, (whole - kept) / whole / np.maximum(1 - shorter, LITTLE), 1.0)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        for r, numbers in zip(rows, np.split(at, cut)):
            yield row_of(chunk=r["chunk"], kind=HISTORY, level=level, bucket=bucket, a=packed(whole[numbers]), b=packed(bow[numbers]))
        real = total > 0
        yield row_of(kind=TABLE, level=level, bucket=bucket, c=packed(found[real], True), d=packed(np.stack((whole[real], bow[real])).ravel()))


PARTS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def evaluate(model: Model, order: int) -> Callable:
    """Chunks to sums per document, or part of one."""

    def run(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        chunk, answers = read_chunk(rows)
        levels, counted, p = known_levels(chunk, answers, model, order)
        n = counted[0][0]
        real = chunk.is_scored()
        word = levels[0].at
        below = model.total + ADDED * (model.distinct + 1)
        columns = [real, real & (n > 0)[word]]
        with np.errstate(divide="ignore"):  # 'nothing before' has no probability and no token
            columns += [
                np.where(real, np.log10((n + ADDED) / below)[word], 0.0),
                np.where(real, np.log10(p[-1])[levels[-1].at], 0.0),
            ]
        sums = [np.add.reduceat(c, chunk.first, dtype=t) for c, t in zip(columns, (np.int64, np.int64, np.float64, np.float64))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.uid, pa.int64()), pa.array(chunk.doc_id, pa.int64()), pa.array(chunk.held_out), *map(pa.array, sums)],
            names=[f.split()[0] for f in PARTS.split(", ")],
        )

    return run


def met(kernel: Callable) -> Callable:
    """A kernel over the rows of one chunk as a function of its program and its answers."""

    def run(program: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(kernel([*program.to_pylist(), *answers.to_pylist()])))

    return run


class Katz(NamedTuple):
    """scores: a row per document; ngrams (level, bucket, keys, counts) and histories (level,
    bucket, keys, divisors and bows): the model's tables, one row per bucket, compressed."""

    scores: DataFrame
    ngrams: DataFrame
    histories: list[DataFrame]
    model: Model


def katz(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> Katz:
    """Learn from the documents that are not ``held_out`` and score all of them.

    ``scores``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    small_text_batches(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // bucket_bytes).bit_length())
    parts = max(1, 1 << bits)
    # Bucketed by chunk, so that answers come to the programs and programs are never shuffled.
    held = f"pairgate_{uuid.uuid4().hex}"
    written = texts.mapInArrow(scan(order, chunk), ROW).select("chunk", *PROGRAM_COLUMNS).write
    at_once = min(MOST_CHUNK_BUCKETS, 1 + size // (chunk * BYTES_OF_TOKEN))
    written.bucketBy(at_once, "chunk").option("path", f"{shared_dir(docs.sparkSession)}/{held}").saveAsTable(held)
    program = docs.sparkSession.table(held)

    def in_buckets(rows: DataFrame, kernel: Callable) -> DataFrame:
        placed = rows.repartition(parts * order, "level", "bucket").sortWithinPartitions("level", "bucket", "chunk")
        return stash(placed.mapInArrow(kernel, ROW))

    def in_chunks(answers: list[DataFrame], kernel: Callable, schema: str) -> DataFrame:
        rows = answers[0]
        for found in answers[1:]:
            rows = rows.unionByName(found)
        rows = rows.where(f"kind <> {TABLE}").select("chunk", *ANSWER)
        return program.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(met(kernel), schema)

    counted = in_buckets(program.mapInArrow(ask(order, bits), ROW), count)
    tables = counted.where(f"kind = {TABLE}")
    of = {
        r["level"]: r
        for r in tables.groupBy("level")
        .agg(
            *[F.sum(F.col("scored")[k]).alias(f"n{k}") for k in range(MOST_DISCOUNTED + 2)],
            *[F.sum(F.col("first")[k]).alias(f"t{k}") for k in range(2)],
        )
        .collect()
    }
    seen = [[of[m][f"n{k}"] for k in range(MOST_DISCOUNTED + 2)] if m in of else [0] * (MOST_DISCOUNTED + 2) for m in range(1, order + 1)]
    total, distinct = (of[1]["t0"], of[1]["t1"]) if of else (0, 0)
    model = Model(total, distinct, [discounts(x) for x in seen], seen[0])
    answers = [counted]
    for m in range(2, order + 1):
        summed = in_chunks(answers, sum_histories(model, m, order, bits), ROW)
        answers.append(in_buckets(summed, close_histories))
    whole = in_chunks(answers, evaluate(model, order), PARTS).groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")],
    )
    scores = whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    shown = ["level", "bucket", F.col("c").alias("keys"), F.col("d").alias("values")]
    return Katz(scores, tables.select(*shown), [a.where(f"kind = {TABLE}").select(*shown) for a in answers[1:]], model)
