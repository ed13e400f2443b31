"""SimHash near-dedup over a byte-position inverted index with count filtering.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
Fingerprints that differ in at most k bits differ in at most k of their 8 bytes, so they share at
least 8 - k positional bytes.  Equal fingerprints are merged first.  A posting key is a set of
byte positions with their values; the sets are a covering family: any 8 - k positions contain
one of them, so every pair within reach meets in a posting list.  For the pairs that meet, the
shared positional bytes are tallied, pairs below the guaranteed minimum are dropped, and the rest
is verified by the number of differing bits.

A posting list longer than ``list_rows`` is not paired.  Its fingerprints meet over *deletions*
instead: within k = 2 bits exactly those pairs link that share a fingerprint or a one-bit
neighbour of it, so each sends itself and its neighbours in the open byte positions and links to
the smallest fingerprint that sent the same value.  That is exact, and linear in the list's length.

``drop_near`` links what ``simhash_dedup`` links, through the same index, and adds the near copies
that two bits cannot reach: documents also meet under keys of minimal shingle hashes, the bits of
several fingerprints keep the unlike apart, and what is left is decided by the Jaccard similarity of
the whole shingle sets.

Defined cases: null text is empty; no words give the fingerprint zero, linked like any other;
fewer words than a shingle make one shingle of all of them; rows with one id count as one
document; null ids keep their fingerprint and are their own component (null); no rows, no result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import FOLD, raw_texts, small_text_batches, stash
from pairgate.llm.components import components
from pairgate.llm.exact import rows_that_stay

SEED = 42
N_BYTES = 8
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
#: Documents of one posting list that are compared with each other at once.
LIST_BLOCK = 1024
#: Minimal shingle hashes that make one key of the near-copy stage, and the shingles hashed at once.
KEY_MINIMA = 3
MINIMA_BLOCK = 1 << 11
#: Standard deviations that two near copies' bits may lie above the expected number.
SPREAD = 8
#: An odd multiplier that spreads bits, and the bits of every byte value.
MIX = np.uint64(0xBF58476D1CE4E5B9)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the case-folded text, repeats included."""
    words = text.translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    count = max(1, len(words) - words_per_shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:count].tolist()
    stops = (ends[min(words_per_shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, count
    )


def majorities(hashes: np.ndarray, n: int) -> list[int]:
    """``n`` fingerprints: a bit is set if it is set in over half of the hashes.  The first takes
    the hashes as they are, every further one a remix of them."""
    out = []
    for r in range(n):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), BLOCK):
            block = hashes[at : at + BLOCK]
            if r:
                block = (block ^ np.uint64(r)) * MIX
                block = (block ^ (block >> np.uint64(29))) * MIX
                block ^= block >> np.uint64(32)
            parts = block.astype(">u8").view(np.uint8).reshape(-1, N_BYTES).T
            for b, values in enumerate(parts):
                counts[8 * b : 8 * b + 8] += np.bincount(values, minlength=256) @ BITS
        out.append(int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    n_prints: int = 1,
) -> DataFrame:
    """(doc_id, fps): the fingerprints as signed longs."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [
                majorities(shingle_hashes(t, words_per_shingle), n_prints)
                for t in raw_texts(batch.column("text"))
            ]
            fps = np.array(marks, np.uint64).reshape(-1, n_prints).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fps"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, fps array<long>")


def covering(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - max_bits positions contain one of them.

    Up to two bits, pairs of two-byte blocks are enough; beyond, all sets of four positions are
    (for three and four bits).
    """
    if max_bits <= 2:
        blocks = [(0, 1), (2, 3), (4, 5), (6, 7)]
        return [a + b for a, b in combinations(blocks, 2)]
    if max_bits <= 4:
        return list(combinations(range(N_BYTES), 4))
    raise ValueError("max_bits may be 0 to 4: beyond, pairs share too few bytes for an index")


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def shared_bytes(a: Column, b: Column) -> Column:
    """The number of positional bytes that two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum(
        (F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(N_BYTES)),
        F.lit(0),
    )


def links(marks: DataFrame, max_bits: int = 2, list_rows: int = 64) -> DataFrame:
    """(r, a, b) of distinct fingerprints ``fp`` of kind ``r``: links whose components are those of
    all pairs of one kind that differ in at most ``max_bits`` bits."""
    sets = covering(max_bits)
    # A posting key is named by a hash of kind, positions and bytes; should two keys collide, their
    # lists merge, and the pairs are told apart below.
    keys = [
        F.struct(
            F.lit(i).alias("at"),
            F.xxhash64("r", F.lit(i), F.col("fp").bitwiseAND(F.lit(_mask(s)))).alias("key"),
        )
        for i, s in enumerate(sets)
    ]
    posting = marks.select("r", "fp", F.explode(F.array(*keys)).alias("p")).select("r", "fp", "p.at", "p.key")
    sizes = stash(posting.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    short, long = sizes.where(F.col("n") <= list_rows), sizes.where(F.col("n") > list_rows)
    # The number of shared keys grows with the corpus: always a join by key, never a broadcast.
    met = posting.select("r", "fp", "key").join(short.select("key").hint("merge"), "key")
    pairs = (
        met.alias("x")
        .join(met.alias("y"), ["key", "r"])
        .where("x.fp < y.fp")
        .select("r", F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .where(shared_bytes(F.col("a"), F.col("b")) >= N_BYTES - max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    )
    if long.isEmpty():
        return pairs.distinct()
    if max_bits != 2:
        raise ValueError("posting lists too long for pairing are linked for two bits only")
    crowd = posting.join(long.select("key"), "key")
    opened = [[b for p in range(N_BYTES) if p not in s for b in range(8 * p, 8 * p + 8)] for s in sets]
    flips = F.array(
        *[
            F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b) for b in bits])
            for bits in opened
        ]
    )
    values = F.transform(flips[F.col("at")], lambda m: F.col("fp").bitwiseXOR(m))
    sent = crowd.select("r", "fp", F.explode(values).alias("value")).distinct()
    first = sent.groupBy("r", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    near = sent.join(first, ["r", "value"]).where("fp <> a").select("r", "a", F.col("fp").alias("b"))
    return pairs.union(near).distinct()


def linked(rows: DataFrame, max_bits: int) -> DataFrame:
    """(node, root) over document ids: documents that share a fingerprint of one kind, or whose
    fingerprints of one kind link, belong together."""
    own = rows.where("doc_id IS NOT NULL").select("doc_id", F.posexplode("fps").alias("r", "fp"))
    marks = stash(own.groupBy("r", "fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    crowds = marks.where("n > 1").select("r", "fp", "first_id")
    same = own.join(crowds, ["r", "fp"]).select(F.col("first_id").alias("a"), F.col("doc_id").alias("b"))
    near = (
        links(marks, max_bits)
        .join(marks.select("r", F.col("fp").alias("a"), F.col("first_id").alias("id_a")), ["r", "a"])
        .join(marks.select("r", F.col("fp").alias("b"), F.col("first_id").alias("id_b")), ["r", "b"])
        .select("id_a", "id_b")
    )
    return components(same.union(near))


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id that
    links reach)."""
    rows = stash(fingerprints(docs, id_col, text_col, words_per_shingle))
    found = linked(rows, max_bits)
    return rows.join(found, rows.doc_id == found.node, "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"),
        F.coalesce("root", "doc_id").alias("component_id"),
    )


def position_sets(n_bytes: int, n_keys: int, size: int = 3) -> list[tuple[int, ...]]:
    """``n_keys`` sets of byte positions, disjoint within every round over all positions."""
    rng, out = np.random.default_rng(0), []
    while len(out) < n_keys:
        order = rng.permutation(n_bytes).tolist()
        out += [tuple(order[i : i + size]) for i in range(0, n_bytes - size + 1, size)]
    return out[:n_keys]


def forest(
    prints: np.ndarray, max_bits: int, alike: Callable[[int, np.ndarray], np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the rows that differ in at most ``max_bits`` bits and that ``alike``, if
    given, takes too: every row is compared with the rows not reached yet, and at most one edge per
    row comes out."""
    unseen, edges = np.arange(len(prints)), []
    while len(unseen):
        stack, unseen = [int(unseen[0])], unseen[1:]
        while stack and len(unseen):
            a = stack.pop()
            near = np.bitwise_count(prints[unseen] ^ prints[a]).sum(axis=1, dtype=np.int64) <= max_bits
            if alike is not None and near.any():
                near[near] = alike(a, unseen[near])
            edges += [(a, b) for b in unseen[near].tolist()]
            stack += unseen[near].tolist()
            unseen = unseen[~near]
    return edges


def block_pairs(met: DataFrame, name: str) -> DataFrame:
    """``met`` (id, ``name``, n, ...) with (low, high): the ``n`` rows of a name meet in blocks of
    about ``LIST_BLOCK``, every two blocks in one group, so a group is bounded."""
    met = met.withColumn("blocks", F.ceil(F.col("n") / LIST_BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    block = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda c: F.struct(F.least("own", c).alias("low"), F.greatest("own", c).alias("high")),
        )
    )
    rest = [c for c in met.columns if c not in ("id", name, "n", "blocks", "own")]
    return met.select("id", name, *rest, block.alias("block")).select("id", name, *rest, "block.*")


def wide_links(
    marks: DataFrame, n_prints: int, n_keys: int, max_bits: int, keys: str | None = None
) -> DataFrame:
    """(a, b): links of ``marks`` (id, fps) whose components are those of all pairs that share a
    posting key and differ in at most ``max_bits`` of all bits.

    Posting keys are the column ``keys`` if named, else ``n_keys`` values of three of the
    8 ``n_prints`` positional bytes.
    """

    def byte(at: int) -> Column:
        return F.shiftrightunsigned(F.col("fps")[at // N_BYTES], 8 * (at % N_BYTES)).bitwiseAND(F.lit(0xFF))

    if keys is None:
        sets = position_sets(N_BYTES * n_prints, n_keys)
        values = F.array(*[F.xxhash64(F.lit(i), *[byte(p) for p in s]) for i, s in enumerate(sets)])
    else:
        values = F.col(keys)
    posting = marks.select("id", F.explode(values).alias("key"))
    sizes = stash(posting.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # The number of shared keys grows with the corpus: always a join by key, never a broadcast.
    met = block_pairs(posting.join(sizes.hint("merge"), "key"), "key")
    group = ["key", "low", "high"]
    rows = met.join(marks.select("id", "fps").hint("merge"), "id")
    kind = marks.schema["id"].dataType.simpleString()
    id_type = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, prints = None, [], []
        out: list[tuple] = []

        def close() -> None:
            if len(ids) > 1:
                found = forest(np.array(prints, np.int64).view(np.uint64), max_bits)
                out.extend((ids[a], ids[b]) for a, b in found)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*group, "id", "fps")]
            for *name, i, fps in zip(*columns, strict=True):
                if name != held:
                    close()
                    held, ids, prints = name, [], []
                ids.append(i)
                prints.append(fps)
            yield edge_batch(out, id_type)
        close()
        yield edge_batch(out, id_type)

    met = rows.select(*group, "id", "fps").repartition(*group).sortWithinPartitions(*group)
    return met.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def edge_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """The edges held in ``out``, which is emptied."""
    ends = [pa.array([edge[k] for edge in out], kind) for k in (0, 1)]
    out.clear()
    return pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def minima_keys(shingles: np.ndarray, n_keys: int) -> list[int]:
    """Posting keys of a shingle set, as signed longs: each names ``KEY_MINIMA`` minimal hashes, so
    two sets share one with their Jaccard similarity to that power."""
    factors = np.random.default_rng(1).integers(0, 1 << 64, n_keys * KEY_MINIMA, np.uint64) | np.uint64(1)
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), MINIMA_BLOCK):
        low = np.minimum(low, (factors[:, None] * shingles[at : at + MINIMA_BLOCK]).min(axis=1))
    rows = low.reshape(n_keys, KEY_MINIMA)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_marks(
    docs: DataFrame, words_per_shingle: int, n_prints: int, n_keys: int, words_per_bit: int
) -> DataFrame:
    """(doc_id, text) to (doc_id, text_sha256, mark, fps, keys, fp): ``mark`` is a digest of the set
    of shingles, the fingerprints and keys are those of the set; ``fp`` is the text's fingerprint in
    ``simhash_dedup``."""
    small_text_batches(docs.sparkSession)
    schema = "doc_id long, text_sha256 string, mark binary, fps array<long>, keys array<long>, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            shas, marks, fps, keys, fp = [], [], [], [], []
            for text in raw_texts(batch.column("text")):
                shingles = np.unique(shingle_hashes(text, words_per_shingle))
                shas.append(hashlib.sha256(text).hexdigest())
                marks.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                prints = majorities(shingles, n_prints)
                fps.append(np.array(prints, np.uint64).view(np.int64).tolist())
                keys.append(minima_keys(shingles, n_keys))
                fp += majorities(shingle_hashes(text, words_per_bit), 1)
            columns = [pa.array(shas, pa.string()), pa.array(marks, pa.binary())]
            columns += [pa.array(fps, longs), pa.array(keys, longs)]
            columns.append(pa.array(np.array(fp, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns],
                names=["doc_id", "text_sha256", "mark", "fps", "keys", "fp"],
            )

    return docs.mapInArrow(run, schema)


def set_links(near: DataFrame, words_per_shingle: int, similarity: float, max_bits: int) -> DataFrame:
    """(a, b): links of ``near`` (root, low, high, id, fps, text) whose components are those of all
    pairs of one group that differ in at most ``max_bits`` bits and whose shingle sets have a Jaccard
    similarity of at least ``similarity``."""
    group = ["root", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, prints, sets = None, [], [], []
        out: list[tuple] = []

        def close() -> None:
            sizes = np.array([len(s) for s in sets])

            def alike(a: int, rest: np.ndarray) -> np.ndarray:
                mine, own = sets[a], sizes[rest]
                taken = np.minimum(own, len(mine)) >= similarity * np.maximum(own, len(mine)) - 1e-6
                if not len(mine) or not taken.any():
                    return np.zeros(len(rest), bool)
                tried, own = rest[taken], own[taken]
                theirs = np.concatenate([sets[i] for i in tried])
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                owner = np.repeat(np.arange(len(tried)), own)
                shared = np.bincount(owner, mine[at] == theirs, len(tried))
                taken[taken] = shared / (len(mine) + own - shared) >= similarity
                return taken

            if len(ids) > 1:
                found = forest(np.array(prints, np.int64).view(np.uint64), max_bits, alike)
                out.extend((ids[a], ids[b]) for a, b in found)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*group, "id", "fps")]
            for *name, i, fps, text in zip(*columns, raw_texts(batch.column("text")), strict=True):
                if name != held:
                    close()
                    held, ids, prints, sets = name, [], [], []
                if ids and ids[-1] == i:
                    continue  # the text is there more than once
                ids.append(i)
                prints.append(fps)
                sets.append(np.unique(shingle_hashes(text, words_per_shingle)))
            yield edge_batch(out, pa.binary())
        close()
        yield edge_batch(out, pa.binary())

    met = near.select(*group, "id", "fps", "text").repartition(*group).sortWithinPartitions(*group, "id")
    return met.mapInArrow(run, "a binary, b binary").distinct()


def near_groups(
    docs: DataFrame,
    words_per_shingle: int,
    similarity: float,
    n_prints: int,
    n_keys: int,
    words_per_bit: int,
    bits: int,
) -> DataFrame:
    """(doc_id, text_sha256, kept) of (doc_id, text): of each group of near copies the row with the
    smallest id, null after all others, is kept."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi  # the cosine of sets of one size
    n_bits = 64 * n_prints
    max_bits = math.ceil(n_bits * share + SPREAD * math.sqrt(n_bits * share * (1 - share)))
    rows = stash(shingle_marks(docs, words_per_shingle, n_prints, n_keys, words_per_bit))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256"))
    marks = rows.groupBy("mark").agg(first.alias("first"), F.first("fps").alias("fps"), F.first("keys").alias("keys"))
    # A name in the order of the ids, so the smallest name of a component is the row that stays.
    name = F.concat(
        F.when(F.col("first.none"), "01").otherwise("00"),
        F.lpad(F.hex(F.coalesce("first.doc_id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"),
        F.hex("mark"),
    )
    marks = stash(marks.select(F.unhex(name).alias("id"), "mark", "first", "fps", "keys"))
    # The byte-position index with count filtering; texts of one set may differ in their prints.
    prints = rows.select("mark", "fp").distinct().join(marks.select("id", "mark"), "mark")
    alike = linked(prints.select(F.col("id").alias("doc_id"), F.array("fp").alias("fps")), bits)
    loose = stash(components(wide_links(marks, n_prints, n_keys, max_bits, "keys")))
    sizes = loose.groupBy("root").agg((F.count("*") + 1).alias("n"))
    members = loose.select(F.col("node").alias("id"), "root").union(
        sizes.select(F.col("root").alias("id"), "root")
    )
    members = members.join(sizes, "root").join(
        marks.select("id", "fps", F.col("first.text_sha256").alias("text_sha256")), "id"
    )
    texts = docs.select("text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    near = block_pairs(members, "root").join(texts, "text_sha256")
    links = alike.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(links.union(set_links(near, words_per_shingle, similarity, max_bits)))
    stays = marks.join(found.where("node <> root"), F.col("id") == F.col("node"), "left_anti")
    kept = (F.col("text_sha256") == F.col("first.text_sha256")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return rows.select("doc_id", "text_sha256", "mark").join(stays.select("mark", "first"), "mark", "left").select(
        "doc_id", "text_sha256", F.coalesce(kept, F.lit(False)).alias("kept")
    )


def drop_near(
    docs: DataFrame,
    words_per_shingle: int = 5,
    similarity: float = 0.8,
    n_prints: int = 8,
    n_keys: int = 24,
    words_per_bit: int = 3,
    bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the smallest id.

    Near copies are linked if ``simhash_dedup`` links them (fingerprints of ``words_per_bit`` words
    that differ in at most ``bits`` bits, met through the byte-position index, without loss), or if
    the Jaccard similarity of their sets of shingles is ``similarity`` or more.  Only how the latter meet is left to chance: a pair at 0.8 shares none of ``n_keys`` keys of
    three minimal hashes with probability 3e-8, and the bits of ``n_prints`` fingerprints part only
    rows that differ in ``SPREAD`` standard deviations more than is expected at 0.8 (142 of 512
    bits).  Rows that meet loosely make components; inside them shingle sets are compared.

    A row is named by its text: rows whose id is null or repeated are compared and dropped like any
    other, a null id orders after every other id, and of rows with one id and text one stays.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    decided = stash(near_groups(texts, words_per_shingle, similarity, n_prints, n_keys, words_per_bit, bits))
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return rows_that_stay(docs, decided, sha, id_col, text_col)
