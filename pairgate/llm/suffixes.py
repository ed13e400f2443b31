"""Suffix-array dedup: byte strings that start in more than one place are removed, by prefix doubling.

Doubling starts at positions that sampling keeps in step across texts: Spark counts the anchors of
``repeats`` (32 bytes each) by hash and drops those that occur once, then counts pairs of anchor and
segment.
Where equal anchors lead different segments, Spark sorts the segments by anchor, and within the
sorted pools every byte position is ranked by its first 8 bytes, then by the pair of its own rank
and the rank at a growing offset (8, 16, 32 ... up to the threshold); a position drops out once its
rank is unique, and the positions still alive past the threshold start repeated strings.
Anchors with too many segments for a pool are narrowed by ever longer shared contents, down to a
count of equal window hashes.  Spark itself sorts no position-rank pairs (README, changed methods).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pairgate.llm.repeats import Unit, remove_repeats

THRESHOLD = 400
FIRST = 8


def regroup(order_key: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Give ``places`` ranks by their keys; unique ones get a rank of their own and drop out."""
    order = np.argsort(order_key)
    key, at = order_key[order], places[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    alone = np.bincount(group)[group] == 1
    ranks[at] = np.where(alone, len(ranks) + at, group)
    return np.sort(at[~alone])


def doubling(parts: list[tuple[bytes, int, int]], threshold: int = THRESHOLD) -> list[np.ndarray]:
    """A mask of repeated windows for each (content, windows, count)."""
    first = min(FIRST, threshold)
    sizes = np.array([len(p) for p, _, _ in parts])
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    raw = np.frombuffer(b"".join(p for p, _, _ in parts) + bytes(first), np.uint8).astype(np.uint64)
    stop = np.repeat(ends, sizes)
    places = np.arange(total)
    ranks = total + places  # not ranked yet: alike to no other
    alive = places[places + first <= stop]
    key = np.zeros(total, np.uint64)
    for k in range(first):
        key = (key << np.uint64(8)) | raw[k : k + total]
    alive = regroup(key[alive], alive, ranks)
    length = first
    while length < threshold and len(alive):
        offset = min(length, threshold - length)
        length += offset
        short = alive + length > stop[alive]
        pair = ranks[alive[~short]] * (2 * total) + ranks[alive[~short] + offset]
        ranks[alive[short]] = total + alive[short]
        alive = regroup(pair, alive[~short], ranks)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)
    count = np.array([c for _, _, c in parts])
    repeated = np.zeros(total, bool)
    # A segment that occurs more than once repeats each of its windows.
    weight = np.bincount(ranks[alive], count[owner[alive]], total) if len(alive) else None
    if weight is not None:
        repeated[alive] = weight[ranks[alive]] > 1
    return [
        np.ones(n, bool) if c > 1 else repeated[s : s + n]
        for s, (_, n, c) in zip(starts.tolist(), parts, strict=True)
    ]


def unit(threshold: int = THRESHOLD) -> Unit:
    gram = max(1, min(32, 1 << (max(threshold // 4, 1).bit_length() - 1)))
    widths = tuple(w for w in (64, 16, 4, 1) if w <= max(1, threshold // 4))
    return Unit(window=threshold, gram=gram, widths=widths, words=False)


def suffix_dedup(
    docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    made = remove_repeats(docs, unit(threshold), lambda parts: doubling(parts, threshold), id_col, text_col)
    return made.withColumnRenamed("n_symbols", "n_bytes")
