"""Numbering of sequences by position-specific profiles.

A profile says for each position of a domain how much better a residue fits than chance, in whole
hundredths of a bit, so that equal scores are equal on every machine.  ``number_sequences`` finds
the best scoring path of a sequence through each profile (Viterbi): residues take positions in
rising order, a skipped position costs ``skip``, a residue between two positions costs ``extra``,
and what stands before and after the domain costs nothing.  The chain type with the best score
numbers the sequence, if it reaches ``least``.

Of paths that score alike a step goes on from the last residue's position, then from a residue
between positions, then from a skip, then from a start; a skip comes from the nearest position; of
ends the first residue, then the first position; of chain types the first in order.

Distinct sequences are numbered once, many at a time in Arrow batches; the profiles are counted
before they travel with the tasks.  Memory is a byte or two per residue and position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIP, EXTRA = 300, 400
#: Rows that the profile table may have: positions times residues times chain types.
MOST_PROFILE_ROWS = 200_000
#: Residues times positions of one batch of paths.
BATCH_CELLS = 2_000_000
_LOW = -(1 << 40)


def profile_of(aligned: DataFrame, *, pseudo: float = 1.0) -> DataFrame:
    """(chain_type, position, residue, score) from aligned residues (chain_type, position, residue).

    ``score`` is 100 log2 of a residue's smoothed share at the position over its share in the whole
    chain type; residues that a position lacks have their pseudocount's score in ``other`` rows,
    whose residue is NULL and whose share is that of one unseen residue.
    """
    counts = aligned.where("residue IS NOT NULL").groupBy("chain_type", "position", "residue").agg(F.count("*").alias("n"))
    position = counts.groupBy("chain_type", "position").agg(F.sum("n").alias("at"))
    whole = counts.groupBy("chain_type").agg(F.sum("n").alias("all"), F.countDistinct("residue").alias("kinds"))
    share = counts.groupBy("chain_type", "residue").agg(F.sum("n").alias("of"))
    joined = counts.join(position, ["chain_type", "position"]).join(whole, "chain_type").join(share, ["chain_type", "residue"])
    background = F.col("of") / F.col("all")
    hundredths = lambda x: F.round(F.log2(x) * 100).cast("long")
    seen = joined.select(
        "chain_type",
        F.col("position").cast("int").alias("position"),
        "residue",
        hundredths((F.col("n") + pseudo * background) / (F.col("at") + pseudo) / background).alias("score"),
    )
    unseen = position.select(
        "chain_type",
        F.col("position").cast("int").alias("position"),
        F.lit(None).cast("string").alias("residue"),
        hundredths(pseudo / (F.col("at") + pseudo)).alias("score"),
    )
    return seen.unionByName(unseen)


@dataclass(frozen=True)
class Profile:
    """positions: numbers in order; letters: code point -> row of ``scores``; row 0 is any other."""

    chain_type: str
    positions: np.ndarray
    letters: dict[int, int]
    scores: np.ndarray

    @classmethod
    def read(cls, profile: DataFrame) -> list[Profile]:
        """The profiles of a table that was counted to be small."""
        rows = profile.limit(MOST_PROFILE_ROWS + 1).collect()
        if len(rows) > MOST_PROFILE_ROWS:
            raise ValueError(f"a profile has at most {MOST_PROFILE_ROWS} rows")
        out = []
        for chain in sorted({r["chain_type"] for r in rows}):
            own = [r for r in rows if r["chain_type"] == chain]
            positions = sorted({r["position"] for r in own})
            letters = {ord(x): k for k, x in enumerate(sorted({r["residue"] for r in own if r["residue"] is not None}), 1)}
            at = {p: k for k, p in enumerate(positions)}
            scores = np.full((len(letters) + 1, len(positions)), _LOW, np.int64)
            for r in (r for r in own if r["residue"] is None):
                scores[:, at[r["position"]]] = r["score"]
            for r in (r for r in own if r["residue"] is not None):
                scores[letters[ord(r["residue"])], at[r["position"]]] = r["score"]
            out.append(cls(chain, np.array(positions, np.int32), letters, scores))
        return out


def best_paths(profile: Profile, sequences: list[str], skip: int = SKIP, extra: int = EXTRA) -> list[tuple[int, list[tuple[int, int]]]]:
    """(score, [(residue, position index)]) of each sequence; no residues: the lowest score."""
    out: list[tuple[int, list[tuple[int, int]]]] = [(_LOW, [])] * len(sequences)
    order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
    width, at = len(profile.positions), 0
    while at < len(order):
        n = max(1, BATCH_CELLS // (width * len(sequences[order[at]])))
        n = max(1, BATCH_CELLS // (width * len(sequences[order[min(at + n, len(order)) - 1]])))
        rows = order[at : at + n]
        for k, found in zip(rows, _paths(profile, [sequences[k] for k in rows], skip, extra)):
            out[k] = found
        at += n
    return out


def _paths(profile: Profile, sequences: list[str], skip: int, extra: int):
    size = np.array([len(s) for s in sequences])
    width, longest = len(profile.positions), int(size.max())
    letters = np.zeros((len(sequences), longest), np.int64)
    for k, s in enumerate(sequences):
        letters[k, : len(s)] = [profile.letters.get(ord(c), 0) for c in s]
    step = np.arange(width)
    start = np.broadcast_to(-skip * step, (len(sequences), width))
    low = np.full((len(sequences), width), _LOW, np.int64)
    match, between, nothing = low, low, low[:, :1]
    came = np.zeros((longest, len(sequences), width), np.uint8)  # 3 match, 2 between, 1 skip, 0 start
    went_on = np.zeros((longest, len(sequences), width), bool)  # between from between
    skipped_from = np.zeros((longest, len(sequences), width), np.int16)
    best, end = np.full(len(sequences), _LOW, np.int64), np.zeros((len(sequences), 2), np.int64)
    for i in range(longest):
        raised = match + skip * step
        top = np.maximum.accumulate(raised, 1)
        origin = np.maximum.accumulate(np.where(raised == top, step, 0), 1)
        # A skip goes from q to p over p - 1, so its origin is before p - 1.
        skips = np.concatenate((nothing, nothing, top[:, :-2] - skip * (step[2:] - 1)), 1)[:, :width]
        origin = np.concatenate((np.zeros((len(sequences), 2), np.int64), origin[:, :-2]), 1)[:, :width]
        options = np.stack((start, skips, np.concatenate((nothing, between[:, :-1]), 1), np.concatenate((nothing, match[:, :-1]), 1)))
        chosen = 3 - np.argmax(options[::-1], 0)  # of equal ones the last
        came[i], skipped_from[i] = chosen, origin
        now = np.take_along_axis(options, chosen[None], 0)[0] + profile.scores[letters[:, i]]
        went_on[i] = between > match
        between = np.maximum(match, between) - extra
        match = now
        last = match - skip * (width - 1 - step)
        p = np.argmax(last, 1)
        value = np.take_along_axis(last, p[:, None], 1)[:, 0]
        better = (value > best) & (i < size)
        best = np.where(better, value, best)
        end[better] = np.stack((np.full(len(sequences), i), p), 1)[better]
    for k in range(len(sequences)):
        i, p = (int(x) for x in end[k])
        path = [(i, p)]
        while came[i, k, p]:
            how = came[i, k, p]
            if how == 1:
                i, p = i - 1, int(skipped_from[i, k, p])
            elif how == 3:
                i, p = i - 1, p - 1
            else:  # residues between positions, back to the one they follow
                p, i = p - 1, i - 1
                while went_on[i, k, p]:
                    i -= 1
                i -= 1
            path.append((i, p))
        yield int(best[k]), path[::-1]


_NUMBERED = "sequence string, chain_type string, score long, residue_idx array<int>, position array<int>"


def number_sequences(
    sequences: DataFrame, profile: DataFrame, *, least: int = 0, skip: int = SKIP, extra: int = EXTRA, id_col: str = "id", text_col: str = "sequence"
) -> DataFrame:
    """(id, chain_type, score, residue_idx, position): a row per numbered residue, counted from 0.

    Sequences without a path of ``least`` are absent; so are empty and NULL ones.
    """
    profiles = Profile.read(profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("sequence").to_pylist()
            found = [best_paths(p, texts, skip, extra) for p in profiles]
            rows = []
            for k, text in enumerate(texts):
                scored = [(-paths[k][0], n) for n, paths in enumerate(found) if paths[k][1]]
                if scored and -min(scored)[0] >= least:
                    score, n = min(scored)
                    path = found[n][k][1]
                    rows.append((text, profiles[n].chain_type, -score, [i for i, _ in path], [int(profiles[n].positions[p]) for _, p in path]))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["sequence", "chain_type", "score", "residue_idx", "position"]
            )

    rows = sequences.select(F.col(id_col).alias("id"), F.col(text_col).alias("sequence")).where("sequence <> ''")
    numbered = rows.select("sequence").distinct().mapInArrow(run, _NUMBERED)
    flat = rows.join(numbered, "sequence").select(
        "id", "chain_type", "score", F.explode(F.arrays_zip("residue_idx", "position")).alias("x")
    )
    return flat.select("id", "chain_type", "score", "x.residue_idx", "x.position")


def domains(sequences: DataFrame, numbering: DataFrame, id_col: str = "id", text_col: str = "sequence") -> DataFrame:
    """(id, domain): the part of a sequence from its first to its last numbered residue."""
    ends = numbering.groupBy("id").agg(F.min("residue_idx").alias("lo"), F.max("residue_idx").alias("hi"))
    rows = sequences.select(F.col(id_col).alias("id"), F.col(text_col).alias("sequence"))
    part: Column = F.substring("sequence", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)
    return rows.join(ends, "id").select("id", part.alias("domain"))


def accept_numbered(profile: DataFrame, *, least: int = 0, text_col: str = "h_seq"):
    """A filter for the structure loader: candidates whose heavy chain has a numbering."""

    def accept(candidates: DataFrame) -> DataFrame:
        texts = candidates.select(F.col(text_col).alias("sequence"), F.col(text_col).alias("id")).distinct()
        known = number_sequences(texts, profile, least=least).select(F.col("id").alias(text_col)).distinct()
        return candidates.join(known, text_col, "left_semi").select(*candidates.columns)

    return accept
