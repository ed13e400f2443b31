"""Source divergence audit over a K-squared quadtree of the group-term count matrix.

Terms are counted per (lang, source) where documents are scanned, partial counts merged by Spark.
Each language keeps the terms that enough of its documents hold.  The matrix of sources by kept
terms is cut into tiles of 256 x 256, and every tile is a K-squared tree (K = 2): bitmaps of four
bits per node, level by level, whose set bits are numbered by rank; the leaves hold the shares of
the nonzero cells.  A quadrant without any count is one zero bit.

The distance of two sources is the sum of |p - q| over all kept terms.  Where both rows are zero the
shares are the two constants z, so such quadrants cost their width times |z - z'|: a tile is priced
with that for its whole width, no all-zero quadrant is opened, and the trees of two row blocks are
walked down together through the quadrants where one of them holds a count, up to the leaves, which
replace the price of their cell.  Frontiers are numpy arrays on an explicit stack of bounded size.
Partial sums of column blocks are added by Spark; all arithmetic is in whole numbers (shares by
decimals of 38 digits).

A hot source or language is one row per partition and term after the first count; tiles are bounded
by their area, and pairs of row blocks meet per column block.  The result holds all pairs of
sources of a language, as asked.

Defined cases: null text, lang and source are empty strings; a language without kept terms gives
pairs of value 0; groups without terms take part; repeated rows count as often as they occur; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgate.llm.common import LOWER, UPPER, raw_texts, small_text_batches, stash

#: Fixed values of the audit: documents a term needs, what is added to counts, unit of shares, ranks.
MIN_DOCS, ADDED, UNIT, TOP_TERMS = 30, 5, 1_000_000_000, 50

#: Bytes of a term stay (A-Z lower-cased), all others part terms: [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
TERM_BYTES = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b) in LOWER or b >= 0x80 else 0x20 for b in range(256)
)

#: Distinct terms that a task holds before it hands its counts on.
HELD_TERMS = 200_000

#: Sides of a tile: 2**TILE rows by 2**TILE columns.
TILE = 8
#: Quadrant pairs expanded at once.
FRONTIER = 1 << 18

COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to partial (lang, source, term, n, docs); an empty term stands for the
    group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array([docs[t] for t in terms], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for key, text in zip(keys, raw_texts(batch.column("text"))):
            if key not in held:
                held[key] = (Counter({b"": 0}), Counter())
            n, docs = held[key]
            terms = text.translate(TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from handed_on()
    yield from handed_on()


class K2Tree(NamedTuple):
    """Per level the child index of each of a node's four quadrants (-1: all zero), and the leaves."""

    children: list[np.ndarray]
    leaves: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> K2Tree:
        code = np.zeros(len(rows), np.int64)
        for bit in range(TILE):
            code |= ((rows >> bit) & 1) << (2 * bit + 1) | ((cols >> bit) & 1) << (2 * bit)
        order = np.argsort(code)
        code, nodes, children = code[order], np.zeros(1, np.int64), []
        for level in range(1, TILE + 1):
            below = np.unique(code >> 2 * (TILE - level))
            bits = np.zeros((len(nodes), 4), bool)
            bits[np.searchsorted(nodes, below >> 2), below & 3] = True
            rank = np.cumsum(bits).reshape(bits.shape) - 1
            children.append(np.where(bits, rank, -1))
            nodes = below
        return cls(children, values[order])


def walk(left: K2Tree, right: K2Tree, z_left: np.ndarray, z_right: np.ndarray, width: int, same: bool) -> np.ndarray:
    """Sum of |p - q| over ``width`` columns for each row of ``left`` with each of ``right``; with
    ``same`` (one block with itself) only for rows below one another."""
    price = np.abs(z_left[:, None] - z_right[None, :])
    total = price * width
    start = np.zeros(1, np.int64)
    stack = [(0, start, start, start, start)]
    while stack:
        level, u, v, i, j = stack.pop()
        if len(u) > FRONTIER:
            half = len(u) // 2
            stack += [(level, u[:half], v[:half], i[:half], j[:half]), (level, u[half:], v[half:], i[half:], j[half:])]
            continue
        if level == TILE:
            x = np.where(u >= 0, left.leaves[u], z_left[i]) if len(left.leaves) else z_left[i]
            y = np.where(v >= 0, right.leaves[v], z_right[j]) if len(right.leaves) else z_right[j]
            change = np.abs(x - y) - price[i, j]
            # Below 2**53 in all partial sums (256 columns of at most 2 * UNIT), so floats are exact.
            flat = np.bincount(i * len(z_right) + j, change.astype(np.float64), price.size)
            total += np.rint(flat).astype(np.int64).reshape(price.shape)
            continue
        grown: list[list[np.ndarray]] = [[], [], [], []]
        step = TILE - level - 1
        for a in (0, 1):
            for b in (0, 1):
                i2, j2 = 2 * i + a, 2 * j + b
                there = (i2 << step < len(z_left)) & (j2 << step < len(z_right))
                if same:
                    there &= i2 <= j2
                for col in (0, 1):
                    u2 = np.where(u >= 0, left.children[level][u, 2 * a + col], -1)
                    v2 = np.where(v >= 0, right.children[level][v, 2 * b + col], -1)
                    keep = there & ((u2 >= 0) | (v2 >= 0))
                    for part, found in zip(grown, (u2, v2, i2, j2)):
                        part.append(found[keep])
        u, v, i, j = (np.concatenate(part) for part in grown)
        if len(u):
            stack.append((level + 1, u, v, i, j))
    return total


PAIR_SUMS = "lang string, g long, h long, value long"


def tile_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of tiles to the distances of their rows, added up over the tiles of a task."""
    held: dict[tuple[str, int, int], np.ndarray] = {}
    real: dict[tuple[str, int, int], np.ndarray] = {}

    def handed_on():
        for (lang, rl, rr), total in held.items():
            wanted = real[lang, rl, rr]
            i, j = np.nonzero(np.triu(wanted, 1) if rl == rr else wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array((rl << TILE) + i), pa.array((rr << TILE) + j), pa.array(total[i, j])],
                names=["lang", "g", "h", "value"],
            )
        held.clear()
        real.clear()

    def tree(cells) -> K2Tree:
        flat = cells.values
        return K2Tree.build(*[flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])

    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            key = (row["lang"].as_py(), row["rl"].as_py(), row["rr"].as_py())
            z = [np.array(row[c].as_py(), np.int64) for c in ("z_l", "z_r")]
            total = walk(tree(row["cells_l"]), tree(row["cells_r"]), *z, row["width"].as_py(), key[1] == key[2])
            held[key] = held[key] + total if key in held else total
            real[key] = (z[0] > 0)[:, None] & (z[1] > 0)[None, :]
        if sum(t.size for t in held.values()) > 1 << 20:
            yield from handed_on()
    yield from handed_on()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)), exactly."""
    over = (count.cast("decimal(18,0)") + ADDED).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    under = total.cast("decimal(19,0)") + F.lit(ADDED).cast("decimal(1,0)") * terms.cast("decimal(18,0)")
    quotient = F.call_function("div", over, F.nullif(under, F.lit(0).cast("decimal(1,0)")))
    return (F.coalesce(quotient, F.lit(0)) + 1).cast("long")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered along ``order``, so that neighbours of one language share blocks of numbers."""
    placed = stash(df).repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(placed.withColumn(name, F.monotonically_increasing_id()))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    small_text_batches(docs.sparkSession)
    texts = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.col("text").cast("string").alias("text"),
    )
    counts = stash(
        texts.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = numbered(terms.where(F.col("docs") >= min_docs).drop("docs"), ["lang", "term"], "t")
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("v"))

    cells = stash(counts.where("term <> ''").drop("docs").join(terms, ["lang", "term"]))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["group_n", "lang_n", "v"])
    groups = numbered(groups.withColumn("z", share(F.lit(0), F.col("group_n"), F.col("v"))), ["lang", "source"], "g")

    shares = stash(
        cells.join(groups, ["lang", "source"]).select(
            "lang",
            "source",
            "term",
            "t",
            "g",
            share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"),
            share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"),
        )
    )
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = (
        shares.where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= top_terms)
    )

    tile, inside = (lambda c: F.shiftright(c, TILE)), F.lit((1 << TILE) - 1)
    made = shares.groupBy("lang", tile("g").alias("r"), tile("t").alias("c")).agg(
        F.collect_list(F.struct(F.col("g").bitwiseAND(inside).alias("row"), F.col("t").bitwiseAND(inside).alias("col"), "p")).alias("cells")
    )
    rows = groups.groupBy("lang", tile("g").alias("r")).agg(F.array_sort(F.collect_list(F.struct("g", "z"))).alias("gz"))
    cols = terms.groupBy("lang", tile("t").alias("c")).agg(F.count("*").alias("width"))
    # A language without kept terms has one column block of no width.
    cols = cols.unionByName(groups.where("v = 0").select("lang", F.lit(-1).cast("long").alias("c"), F.lit(0).cast("long").alias("width")).distinct())
    grid = rows.join(cols, "lang").join(made, ["lang", "r", "c"], "left")
    none = F.array().cast("array<struct<row:bigint,col:bigint,p:bigint>>")
    grid = stash(grid.withColumn("cells", F.coalesce("cells", none)))
    sides = [
        grid.select(
            "lang",
            "c",
            F.col("r").alias(f"r{s}"),
            "width",
            spread("gz").alias(f"z_{s}"),
            F.col("cells").alias(f"cells_{s}"),
        )
        for s in ("l", "r")
    ]
    met = sides[0].join(sides[1].drop("width"), ["lang", "c"]).where("rl <= rr")
    sums = met.select("lang", "rl", "rr", "width", "z_l", "z_r", "cells_l", "cells_r").mapInArrow(tile_distances, PAIR_SUMS)
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    there_and_back = F.array(
        F.struct(F.col("g").alias("a"), F.col("h").alias("b")), F.struct(F.col("h").alias("a"), F.col("g").alias("b"))
    )
    by_pair = (
        sums.select("lang", F.explode(there_and_back).alias("x"), "value")
        .select("lang", "x.a", "x.b", "value")
        .join(groups.select(F.col("g").alias("a"), "source"), "a")
        .join(groups.select(F.col("g").alias("b"), F.col("source").alias("item")), "b")
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(first))
    )
    return by_pair.unionByName(by_term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def spread(gz: str) -> Column:
    """z of the rows 0.. of a block, up to its last group; 0 where the number is another language's."""
    inside = F.lit((1 << TILE) - 1)
    zs = F.map_from_entries(F.transform(gz, lambda x: F.struct(x["g"].bitwiseAND(inside), x["z"])))
    last = F.element_at(gz, -1)["g"].bitwiseAND(inside)
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.coalesce(F.try_element_at(zs, k), F.lit(0).cast("long")))
