"""Folds and negative construction as equi-joins on dense positions.

A draw never compares a row with all candidates.  Candidates get dense positions; a draw is an
integer position below the number of eligible candidates, shifted past the block of its own
group where that group is not eligible, and an equi-join fetches the candidate.  Draws come from
MD5 of (row id, seed, draw number): the same on every engine, partitioning and retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.functions.text import unit_hash
from pairgate.operators.ordered import dense_index, running_totals


def draw(n: Column, *parts: Column | str) -> Column:
    """Uniform integer in [0, n) determined by the parts."""
    return F.floor(unit_hash(*parts) * n).cast("long")


def draw_distinct(n: Column, count: Column | int, row: str, seed: int) -> Column:
    """Array of ``count`` different integers in [0, n), without replacement; NULL if n < count.

    Draw j picks among the n - j positions not taken yet and is shifted past the taken ones.  The
    draws are folded over one accumulator, so the plan has one size for every count.
    """
    many = F.lit(count) if isinstance(count, int) else count

    def add(taken: Column, j: Column) -> Column:
        raw = draw(n - j, row, F.lit(seed), j)
        moved = F.aggregate(
            F.array_sort(taken), raw, lambda acc, t: F.when(acc >= t, acc + 1).otherwise(acc)
        )
        return F.concat(taken, F.array(moved))

    none = F.array().cast("array<bigint>")
    drawn = F.aggregate(F.sequence(F.lit(0), many - 1), none, add)
    return F.when(n >= many, F.when(many > 0, drawn).otherwise(none))


def assign_folds(df: DataFrame, group: str, *, n_splits: int, seed: int, name: str = "fold") -> DataFrame:
    """Grouped folds: no group spans two folds, and folds differ by one group at most.

    The distinct groups are numbered in hash order and dealt modulo ``n_splits``, whatever their
    number.  A null group is a group.
    """
    groups = df.select(F.col(group).alias("__g")).distinct()
    hashed = groups.withColumn("__h", key_of("__g", seed)).withColumn("__t", F.xxhash64("__g").cast("double"))
    dealt = dense_index(hashed, [], "__h", tie="__t", name="__i").select(
        "__g", (F.col("__i") % n_splits).cast("int").alias(name)
    )
    return df.join(dealt, df[group].eqNullSafe(dealt["__g"])).drop("__g")


def key_of(group: str, seed: int) -> Column:
    """The hash that orders groups; null counts as an empty text."""
    return unit_hash(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(seed))


def shuffled_negatives(
    positives: DataFrame,
    *,
    k: int,
    seed: int,
    row: str = "pair_id",
    fold: str = "fold",
    cluster: str = "antigen_cluster",
    item: str = "antigen_seq",
) -> DataFrame:
    """k negatives per positive: same fold, another cluster, clusters as frequent as among positives.

    The cluster of a negative is the cluster of a uniformly drawn positive of the fold outside the
    own cluster; the antigen is uniform within that cluster.  A fold with one cluster yields none.
    """
    sizes = positives.groupBy(fold, cluster).agg(F.count(F.lit(1)).alias("w"))
    spans = dense_spans(sizes, fold, cluster, "w")
    # Bins as wide as a fold's mean cluster: all spans together touch at most two bins per cluster,
    # and a bin holds two clusters on average.
    fold_totals = sizes.groupBy(fold).agg(
        F.sum("w").alias("total"), F.ceil(F.sum("w") / F.count(F.lit(1))).alias("width")
    )
    own = spans.select(fold, cluster, F.col("lo").alias("own_lo"), F.col("w").alias("own_w"))
    drawn = (
        positives.select(row, fold, cluster)
        .join(own, [fold, cluster])
        .join(fold_totals, fold)
        .withColumn("room", F.col("total") - F.col("own_w"))
        .where(F.col("room") > 0)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("raw", draw(F.col("room"), row, F.lit(seed), F.col("j"), F.lit("cluster")))
        .withColumn("at", F.col("raw") + F.when(F.col("raw") >= F.col("own_lo"), F.col("own_w")).otherwise(0))
        .select(row, fold, "j", "at", F.floor(F.col("at") / F.col("width")).alias("bin"))
    )
    # Range join by bins: a span is listed in every bin it touches, a draw looks in one bin.
    binned = spans.join(fold_totals, fold).select(
        fold,
        F.col(cluster).alias("neg_cluster"),
        "lo",
        (F.col("lo") + F.col("w")).alias("hi"),
        F.explode(
            F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("lo") + F.col("w") - 1) / F.col("width")))
        ).alias("bin"),
    )
    hits = drawn.join(binned, [fold, "bin"]).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    pool = indexed_items(positives.select(fold, cluster, item).distinct(), [fold, cluster], item)
    pool_sizes = pool.groupBy(fold, cluster).agg(F.count(F.lit(1)).alias("pool"))
    picked = (
        hits.select(row, fold, "j", F.col("neg_cluster").alias(cluster))
        .join(pool_sizes, [fold, cluster])
        .withColumn("item_index", draw(F.col("pool"), row, F.lit(seed), F.col("j"), F.lit("item")))
        .join(pool, [fold, cluster, "item_index"])
    )
    return picked.select(row, "j", fold, cluster, item)


def dense_spans(sizes: DataFrame, part: str, key: str, weight: str) -> DataFrame:
    """Lay the keys of each part end to end: key covers positions [lo, lo + weight)."""
    hashed = sizes.withColumn("__h", unit_hash(F.col(key)))
    ordered = running_totals(hashed, [part], "__h", [weight], tie=key)
    return ordered.select(part, key, weight, F.col(f"before_{weight}").cast("long").alias("lo"))


def indexed_items(items: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Distinct items numbered 0.. within their keys, in hash order."""
    hashed = items.withColumn("__h", unit_hash(F.col(item)))
    return dense_index(hashed, keys, "__h", tie=item, name="item_index").drop("__h")


def pool_negatives(positives: DataFrame, pool: DataFrame, *, k: int, seed: int, row: str, item: str) -> DataFrame:
    """k different pool items per positive; a pool smaller than k raises ValueError."""
    numbered = indexed_items(pool.select(item).distinct(), [], item)
    size = numbered.count()
    if k > size:
        raise ValueError(f"k={k} exceeds negative pool size {size}")
    picks = draw_distinct(F.lit(size).cast("long"), k, row, seed)
    return (
        positives.select(row, F.posexplode(picks).alias("j", "item_index"))
        .join(numbered, "item_index")
        .select(row, "j", item)
    )


def wrong_targets(
    binders: DataFrame, donors: DataFrame, *, m: int, seed: int, row: str = "example_id", key: str = "target_key"
) -> DataFrame:
    """Up to m donors per binder, drawn without replacement among those with another target key.

    Donors of one key sit next to each other, so "every donor but my key's" is the whole range
    without one block.  A binder with fewer than m eligible donors gets all of them.
    """
    sized = donors.groupBy(key).agg(F.count(F.lit(1)).alias("w")).withColumn("part", F.lit(0))
    spans = dense_spans(sized, "part", key, "w").drop("part")
    within = dense_index(donors.select(key, row).withColumn("__h", unit_hash(F.col(row))), [key], "__h", tie=row, name="at")
    placed = within.join(spans, key).select(
        (F.col("lo") + F.col("at")).alias("position"), F.col(row).alias("donor_id")
    )
    total = donors.count()
    room = F.lit(total).cast("long") - F.coalesce(F.col("w"), F.lit(0))
    lo = F.coalesce(F.col("lo"), F.lit(total).cast("long"))
    eligible = binders.select(row, key).join(spans, key, "left").select(
        row, key, room.alias("room"), lo.alias("own_lo"), F.coalesce("w", F.lit(0)).alias("own_w")
    )
    count = F.least(F.lit(m).cast("long"), F.greatest(F.col("room"), F.lit(0).cast("long")))
    picks = draw_distinct(F.col("room"), count.cast("int"), row, seed)
    return (
        eligible.select(row, "own_lo", "own_w", F.posexplode(picks).alias("j", "raw"))
        .withColumn("position", F.col("raw") + F.when(F.col("raw") >= F.col("own_lo"), F.col("own_w")).otherwise(0))
        .join(placed, "position")
        .select(row, (F.col("j") + 1).alias("pick"), "donor_id")
    )


def scramble_loops(sequence: Column | str, loops: Column | str, row: Column | str, seed: int, variant: Column | int) -> Column:
    """Permute residues inside each loop, leave the framework alone.

    ``loops`` is an array of arrays of 0-based positions.  Inside a loop, residues are reordered
    by the MD5 of (row, seed, variant, position), which is a uniform random permutation.
    """
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    sets = F.col(loops) if isinstance(loops, str) else loops
    key = F.col(row) if isinstance(row, str) else row
    v = F.lit(variant) if isinstance(variant, int) else variant

    def moved(positions: Column) -> Column:
        keyed = F.transform(positions, lambda p: F.struct(unit_hash(key, F.lit(seed), v, p).alias("h"), p.alias("p")))
        shuffled = F.array_sort(keyed)
        return F.zip_with(
            F.array_sort(positions),
            shuffled,
            lambda to, frm: F.struct(to.alias("k"), F.substring(s, frm["p"] + 1, F.lit(1)).alias("v")),
        )

    changes = F.map_from_entries(F.flatten(F.transform(sets, moved)))
    # Bound once as a one-element array: a lambda body would rebuild the map for every letter.
    bound = F.array(F.struct(F.split(s, "").alias("letters"), changes.alias("changes")))
    scrambled = F.transform(
        bound,
        lambda b: F.array_join(
            F.transform(b["letters"], lambda c, i: F.coalesce(F.try_element_at(b["changes"], i), c)), ""
        ),
    )
    return F.element_at(scrambled, 1)


def pair_violations(negatives: DataFrame, positives: DataFrame, row: str = "pair_id") -> DataFrame:
    """Negatives that break an invariant: same cluster as their positive, or another fold."""
    parent = positives.select(
        F.col(row), F.col("antigen_cluster").alias("__c"), F.col("fold").alias("__f")
    )
    return negatives.join(parent, row).where(
        (F.col("antigen_cluster") == F.col("__c")) | (F.col("fold") != F.col("__f"))
    )
