from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgate.operators import relational as R
from pairgate.operators import sampling as S


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 2, 3), ("b", 1, 9)], "k string, ordinal int, v int")
    first = {r["k"]: (r["v"], r["n"]) for r in R.first_wins(df, ["k"], "ordinal", count="n").collect()}
    last = {r["k"]: r["v"] for r in R.last_wins(df, ["k"], "ordinal").collect()}
    assert first == {"a": (1, 2), "b": (9, 1)} and last == {"a": 3, "b": 9}


def test_strict_lookup_raises(spark):
    left = spark.createDataFrame([("a",), ("z",)], "k string")
    dim = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="no value for z"):
        R.strict_lookup(left, dim, ["k"], "value").collect()


def test_leakage_guard(spark):
    a = spark.createDataFrame([("x",), ("y",)], "s string")
    R.leakage_guard(a, spark.createDataFrame([("q",)], "s string"), ["s"])
    with pytest.raises(R.LeakageError):
        R.leakage_guard(a, spark.createDataFrame([("y",)], "s string"), ["s"])


def test_matrix_pairs(spark):
    wide = spark.createDataFrame([("AAAA", "0.9", "0.2"), ("BBBB", "", "0.8")], "pdb string, AAAA string, BBBB string")
    meta = spark.createDataFrame([("AAAA", 1.0), ("BBBB", 2.0)], "pdb_id string, res double")
    cells = R.unpivot_matrix(wide, "pdb", ["AAAA", "BBBB"])
    got = {r["pair_id"]: r for r in R.matrix_pairs(cells, meta, "pdb_id", {"res": "vhh_res"}, {"res": "ag_res"}).collect()}
    assert set(got) == {"AAAA__AAAA", "AAAA__BBBB", "BBBB__BBBB"}
    assert got["AAAA__BBBB"]["label"] == 0 and got["AAAA__BBBB"]["ag_res"] == 2.0


def test_contrasts_and_labels(spark):
    df = spark.createDataFrame([("POS",), ("SCR",), ("OFF",), ("zzz",)], "label string")
    counts = Counter((r["comparison"], r["y"]) for r in R.contrast_rows(df).collect())
    assert counts[("POS_vs_all_negatives", 0)] == 2 and counts[("POS_vs_OFF", 0)] == 1
    assert sum(counts.values()) == 7
    q = spark.createDataFrame([(3.0, None), (5.0, 0.3)], "rmsd double, dockq_best double")
    rows = Counter((r["label"], r["y"]) for r in R.label_rows(q, R.quality_labels()).collect())
    assert rows[("rmsd<4A", 1)] == 1 and rows[("rmsd<8A", 1)] == 2 and rows[("dockq_best>=0.23", 1)] == 1
    assert ("dockq_best>=0.23", 0) not in rows
    kept = Counter((r["label"], r["y"]) for r in R.label_rows(q, R.quality_labels(missing_dockq_negative=True)).collect())
    assert kept[("dockq_best>=0.23", 0)] == 1


def test_inclusion_flags(spark):
    df = spark.createDataFrame([(" false ",), ("TRUE",), ("",), (None,)], "is_excluded string")
    assert df.where(R.keep_included()).count() == 1
    assert df.where(R.keep_not_excluded()).count() == 3


def test_quotas(spark):
    assert R.proportional_quotas({"vhh": 50, "fab": 30, "scfv": 1}, 10) == {"vhh": 5, "fab": 4, "scfv": 1}
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(12)], "i long, fmt string")
    got = [r["i"] for r in R.quota_head(df, "fmt", "i", 6).orderBy("i").collect()]
    assert got == [0, 1, 2, 3, 4, 5]


def test_quotas_by_hand(spark):
    def one_by_one(sizes, n):
        q = {k: max(1 if v else 0, round(n * v / sum(sizes.values()))) for k, v in sizes.items()}
        for _ in range(max(0, sum(q.values()) - n)):
            q[max(q, key=q.get)] -= 1
        q[max(sizes, key=sizes.get)] += n - sum(q.values())
        return q

    rng = np.random.default_rng(0)
    for _ in range(300):
        sizes = {f"s{i}": int(v) for i, v in enumerate(rng.integers(0, rng.choice([3, 30, 300]), rng.integers(1, 9)))}
        if sum(sizes.values()):
            n = int(rng.integers(1, 40))
            assert R.proportional_quotas(sizes, n) == one_by_one(sizes, n)


def test_folds_are_grouped_and_even(spark):
    groups = [f"g{i % 17}" if i % 18 else None for i in range(200)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i long, g string")
    got = {r["i"]: r["fold"] for r in S.assign_folds(df.repartition(3), "g", n_splits=5, seed=11).collect()}
    assert set(got) == set(range(200))
    folds = {}
    for i, g in enumerate(groups):
        folds.setdefault(g, set()).add(got[i])
    assert all(len(f) == 1 for f in folds.values())
    sizes = [sum(f == {k} for f in folds.values()) for k in range(5)]
    assert sum(sizes) == 18 and max(sizes) - min(sizes) <= 1


def test_many_distinct_draws_plan_quickly(spark):
    df = spark.range(3).withColumn("n", F.lit(60).cast("long") + F.col("id"))
    rows = df.select("n", S.draw_distinct(F.col("n"), 50, "id", 3).alias("d"), S.draw_distinct(F.lit(3).cast("long"), 4, "id", 3).alias("no")).collect()
    assert all(len(set(r.d)) == 50 and 0 <= min(r.d) and max(r.d) < r.n and r.no is None for r in rows)


def positives(spark, n=400):
    rows = []
    for i in range(n):
        fold = i % 2
        cluster = 0 if i % 3 == 0 else 1 + (i % 7)  # a hot cluster with a third of the rows
        rows.append((f"p{i}", f"b{i}", f"ag{cluster}_{i % 4}", cluster, fold))
    rows.append(("lonely", "b", "ag", 99, 7))
    return spark.createDataFrame(rows, "pair_id string, binder_seq string, antigen_seq string, antigen_cluster int, fold int")


def test_shuffled_negatives(spark):
    pos = positives(spark).cache()
    neg = S.shuffled_negatives(pos, k=5, seed=1).cache()
    assert neg.count() == 400 * 5  # the single-cluster fold gives none
    assert S.pair_violations(neg, pos).count() == 0
    # The antigen belongs to the cluster it was drawn for.
    known = pos.select("fold", "antigen_cluster", "antigen_seq").distinct()
    assert neg.join(known, ["fold", "antigen_cluster", "antigen_seq"], "left_anti").count() == 0
    hot = neg.join(pos.select("pair_id", F.col("antigen_cluster").alias("own")), "pair_id").where("own != 0")
    share = hot.agg(F.avg((F.col("antigen_cluster") == 0).cast("double"))).first()[0]
    own = pos.where("fold < 2 and antigen_cluster != 0").groupBy("fold", "antigen_cluster").count()
    sizes = {(r[0], r[1]): r[2] for r in own.collect()}
    total, zero = 200, 67
    expected = sum(c * zero / (total - c) for c in sizes.values()) / sum(sizes.values())
    assert share == pytest.approx(expected, abs=0.05)
    again = {(r["pair_id"], r["j"], r["antigen_seq"]) for r in S.shuffled_negatives(pos.repartition(3), k=5, seed=1).collect()}
    assert again == {(r["pair_id"], r["j"], r["antigen_seq"]) for r in neg.collect()}


def test_pool_negatives(spark):
    pos = spark.createDataFrame([(f"v{i}",) for i in range(300)], "id string")
    pool = spark.createDataFrame([(f"ag{i}",) for i in range(8)], "ag string")
    got = S.pool_negatives(pos, pool, k=5, seed=2, row="id", item="ag").collect()
    per = Counter(r["id"] for r in got)
    assert set(per.values()) == {5} and len({(r["id"], r["ag"]) for r in got}) == 1500
    use = Counter(r["ag"] for r in got)
    assert len(use) == 8 and max(use.values()) < 1.3 * min(use.values())
    with pytest.raises(ValueError):
        S.pool_negatives(pos, pool, k=9, seed=2, row="id", item="ag")


def test_wrong_targets(spark):
    rows = [(f"e{i}", "hot" if i < 20 else f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "example_id string, target_key string")
    key = dict(rows)
    got = S.wrong_targets(df, df, m=3, seed=5).collect()
    per = Counter(r["example_id"] for r in got)
    assert set(per.values()) == {3} and len(per) == 40
    assert all(key[r["example_id"]] != key[r["donor_id"]] for r in got)
    assert len({(r["example_id"], r["donor_id"]) for r in got}) == 120
    two = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "example_id string, target_key string")
    few = Counter(r["example_id"] for r in S.wrong_targets(two, two, m=3, seed=5).collect())
    assert few == {"a": 1, "b": 1, "c": 2}


def test_scramble_keeps_framework(spark):
    df = spark.createDataFrame([("id1", "ABCDEFGHIJKLMNOP", [[2, 3, 4, 5], [9, 10, 11]])], "id string, s string, loops array<array<int>>")
    outs = {df.select(S.scramble_loops("s", "loops", "id", 1, v)).first()[0] for v in range(6)}
    for out in outs:
        assert out[:2] == "AB" and out[6:9] == "GHI" and out[12:] == "MNOP"
        assert sorted(out[2:6]) == list("CDEF") and sorted(out[9:12]) == list("JKL")
    assert len(outs) > 2


def test_leaderboard(spark):
    rows = [
        ("all", "cmp", "iptm", "10", "4", "6", "", "0.7", "0.6"),
        ("all", "cmp", "ptm", "10", "4", "6", "0.4", "0.7", "0.6"),
        ("vhh", "cmp", "pae_interface_mean", "10", "4", "6", "", "0.99", "0.99"),
        ("all", "cmp", "iptm", "x", "4", "6", "", "nan", "0.9"),
        ("all", "", "iptm", "10", "4", "6", "", "0.9", "0.9"),
    ]
    t = spark.createDataFrame(rows, "stratum string, comparison string, metric string, n string, n_positive string, n_negative string, baseline_ap string, auroc string, ap string")
    c = R.family_candidates(t, "af2m", ["iptm", "ptm", "pae_interface_mean"], "t.csv", totals_only=True)
    best = R.best_per_group(c, ["comparison", "family"]).collect()
    assert len(best) == 1 and best[0]["best_metric"] == "ptm" and best[0]["baseline_ap"] == 0.4
    assert c.where("best_metric = 'iptm'").first()["baseline_ap"] == 0.4
