"""Gate reports: nested rungs, transfer between datasets, the sequence ladder, frozen evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate import constants as C
from pairgate.functions import text as X
from pairgate.functions import vectors as V
from pairgate.functions.numeric import all_finite, missing_flag, strict_double
from pairgate.functions.sequence import pair_features
from pairgate.operators import bilinear, linear, resampling, sampling, similarity, wide
from pairgate.operators import metrics as M
from pairgate.operators import relational as R
from pairgate.operators.linear import LinearGate


def rung_table(features: DataFrame) -> DataFrame:
    """Typed columns of all rungs from the text feature table; unreadable numbers raise."""
    numeric = [c for c in C.rung_columns(3) if c != "interface_plddt_missing"]
    return features.select(
        "pair_id",
        F.col("label").cast("int").alias("label"),
        F.col("fold").cast("int").alias("fold"),
        *[strict_double(c).alias(c) for c in numeric],
        missing_flag("interface_plddt").alias("interface_plddt_missing"),
        strict_double("cdr_mapping_ok").alias("cdr_mapping_ok"),
        F.col("ordinal").cast("long").alias("ordinal"),
    )


def _one(df: DataFrame) -> dict:
    """A single-row result as a dict."""
    return df.first().asDict(recursive=True)


def _gate_block(scored: DataFrame, score: str, threshold: float) -> dict:
    rates = _one(M.confusion(scored, threshold, (), score))
    sweep = M.ppv_sweep(scored.sparkSession.createDataFrame([(rates["recall"], rates["specificity"])], "recall double, specificity double"))
    return {
        "metrics": {"threshold": threshold, **rates},
        "ppv_sweep": [{"prevalence": r["prevalence"], "ppv": r["ppv"]} for r in sweep.orderBy(F.desc("prevalence")).collect()],
    }


def frozen_gate_report(scored: DataFrame, threshold: float, score: str = "score", label: str = "label", *, n_boot: int = 1000, seed: int = 0) -> dict:
    """Counts, threshold metrics and their intervals of a frozen gate on held-out rows."""
    rates = _one(M.confusion(scored, threshold, (), score, label))
    p, n = rates["tp"] + rates["fn"], rates["fp"] + rates["tn"]
    report = {"n": p + n, "n_positive": p, "n_negative": n, "metrics": {"threshold": threshold, **rates}}
    for name, possible in (("recall", p), ("specificity", n), ("precision", p and n)):
        if not possible:
            report[f"{name}_ci"] = [None, None]
            continue
        ci = _one(resampling.bootstrap_ci(scored, name, (), score, label, threshold=threshold, n_boot=n_boot, seed=seed))
        report[f"{name}_ci"] = [ci["ci_low"], ci["ci_high"]]
    return report


def in_distribution(features: DataFrame, *, l2: float, target_precision: float, seed: int, n_boot: int = 1000) -> dict:
    """Four nested rungs on the given folds, paired deltas between them, and an ordinary split."""
    rows = rung_table(features).persist()
    scored, gates, rungs = rows, {}, {}
    for k in range(4):
        names = list(C.rung_columns(k))
        scored = linear.out_of_fold(scored, names, "label", "fold", l2=l2, name=f"rung{k}")
        gates[k] = linear.freeze(rows, names, "label", l2=l2, target_precision=target_precision)
    scored = scored.persist()
    for k in range(4):
        names = list(C.rung_columns(k))
        ci = _one(resampling.bootstrap_ci(scored, "auroc", (), f"rung{k}", n_boot=n_boot, seed=seed))
        rungs[f"rung{k}"] = {
            "features": names,
            "auroc": ci["point"],
            "auroc_ci": [ci["ci_low"], ci["ci_high"]],
            "gate": _gate_block(scored, f"rung{k}", gates[k].threshold),
            "coefficients": [r.asDict() for r in linear.attribution(rows, names, "label", l2=l2).collect()],
        }
    deltas = {}
    for a, b in ((2, 0), (3, 0), (3, 2)):
        area = _one(resampling.paired_delta(scored, "auroc", f"rung{a}", f"rung{b}", n_boot=n_boot, seed=seed))
        rate = _one(
            resampling.paired_delta(scored, "precision", f"rung{a}", f"rung{b}", threshold=gates[a].threshold, n_boot=n_boot, seed=seed)
        )
        deltas[f"r{a}_minus_r{b}"] = {
            "delta_auroc": area["point"], "delta_auroc_ci": [area["ci_low"], area["ci_high"]],
            "delta_precision": rate["point"], "delta_precision_ci": [rate["ci_low"], rate["ci_high"]],
        }
    shuffled = sampling.assign_folds(rows.drop("fold"), "pair_id", n_splits=5, seed=seed).persist()
    random_split = {}
    for k in range(4):
        oof = linear.out_of_fold(shuffled, list(C.rung_columns(k)), "label", "fold", l2=l2)
        random_split[f"rung{k}"] = {"auroc": _one(M.auroc(oof, (), "oof"))["auroc"]}
    size = _one(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), R.failure_rate("cdr_mapping_ok").alias("f")))
    return {
        "n": size["n"],
        "n_positive": size["p"],
        "rungs": rungs,
        "paired_deltas": deltas,
        "random_split": random_split,
        "cdr_mapping_failure_rate": size["f"],
        "frozen_rung": "rung3",
        "frozen_model": gates[3].__dict__,
    }


def _transfer(train: DataFrame, test: DataFrame, rung: int, *, l2: float, target_precision: float, n_boot: int, seed: int) -> dict:
    gate = linear.freeze(train, list(C.rung_columns(rung)), "label", l2=l2, target_precision=target_precision)
    scored = test.withColumn("score", gate.logit())
    return {**frozen_gate_report(scored, gate.threshold, n_boot=n_boot, seed=seed), "auroc": _one(M.auroc(scored))["auroc"]}


def cross_regime(
    first: DataFrame, second: DataFrame, first_pairs: DataFrame, second_pairs: DataFrame,
    *, max_identity: float, l2: float, target_precision: float, n_boot: int, seed: int,
) -> dict:
    """Transfer both ways after dropping rows of the second set whose antigen clusters with the first.

    Pair tables have pair_id, antigen_seq and an ordinal; the last row of a pair id counts.
    """
    one = lambda p: R.last_wins(p.select("pair_id", "antigen_seq", "ordinal"), ["pair_id"], "ordinal")
    overlap = similarity.overlap_with_training(
        one(second_pairs), one(first_pairs), row="pair_id", text="antigen_seq", ordinal="ordinal", max_identity=max_identity
    )
    a, b_all = rung_table(first).persist(), rung_table(second).persist()
    b = b_all.join(overlap, "pair_id", "left_anti").persist()
    total, kept = b_all.count(), b.count()
    opts = {"l2": l2, "target_precision": target_precision, "n_boot": n_boot, "seed": seed}
    both = lambda train, test: {"rung3": _transfer(train, test, 3, **opts), "rung0_contrast": _transfer(train, test, 0, **opts)}
    return {
        "dedup": {"max_identity": max_identity, "total": total, "dropped_as_overlap": total - kept, "kept": kept},
        "first_to_second": both(a, b),
        "second_to_first": both(b, a),
    }


def canary(train: DataFrame, test: DataFrame, killing: DataFrame, *, l2: float, target_precision: float, n_boot: int, seed: int) -> dict:
    """Frozen rungs on the canary set: threshold-free, calibration and killing reads.

    ``killing`` has (vhh_id, label Good or Bad); a positive without a killing label raises.
    """
    fitted, rows = rung_table(train).persist(), rung_table(test)
    gates = {k: linear.freeze(fitted, list(C.rung_columns(k)), "label", l2=l2, target_precision=target_precision) for k in (0, 3)}
    scored = rows.select("*", *[g.logit().alias(f"rung{k}") for k, g in gates.items()]).persist()
    delta = _one(resampling.paired_delta(scored, "auroc", "rung3", "rung0", n_boot=n_boot, seed=seed))
    areas = {k: _one(M.auroc(scored, (), f"rung{k}")) for k in (0, 3)}
    report = lambda k: frozen_gate_report(scored, gates[k].threshold, f"rung{k}", n_boot=n_boot, seed=seed)
    vhh = F.substring_index(F.regexp_replace("pair_id", "^epcam-", ""), "__", 1)
    functional = killing.select("vhh_id", (F.trim("label") == "Good").cast("int").alias("functional"))
    positives = R.strict_lookup(scored.where("label = 1").withColumn("vhh_id", vhh), functional, ["vhh_id"], "killing label")
    kill = _one(M.auroc(positives, (), "rung3", "functional"))
    listed = positives.select("functional", "rung3").orderBy("ordinal").collect()
    return {
        "primary": {
            "rung0_auroc": areas[0]["auroc"], "rung3_auroc": areas[3]["auroc"],
            "delta_auroc_r3_minus_r0": {"point": delta["point"], "ci": [delta["ci_low"], delta["ci_high"]]},
            "n": areas[3]["n"], "n_positive": areas[3]["n_positive"], "n_negative": areas[3]["n_negative"],
        },
        "calibration": {
            "rung3": report(3), "rung0_contrast": report(0),
            "frozen_threshold_rung3": gates[3].threshold, "frozen_threshold_rung0": gates[0].threshold,
        },
        "secondary_killing": {
            "n_functional": kill["n_positive"], "n_nonfunctional": kill["n_negative"], "killing_auroc_rung3": kill["auroc"],
            "functional_scores": [r["rung3"] for r in listed if r["functional"] == 1],
            "nonfunctional_scores": [r["rung3"] for r in listed if r["functional"] == 0],
        },
    }


def _own_threshold_summary(scored: DataFrame, score: str, target_precision: float) -> dict:
    """Gate block with the threshold derived on the same scores."""
    usable = scored.where(F.col(score).isNotNull())
    threshold = M.threshold_for_precision(usable, target_precision, (), score).first()["threshold"]
    return {**_gate_block(usable, score, threshold), "auroc": _one(M.auroc(usable, (), score))["auroc"]}


def sequence_gate_report(features: DataFrame, *, l2: float, target_precision: float, seed: int, n_splits: int = 5) -> tuple[dict, LinearGate]:
    """Sequence gate: grouped out-of-fold report beside the raw predictor score, and the frozen gate."""
    names = list(C.SEQUENCE_FEATURES)
    rows = features.where(all_finite(names)).persist()
    gate = linear.freeze(rows, names, "label", l2=l2, target_precision=target_precision)
    folded = sampling.assign_folds(rows, "antigen_pdb", n_splits=n_splits, seed=seed)
    scored = linear.out_of_fold(folded, names, "label", "fold", l2=l2).persist()
    report = {
        "ms": _own_threshold_summary(scored, "oof", target_precision),
        "iptm_floor": _own_threshold_summary(scored, "iptm", target_precision),
        "shipped_threshold": gate.threshold,
        "attribution": [r.asDict() for r in linear.attribution(rows, names, "label", l2=l2).collect()],
    }
    return report, gate


def example_features(examples: DataFrame, positive_label: str) -> DataFrame:
    """Sequence features of examples from their first chains, with a 0/1 label."""
    binder = X.normalize_binder(F.get("binder_chains", F.lit(0)))
    target = X.normalize_antigen(F.get("target_chains", F.lit(0)))
    label = (F.col("label") == positive_label).cast("int")
    return examples.select("id", _ordinal(examples), label.alias("label"), *pair_features(binder, target))


def _ordinal(examples: DataFrame) -> Column:
    """The rows' own order where they have one, else an order by the hash of the id."""
    own = F.col("ordinal") if "ordinal" in examples.columns else F.xxhash64("id")
    return own.cast("long").alias("ordinal")


def embedded_pairs(pairs: DataFrame, cache: DataFrame, binder: str, antigen: str) -> DataFrame:
    """Add the embeddings u and v of both sides; a sequence missing from the cache raises."""
    left = cache.select(F.col("key").alias(binder), F.col("embedding").alias("u"))
    right = cache.select(F.col("key").alias(antigen), F.col("embedding").alias("v"))
    return R.strict_lookup(R.strict_lookup(pairs, left, [binder], "embedding"), right, [antigen], "embedding")


def embedded_examples(examples: DataFrame, cache: DataFrame, positive_label: str) -> DataFrame:
    rows = examples.select(
        "id",
        _ordinal(examples),
        (F.col("label") == positive_label).cast("int").alias("label"),
        X.normalize_binder(F.get("binder_chains", F.lit(0))).alias("binder_seq"),
        X.normalize_chains("target_chains").alias("antigen_seq"),
    )
    return embedded_pairs(rows, cache, "binder_seq", "antigen_seq")


def orthogonal_report(
    examples: DataFrame, gate: LinearGate, positive_label: str, *, n_boot: int = 1000, seed: int = 0
) -> dict:
    """A frozen sequence gate on the examples of another data set: features, scores, report.

    Examples of which none is left raise ValueError.
    """
    rows = example_features(examples, positive_label)
    if rows.isEmpty():
        raise ValueError("no examples to evaluate")
    return frozen_gate_report(rows.withColumn("score", gate.logit()), gate.threshold, n_boot=n_boot, seed=seed)


def layout_array(layout: str) -> Column:
    """Feature array of a layout over embeddings u and v: concat is 2d long, hadamard d."""
    if layout == "concat":
        return V.concat_pair("u", "v")
    if layout == "hadamard":
        return V.hadamard("u", "v")
    raise ValueError(f"unknown layout: {layout!r}")


def layout_columns(layout: str, d: int) -> list[Column]:
    """``layout_array`` as named columns, for a few dimensions."""
    x = layout_array(layout)
    width = 2 * d if layout == "concat" else d
    return [F.get(x, F.lit(i)).alias(f"f{i}") for i in range(width)]


def sequence_ladder(
    pairs: DataFrame, d: int, training: bilinear.Training, *, l2: float, target_precision: float
) -> tuple[dict, LinearGate | bilinear.BilinearGate]:
    """Composition, concatenated, Hadamard and bilinear rungs on the given folds.

    ``pairs`` has label, fold, ordinal, binder_seq, antigen_seq and embeddings u, v.  The better of the
    last two rungs by out-of-fold AUROC is frozen.
    """
    flat = F.regexp_replace("antigen_seq", ":", "")
    base = pairs.persist()
    keep = ["label", "fold", "ordinal"]
    composition = base.select(*keep, *pair_features("binder_seq", flat))
    rungs = {"rung0": linear.out_of_fold(composition, list(C.SEQUENCE_FEATURES), "label", "fold", l2=l2)}
    for name, layout in (("rung1", "concat"), ("rung2", "hadamard")):
        rungs[name] = wide.out_of_fold(base, layout_array(layout), "label", "fold", l2=l2)
    report = {}
    for name, scored in rungs.items():
        report[name] = _own_threshold_summary(scored.select(*keep, "oof").persist(), "oof", target_precision)
    oof = bilinear.out_of_fold(base, "u", "v", "label", "fold", d, training).select(*keep, "oof").persist()
    report["rung3"] = _own_threshold_summary(oof, "oof", target_precision)
    if (report["rung3"]["auroc"] or 0.0) >= (report["rung2"]["auroc"] or 0.0):
        return report, bilinear.freeze(base, "u", "v", "label", d, training, target_precision=target_precision)
    return report, wide.freeze(base, layout_array("hadamard"), "label", l2=l2, target_precision=target_precision)
