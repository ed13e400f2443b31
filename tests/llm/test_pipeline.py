"""The stages one after another over odd rows and over empty tables."""

import numpy as np
import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string"


def written(spark, folder, docs, labels, benchmark):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_over_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = np.array("the of and to in that is was for it with as his on be at by this had not".split())
    good = [". ".join(rng.choice(words, 60)) + f" {i}." for i in range(90)]
    junk = ["$$$ ".join(w.upper() for w in rng.choice(words, 40)) for _ in range(40)]
    item = " ".join(f"item{k}" for k in range(12))
    docs = [(i, t) for i, t in enumerate([*good, *junk])]
    docs += [(200, good[0]), (201, good[1] + " tail"), (202, f"{good[2]} {item}"), (None, good[3] + " own words here and there"), (None, None)]
    docs += [(203, ""), (204, " " * 50_000), (3, good[4] + " another text of this id in full length"), (205, good[5] + " " + "of the and " * 5_000)]
    labels = [(i, 1, 0) for i in range(90)] + [(90 + i, 0, 0) for i in range(40)] + [(5, None, None)]
    folder = written(spark, tmp_path, docs, labels, [(1, item), (2, None), (3, "")])
    out = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in out}
    assert len(kept & set(range(90))) > 80 and not kept & set(range(90, 130))
    assert 200 not in kept and 201 not in kept and 202 not in kept
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("empty", ["documents", "labels and benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    docs = [] if empty == "documents" else [(1, "one text"), (2, "one text"), (3, "another text")]
    folder = written(spark, tmp_path, docs, [], [])
    assert len({r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}) == (0 if not docs else 2)
