import zlib

import numpy as np

from pairgate.llm import quality


def brute(x, y, pool, ridge):
    """Textbook form: explicit inverses and determinants."""
    centre, scale = x.mean(0), x.std(0)
    z = (x - centre) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    w = [(y == c).mean() for c in (0, 1)]
    both = w[0] * own[0] + w[1] * own[1]
    out = []
    for c in (0, 1):
        s = (1 - pool) * own[c] + pool * both
        s = (1 - ridge) * s + ridge * np.trace(s) / len(s) * np.eye(len(s))
        d = z - z[y == c].mean(0)
        out.append(np.log(w[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    return 1 / (1 + np.exp(-np.clip(out[1] - out[0], -500, 500)))


def test_fit_equals_textbook_discriminant(spark):
    rng = np.random.default_rng(1)
    k = len(quality.NAMES)
    x = rng.normal(size=(300, k)) @ rng.normal(size=(k, k)) * 0.3
    y = (rng.random(300) < 0.6).astype(int)
    x[y == 1] = x[y == 1] * 1.5 + 0.2
    df = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y)], "statistics array<double>, label int")
    model = quality.fit(df.repartition(3), 0.1, 0.01)
    np.testing.assert_allclose(model.score(x), brute(x, y, 0.1, 0.01), atol=1e-6)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"wo{i}" for i in range(300)])
    for i in range(n):
        w = rng.choice(words, rng.integers(20, 200))
        if i % 3 == 0:
            yield 0, " ".join(x.upper() + "$$$" for x in w)
        else:
            yield 1, ". ".join(w)


def test_held_out_rows_and_odd_texts(spark, docs_of):
    rows = list(texts(240, 2))
    odd = [None, "", "x" * 200_000, "\n\n"]
    docs = docs_of([t for _, t in rows] + odd + ["same text", "same text"])
    labels = spark.createDataFrame(
        [(i, q, 0, "extra") for i, (q, _) in enumerate(rows)] + [(3, None, None, "extra"), (None, 1, 0, "extra")],
        "doc_id long, quality int, toxic int, text string",
    )
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 246
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert by[244].score == by[245].score
    tested = [(by[i].predicted, q) for i, (q, _) in enumerate(rows) if by[i].held_out]
    assert np.mean([p == q for p, q in tested]) > 0.95
    # Held-out labels play no part.
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_keep_good_agrees_with_scores(spark, docs_of):
    rows = list(texts(120, 4))
    docs = docs_of([t for _, t in rows])
    labels = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "doc_id long, quality int")
    want = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.predicted}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert quality.score_documents(docs.limit(120), labels).where("doc_id < 0").count() == 0
    # Without labels nothing is known: every text has score 0.5.
    assert {(r.score, r.predicted) for r in quality.score_documents(docs, labels.limit(0)).collect()} == {(0.5, 0)}
    assert quality.keep_good(docs, labels.limit(0)).count() == 120


def test_no_documents_or_labels_of_one_class(spark, docs_of):
    docs = docs_of([t for _, t in texts(40, 6)])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        assert quality.score_documents(docs.limit(0), known).count() == 0
        left = quality.keep_good(docs.limit(0), known)
        assert left.columns == docs.columns and left.count() == 0
    for value in (0, 1):
        one = labels.selectExpr("doc_id", f"{value} AS quality")
        got = quality.score_documents(docs, one).collect()
        assert len(got) == 40 and all((r.score, r.predicted) == (value, value) for r in got)
        assert quality.keep_good(docs, one).count() == 40 * value
