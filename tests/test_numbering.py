import random

import numpy as np

from pairgate.functions.text import normalize_binder
from pairgate.operators import confidence
from pairgate.operators import numbering as N


def brute(scores, text, letters, skip, extra):
    """Best score and path by trying every way back, cell by cell."""
    width = scores.shape[1]
    low = (N._LOW, [])
    match = [low] * width
    between = [low] * width
    best = low
    for i, c in enumerate(text):
        now, inner = [], []
        for p in range(width):
            ways = [(-skip * p, 0, [])]
            if p:
                ways += [(match[p - 1][0], 3, match[p - 1][1]), (between[p - 1][0], 2, between[p - 1][1])]
                ways += [(match[q][0] - skip * (p - 1 - q), 1 + q / width - 0.999, match[q][1]) for q in range(p - 1)]
            value, _, path = max(ways, key=lambda w: w[:2])
            now.append((value + int(scores[letters.get(ord(c), 0), p]), [*path, (i, p)]))
            m, b = match[p], between[p]
            inner.append(((m if m[0] >= b[0] else b)[0] - extra, (m if m[0] >= b[0] else b)[1]))
        match, between = now, inner
        for p in range(width):
            value = match[p][0] - skip * (width - 1 - p)
            if value > best[0]:
                best = (value, match[p][1])
    return best


def test_paths_equal_trying_all(monkeypatch):
    rng = random.Random(2)
    for width in (1, 2, 3, 6):
        scores = np.array([[rng.choice([-300, -100, 0, 100, 200]) for _ in range(width)] for _ in range(4)], np.int64)
        letters = {ord(c): k for k, c in enumerate("ABC", 1)}
        profile = N.Profile("H", np.arange(width), letters, scores)
        texts = ["".join(rng.choices("ABCX", k=rng.randrange(0, 12))) for _ in range(60)]
        for cells in (1, 10**6):
            monkeypatch.setattr(N, "BATCH_CELLS", cells)
            got = N.best_paths(profile, texts, 100, 200)
            assert got == [brute(scores, t, letters, 100, 200) if t else (N._LOW, []) for t in texts]


def aligned_rows():
    heavy, light = ["QVQLVESGG", "EVQLVESGG", "QVQLQESGP"], ["DIQMTQSPS", "DIVMTQSPD", "EIVLTQSPA"]
    return [(c, p, r) for c, group in (("H", heavy), ("K", light)) for s in group for p, r in enumerate(s, 26)]


def test_numbering_feeds_normalising_loops_and_acceptance(spark):
    profile = N.profile_of(spark.createDataFrame(aligned_rows(), "chain_type string, position int, residue string"))
    rows = [("h", "MKKLLAQVQLVESGGHHHHHH"), ("k", "DIQMTQSPS"), ("gap", "QVQVESGG"), ("ins", "QVQLWVESGG"), ("no", "WWWWWW"), ("e", ""), ("n", None), ("h2", "MKKLLAQVQLVESGGHHHHHH")]
    seqs = spark.createDataFrame(rows, "id string, sequence string")
    found = N.number_sequences(seqs, profile, least=800).persist()
    by = {}
    for r in found.orderBy("id", "residue_idx").collect():
        by.setdefault(r["id"], []).append((r["residue_idx"], r["position"], r["chain_type"]))
    assert set(by) == {"h", "h2", "k", "gap", "ins"}
    assert by["h"] == by["h2"] == [(6 + i, 26 + i, "H") for i in range(9)]
    assert by["k"] == [(i, 26 + i, "K") for i in range(9)]
    assert [p for _, p, _ in by["gap"]] == [26, 27, 28, 30, 31, 32, 33, 34]
    assert [i for i, _, _ in by["ins"]] == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    parts = {r["id"]: r["domain"] for r in N.domains(seqs, found).collect()}
    assert parts["h"] == "QVQLVESGG"
    joined = seqs.join(N.domains(seqs, found), "id", "left").withColumn("norm", normalize_binder("sequence", "domain"))
    norm = {r["id"]: r["norm"] for r in joined.collect()}
    assert norm["h"] == "QVQLVESGG" and norm["no"] == "WWWWWW"
    loops = {r["id"]: r["loops"] for r in confidence.loop_positions(found).collect()}
    assert loops["h"] == [[6 + i for i in range(7)]]  # heavy positions 26 to 32
    candidates = spark.createDataFrame([(1, "QVQLVESGG"), (2, "WWWW"), (3, "QVQLVESGG")], "ordinal int, h_seq string")
    kept = N.accept_numbered(profile, least=800)(candidates)
    assert kept.columns == candidates.columns and {r["ordinal"] for r in kept.collect()} == {1, 3}
    assert N.number_sequences(seqs.limit(0), profile).count() == 0
    assert N.number_sequences(seqs, profile.limit(0)).count() == 0
