import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairgate.llm import fmindex, repeats, suffixes


def brute(texts, window, words):
    """Count every window of every text."""
    units = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) if words else (t or "").encode() for t in texts]
    at = lambda u, i: tuple(u[i : i + window]) if words else u[i : i + window]
    seen = Counter(at(u, i) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[at(u, i)] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = b" ".join(w for w, g in zip(u, gone) if not g) if words else bytes(b for b, g in zip(u, gone) if not g)
        out.append((len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé", k=rng.randrange(1, 5)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    texts = [None, "", " ", "a", "a " * 300, "a " * 301, "ab" * 400, " ".join(passage), "\t".join(passage)]
    for _ in range(12):
        w = [word() for _ in range(rng.randrange(0, 80))]
        w[len(w) // 2 : len(w) // 2] = passage[rng.randrange(30) : rng.randrange(30, 61)]
        texts.append(" ".join(w))
    for _ in range(8):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    twice = " ".join(word() for _ in range(40))
    texts += [twice + " x " + twice, texts[12], texts[12]]
    for i in range(40):  # a line that many documents share
        texts.append(" ".join([word(), word(), *passage[: rng.choice([18, 19, 20, 22, 25])], word(), word()]))
    return texts


@pytest.mark.parametrize("pool", [200, 4])
@pytest.mark.parametrize("words", [True, False])
def test_removal_equals_brute_force(docs_of, monkeypatch, words, pool):
    monkeypatch.setattr(repeats, "POOL", pool)
    monkeypatch.setattr(repeats, "RUN", 50)
    texts = corpus(pool)
    docs = docs_of(texts).repartition(3)
    window = 20 if words else 60
    made = fmindex.substring_dedup(docs, window) if words else suffixes.suffix_dedup(docs, window)
    got = {r.doc_id: (r[made.columns[1]], r.n_removed, r.n_spans, r.kept_sha256) for r in made.collect()}
    want = dict(enumerate(brute(texts, window, words)))
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(texts)


def random_parts(rng, words, window):
    alphabet = "ab" if rng.random() < 0.5 else "abcdefgh"
    parts = []
    stem = [rng.choice(alphabet) for _ in range(window * 3)]
    for _ in range(rng.randrange(1, 12)):
        a = rng.randrange(window)
        s = stem[a : a + window + rng.randrange(window)]
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice(alphabet)
        parts.append(((" " if words else "").join(s).encode(), len(s) - window + 1, rng.choice([1, 1, 1, 2])))
    return parts


@pytest.mark.parametrize("words", [True, False])
def test_solvers_equal_counting(words):
    rng = random.Random(9)
    for _ in range(300):
        window = rng.choice([4, 9, 17])
        parts = random_parts(rng, words, window)
        units = [p.split() if words else p for p, _, _ in parts]
        seen = Counter()
        for u, (_, n, c) in zip(units, parts):
            for i in range(n):
                seen[tuple(u[i : i + window])] += c
        masks = (fmindex.by_index if words else suffixes.doubling)(parts, window)
        for u, (_, n, c), mask in zip(units, parts, masks):
            assert mask.tolist() == [seen[tuple(u[i : i + window])] > 1 for i in range(n)]


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    sequence = rng.integers(0, 37, 1000)
    wavelet = fmindex.Wavelet(sequence, 37)
    symbol, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert wavelet.rank(symbol, at).tolist() == [int((sequence[:i] == s).sum()) for s, i in zip(symbol, at)]


def test_ids_and_empty_tables(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([text, text, None, "w1"], [None, 7, 7, 9])
    rows = fmindex.substring_dedup(docs, 35).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed) for r in rows) == [("7", 0, 0), ("7", 50, 50), ("9", 1, 0), ("None", 50, 50)]
    assert fmindex.substring_dedup(docs.limit(0), 35).count() == 0
    assert suffixes.suffix_dedup(docs.limit(0)).count() == 0
