import random
import re
from collections import Counter

import numpy as np

from pairgate.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """Shares of every group and kept term, one after another, in whole numbers."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = Counter(), Counter(), {}
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        terms = [t.translate(fold) for t in TERM.findall(text)]
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= min_docs)
        v = len(kept)

        def shares(chosen):
            c = {t: sum(counts[lang, s, t] for s in chosen) for t in kept}
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * v) for t in kept}

        whole, own = shares(sources), {s: shares([s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(whole[t] - own[s][t], t.encode(), t) for t in kept if counts[lang, s, t] and own[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(sorted(found)[:limit], 1)}
    return out


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 0) for i, r in enumerate(rows)], SCHEMA)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(90)] + ["İx", "ﬀ", "a1b", "naïve", "\u0085z", "😀"]
    rows = []
    for _ in range(260):
        lang = rng.choice(["en", "en", "de", None, "fr"])
        source = rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])
        text = " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30]))) + rng.choice(["", " x-y_z.", "\n\n"])
        rows.append((rng.choice([text, text, text, None]), lang, source))
    rows += [(None, "xx", s) for s in "abc"] + [("", "yy", "only")] + [("long wordé " * 100_000, "en", "a")]
    rows += [rows[0]] * 3
    got = [tuple(r) for r in divergence.audit_sources(rows_of(spark, rows), 6, 4).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 6, 4)


def test_many_sources_and_terms_span_tiles(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(700)]
    rows = [(" ".join(rng.choices(words, k=40)), "en", f"s{rng.randrange(300)}") for _ in range(600)]
    got = {tuple(r) for r in divergence.audit_sources(rows_of(spark, rows), 2, 3).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute(rows, 2, 3)


def test_walk_equals_dense_sums(monkeypatch):
    rng = np.random.default_rng(5)
    for n_l, n_r, width, frontier in ((1, 1, 1, 10), (5, 7, 256, 50), (256, 3, 100, 1 << 18), (40, 40, 0, 10)):
        monkeypatch.setattr(divergence, "FRONTIER", frontier)
        sides, z = [], []
        for n in (n_l, n_r):
            z.append(rng.integers(1, 1000, n))
            dense = np.where(rng.random((n, width)) < 0.1, rng.integers(1, 10**9, (n, width)), 0)
            i, j = np.nonzero(dense)
            sides.append((divergence.K2Tree.build(i, j, dense[i, j]), np.where(dense, dense, z[-1][:, None])))
        got = divergence.walk(sides[0][0], sides[1][0], z[0], z[1], width, False)
        want = np.abs(sides[0][1][:, None, :] - sides[1][1][None, :, :]).sum(2)
        assert (got == want).all()


def test_empty_table(spark):
    assert divergence.audit_sources(rows_of(spark, [])).count() == 0
