import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgate.llm import katz

SCHEMA = "doc_id long, text string, lang string, uid long, chunk long"


def tokens_of(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (text or "").translate(fold)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    return [w for w in words.split(" ") if w] + [katz.END]


class Textbook:
    """Katz's model with dictionaries, word by word."""

    def __init__(self, docs, order):
        self.order, self.n = order, [Counter() for _ in range(order + 1)]
        for tokens in docs:
            line = [None] * (order - 1) + tokens
            for i in range(order - 1, len(line)):
                for m in range(1, order + 1):
                    self.n[m][tuple(line[i - m + 1 : i + 1])] += 1
        self.total = sum(self.n[1].values())
        of = [[sum(v == r for v in n.values()) for r in range(katz.MOST_DISCOUNTED + 2)] for n in self.n]
        self.discount = [katz.discounts(x) for x in of]
        self.after = defaultdict(list)
        for m in range(2, order + 1):
            for gram in self.n[m]:
                self.after[gram[:-1]].append(gram[-1])

    def kept(self, gram):
        return float(self.discount[len(gram)].mass(np.array([self.n[len(gram)][gram]]))[0])

    def p(self, gram):
        m = len(gram)
        if m == 1:
            if not self.total:
                return 1.0
            kept = sum(self.kept(g) for g in self.n[1])
            whole = self.total + (self.total - kept < katz.LITTLE)
            return (self.kept(gram) if self.n[1][gram] else whole - kept) / whole
        words = self.after[gram[:-1]]
        if not words:
            return self.p(gram[1:])
        total = sum(self.n[m][(*gram[:-1], w)] for w in words)
        kept = sum(self.kept((*gram[:-1], w)) for w in words)
        whole = total + (total - kept < katz.LITTLE * total)
        if self.n[m][gram]:
            return self.kept(gram) / whole
        return (whole - kept) / whole / (1 - sum(self.p((*gram[1:-1], w)) for w in words)) * self.p(gram[1:])

    def score(self, tokens):
        line = [None] * (self.order - 1) + tokens
        return sum(math.log10(self.p(tuple(line[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(line)))


def made(rng, n):
    words = ["A", "b", "C", "é", "Él", "dd", "e.", "f", "g", "h"]
    texts = [" ".join(rng.choices(words[: rng.choice([3, 10])], k=rng.randrange(0, 15))) for _ in range(n)]
    return [*texts, *texts[:5], None, "", " \t\n", "only here", "é x  y"]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("order, chunk", [(1, 50), (2, 10**6), (2, 9), (3, 40), (4, 7)])
def test_scores_equal_the_textbook(spark, order, chunk):
    rng = random.Random(order * chunk)
    rows = [(i, t) for i, t in enumerate(made(rng, 60))]
    rows += [(None, "a b"), (3, "a b c"), (3, "a b c")]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], SCHEMA)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    made_by = katz.katz(df, held, order, chunk=chunk, bucket_bytes=300)
    train = [tokens_of(t) for i, t in rows if not is_held(i)]
    book = Textbook(train, order)
    n, v = book.total, len(book.n[1])
    want = []
    for i, t in rows:
        tokens = tokens_of(t)
        c = [book.n[1][w,] for w in tokens]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        want.append((i, is_held(i), len(tokens), sum(x > 0 for x in c), n, base, book.score(tokens)))
    got = [tuple(r) for r in made_by.scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    order_of = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=order_of), sorted(want, key=order_of), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-9)
    assert any(h for _, h, *_ in want)


def test_every_distribution_sums_to_one():
    rng = random.Random(9)
    book = Textbook([tokens_of(t) for t in made(rng, 40)], 3)
    words = [w for (w,) in book.n[1]] + ["unseen"]
    for history in [(None, None), (None, "a"), ("a", "b"), ("unseen", "a"), ("b", "unseen"), *list(book.after)[:40]]:
        if len(history) == 2:
            assert sum(book.p((*history, w)) for w in words) == pytest.approx(1, abs=1e-9)


def test_good_turing_where_counts_allow_it():
    d = katz.discounts([0, 1000, 400, 230, 150, 105, 80, 62, 50])
    assert len(d.factors) >= 2 and all(0 < x < 1 for x in d.factors)
    assert katz.discounts([0, 0, 0, 0, 0, 0, 0, 0, 0]).taken == 0.5
    assert katz.discounts([0, 10, 40, 0, 0, 0, 0, 0, 0]).taken == pytest.approx(1 / 9)


def test_long_text_no_documents_and_no_training(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "x", 0, 0), (2, "a b", "x", 0, 0)], SCHEMA)
    got = {r.doc_id: r for r in katz.katz(df, F.lit(False), chunk=70_000).scores.collect()}
    assert got[1].n_tokens == 300_001 and got[2].n_tokens == 3 and got[1].train_tokens == 300_004
    assert got[1].score > got[1].base_score
    none = katz.katz(df, F.lit(True)).scores.collect()
    assert {(r.score, r.base_score, r.n_known, r.train_tokens) for r in none} == {(0.0, 0.0, 0, 0)}
    assert katz.katz(spark.createDataFrame([], SCHEMA), F.lit(False)).scores.count() == 0
