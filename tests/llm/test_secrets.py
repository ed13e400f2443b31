import hashlib
import random
import re

import pytest

from pairgate.llm import secrets


@pytest.fixture(autouse=True)
def small_forest(monkeypatch):
    monkeypatch.setattr(secrets, "TREES", 5)
    monkeypatch.setattr(secrets, "DEPTH", 4)


def brute_candidates(texts):
    out = []
    for d, text in enumerate(texts):
        for i, w in enumerate(re.split("[ \t\n\x0b\f\r]+", text or "")):
            for k, v in enumerate(re.findall("[A-Za-z0-9+/_-]{16,}", w)):
                out.append((d, i, k, len(v), hashlib.sha256(v.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def findings():
    rng = random.Random(4)
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    word = lambda n: "".join(rng.choice(["then", "ing", "tion", "and", "er"]) for _ in range(n))
    texts, truth = [], {}
    for d in range(160):
        w = [word(1) for _ in range(20)]
        secret = d % 2 == 0
        if secret:
            w[10] = rng.choice([f"password={hexed(18)}", f'token="{hexed(40)}"', f"key:AKIA{''.join(rng.choices('ABCDEFGH23', k=16))}"])
        else:
            w[10] = rng.choice([word(7), "4" + "".join(rng.choices("0123456789", k=15)), f"commit/{hexed(24)}", f"build-{word(4)}"])
        if len(re.findall("[A-Za-z0-9+/_-]{16,}", w[10])) == 1:
            truth[d] = int(secret)
        texts.append(" ".join(w))
    return texts + [None, "", "x" * 100_000, "ab/" * 20 + "," + "cd-" * 20, " lead " + "q" * 16], truth


def test_candidates_and_held_out_accuracy(spark, docs_of, findings):
    texts, truth = findings
    docs = docs_of(texts)
    labels = spark.createDataFrame([(d, 10, 0, y) for d, y in truth.items() if d % 4 < 2], "doc_id long, word_no int, nth int, label int")
    got = secrets.scan(docs.withColumnRenamed("digest", "value"), labels).collect()
    assert sorted((r.doc_id, r.word_no, r.nth, r.length, r.value_sha256) for r in got) == brute_candidates(texts)
    tested = [(r.secret, truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id % 4 >= 2 and r.word_no == 10]
    assert len(tested) > 50 and sum(a == b for a, b in tested) / len(tested) >= 0.9
    assert all((r.label is not None) == (r.doc_id in truth and r.doc_id % 4 < 2 and r.word_no == 10) for r in got)


def test_strict_labels_and_edges(spark, docs_of, findings):
    texts, _ = findings
    docs = docs_of(texts)
    rows = secrets.scan(docs).collect()
    assert {r.label for r in rows} == {0, 1, None}
    assert all(r.secret == bool(r.label) for r in rows if r.label is not None)
    none = secrets.scan(docs_of(["just words", "abcdefghijklmnopqrst"])).collect()  # labels of one class
    assert [(r.score, r.secret) for r in none] == [(None, True)]
    assert secrets.scan(docs.limit(0)).count() == 0
    twice = secrets.scan(docs_of([texts[0], texts[0]], [5, 5])).collect()
    assert len(twice) == 2 * len(brute_candidates(texts[:1]))
