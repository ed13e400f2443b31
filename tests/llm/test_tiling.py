import random

import pytest

from pairgate.llm import tiling


def brute_tiles(doc, item, least):
    """The textbook loop: longest common unmarked run, leftmost diagonal first, until too short."""
    used_d, used_p, covered = set(), set(), 0
    while True:
        best = []
        longest = least - 1
        for a in range(len(doc)):
            for b in range(len(item)):
                k = 0
                while a + k < len(doc) and b + k < len(item) and doc[a + k] == item[b + k] and a + k not in used_d and b + k not in used_p:
                    k += 1
                if k > longest:
                    longest, best = k, [(a - b, a, b)]
                elif k == longest and k >= least:
                    best.append((a - b, a, b))
        if longest < least:
            return covered
        for _, a, b in sorted(best):
            span_d, span_p = set(range(a, a + longest)), set(range(b, b + longest))
            if not span_d & used_d and not span_p & used_p:
                used_d |= span_d
                used_p |= span_p
                covered += longest


def test_tiles_equal_textbook():
    rng = random.Random(7)
    for _ in range(200):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(3, 25))]
        doc = [rng.choice("abcdefg") for _ in range(10)] + item[rng.randrange(len(item)) :] + [rng.choice("xyz")] + item[: rng.randrange(len(item) + 1)]
        rng.random() < 0.3 and rng.shuffle(doc)
        index = tiling.Index.of([(1, " ".join(item))], 3)
        found = tiling.judge(index, " ".join(doc))
        assert (found[2] if found else 0) == brute_tiles(doc, item, 3)


@pytest.fixture()
def bench(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    rows = [(7, passage, "x"), (3, passage, "x"), (9, "too short item", "x"), (None, None, "x"), (11, "", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, coverage string")


def test_decisions(docs_of, bench):
    w = [f"word{i}" for i in range(30)]
    texts = [
        "Intro. " + " ".join(w).upper() + "!",  # whole, other case
        " ".join(w[15:] + ["and", "then"] + w[:15]),  # reordered
        " ".join(w[:10]) + " other",  # a third
        " ".join(w[:10]) + " x " + " ".join(w[:10]),  # the same third twice
        " ".join(w[:6] + ["no"] + w[6:12] + ["no"] + w[12:17] + ["no"]),  # pieces
        "clean " * 50_000,
        None,
        "",
        "too short item",
        " ".join(w[i] for i in range(0, 30, 2)),
    ]
    docs = docs_of(texts)
    rows = {r.doc_id: r for r in tiling.contaminated(docs, bench).collect()}
    assert [rows[i].contaminated for i in range(10)] == [True, True, False, False, True] + [False] * 5
    assert rows[0].item_id == 3 and rows[0].coverage == 1.0 and rows[1].n_tiles == 2
    assert rows[3].n_covered == 10 and rows[6].item_id is None and rows[5].coverage == 0.0
    kept = tiling.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9]


def test_blocks_give_the_same_result(docs_of, bench, monkeypatch):
    texts = [" ".join(f"word{i}" for i in range(k, 30)) for k in range(0, 30, 3)]
    docs = docs_of(texts)
    want = sorted(map(tuple, tiling.contaminated(docs, bench).collect()))
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 20)
    assert sorted(map(tuple, tiling.contaminated(docs, bench).collect())) == want
    assert tiling.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert tiling.contaminated(docs.limit(0), bench).count() == 0
