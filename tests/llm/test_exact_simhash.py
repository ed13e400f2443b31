import hashlib
import random
import re

import xxhash

from pairgate.llm import exact, simhash


def brute_exact(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        bare = re.sub("[\x20\x09-\x0d]", "", t or "")
        groups.setdefault(bare, []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_equals_brute_force(docs_of):
    texts = ["a b", "ab ", "a  b", None, "", " \t", "x\x0by", "xy", "é", "é ", "a b", "long " * 500, "long" * 500]
    df = docs_of(texts, [5, 4, 3, 9, 8, 7, 1, 2, 20, 21, 22, 30, None])
    got = exact.exact_dedup(df.repartition(5), fan_in=2)
    rows = got.collect()
    pairs = list(zip([5, 4, 3, 9, 8, 7, 1, 2, 20, 21, 22, 30, None], texts))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=repr) == brute_exact(pairs)
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})


def test_repeated_rows_keep_one_and_all_columns(docs_of):
    df = docs_of(["a", "a", "b", "c", "c "], [1, 1, 1, 2, None])
    rows = exact.exact_dedup(df).collect()
    assert sum(r.kept for r in rows) == 3
    left = exact.drop_exact(df)
    assert left.columns == df.columns
    assert sorted((repr(r.doc_id), r.text) for r in left.collect()) == [("1", "a"), ("1", "b"), ("None", "c ")]


def test_exact_empty(docs_of):
    df = docs_of(["a"]).limit(0)
    assert exact.exact_dedup(df).count() == 0
    assert exact.drop_exact(df).count() == 0


def brute_fp(text, k=3):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", folded)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in ids}


def test_simhash_fingerprints_and_components(docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(6)]
    texts = [None, "", " ", "One", "one", "one two", "É x y z"]
    for b in base:
        for _ in range(6):
            w = b.split(" ")
            w[rng.randrange(len(w))] = "zz"
            texts.append(("\t" if rng.random() < 0.3 else " ").join(w))
    rows = simhash.simhash_dedup(docs_of(texts)).collect()
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in fps.items()}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(fps, 2)


def test_long_posting_lists_give_the_same_components(spark):
    from pairgate.llm.components import components

    rng = random.Random(5)
    values, start = set(), rng.getrandbits(64)
    for _ in range(150):
        v = start
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    marks = spark.createDataFrame([(0, v) for v in values] + [(1, 5)], "r int, fp long")
    want = brute_components({v: v & (1 << 64) - 1 for v in values}, 2)
    for list_rows in (4, 1000):
        found = {r.node: r.root for r in components(simhash.links(marks, 2, list_rows)).collect()}
        assert {v: found.get(v, v) for v in values} == want
    want = brute_components({v: v & (1 << 64) - 1 for v in values}, 4)
    found = {r.node: r.root for r in components(simhash.links(marks, 4, 1000)).collect()}
    assert {v: found.get(v, v) for v in values} == want


def test_simhash_edges(docs_of):
    df = docs_of(["a b c d", "a b c d"], [None, 3])
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_dedup(df).collect()} == {(None, None), (3, 3)}
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


def test_drop_near_keeps_one_of_each_group(docs_of):
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(8)]
    texts = list(base)
    for b in base:
        w = b.split()
        w[150] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "short", "short text"]
    docs = docs_of(texts)
    left = simhash.drop_near(docs)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns
    assert set(range(8)) <= kept and {18, 19} <= kept
    assert len(kept & set(range(8, 16))) <= 1
    assert len(kept & {16, 17}) == 1  # no words: copies of each other


def test_wide_links_join_all_pairs_that_meet(spark, monkeypatch):
    from pairgate.llm.components import components

    rng = random.Random(8)
    prints, n_keys, bits = {}, 30, 20
    for base in range(6):
        start = [rng.getrandbits(64) for _ in range(8)]
        for k in range(25):
            v = list(start)
            for _ in range(rng.randrange(14)):
                v[rng.randrange(8)] ^= 1 << rng.randrange(64)
            prints[base * 100 + k] = v
    sets = simhash.position_sets(64, n_keys)
    assert all(len(set(s)) == 3 for s in sets)
    byte = lambda v, p: v[p // 8] >> 8 * (p % 8) & 255
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            x, y = prints[a], prints[b]
            meets = any(all(byte(x, p) == byte(y, p) for p in s) for s in sets)
            if a < b and meets and sum(bin(i ^ j).count("1") for i, j in zip(x, y)) <= bits:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    signed = lambda v: [i - (1 << 64) if i >> 63 else i for i in v]
    marks = spark.createDataFrame([(d, signed(v)) for d, v in prints.items()], "id long, fps array<long>")
    for block in (1024, 4):
        monkeypatch.setattr(simhash, "LIST_BLOCK", block)
        found = {r.node: r.root for r in components(simhash.wide_links(marks, 8, n_keys, bits)).collect()}
        assert {d: found.get(d, d) for d in prints} == {d: find(d) for d in prints}


def shingle_set(text, k=5):
    w = text.split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_near(texts, similarity=0.8):
    """The places of the texts that stay: the first of each component of near copies."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) / both >= similarity:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i for i in range(len(texts)) if find(i) == i}


def graded_copies(rng):
    """Pairs whose similarities lie around 0.8 to 0.95, sparse enough that pairs stay pairs."""
    texts, similarities = [], []
    for n in (8, 13, 40, 200, 600):
        for target in (0.75, 0.79, 0.8, 0.81, 0.85, 0.9, 0.95):
            for _ in range(6):
                w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                copy = w + [f"w{rng.randrange(10**6)}" for _ in range(round((n - 4) * (1 / target - 1)))]
                texts += [" ".join(w), " ".join(copy)]
                a, b = shingle_set(texts[-2]), shingle_set(texts[-1])
                similarities.append(len(a & b) / len(a | b))
    return texts, similarities


def test_drop_near_equals_brute_force_jaccard(docs_of, monkeypatch):
    texts, similarities = graded_copies(random.Random(21))
    assert sum(0.8 <= s <= 0.82 for s in similarities) > 20 and sum(0.77 < s < 0.8 for s in similarities) > 5
    # A repeated line weighs once; a chain of copies hangs together.
    texts += ["a b c d e f g " * 30 + "h", "a b c d e f g " * 90 + "h"]
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 4)]
    want = brute_near(texts)
    for block in (1024, 2):
        monkeypatch.setattr(simhash, "LIST_BLOCK", block)
        assert {r.doc_id for r in simhash.drop_near(docs_of(texts)).collect()} == want


def test_drop_near_compares_rows_with_null_or_repeated_ids(docs_of):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    near = [t + " more" for t in base]
    texts = [base[0], near[0], base[1], near[1], base[2], near[2], base[3], base[4], near[4], base[4]]
    #        two null ids      null and not      one id, copies    one id, unlike      null, 3 rows
    ids = [None, None, None, 7, 8, 8, 8, None, 9, None]
    left = simhash.drop_near(docs_of(texts, ids))
    got = {(r.doc_id, texts.index(r.text)) for r in left.collect()}
    assert len(got) == left.count() == 5
    assert {(7, 3), (8, 6), (9, 8)} <= got
    assert len(got & {(None, 0), (None, 1)}) == 1  # either of the two is the first
    assert len(got & {(8, 4), (8, 5)}) == 1
    assert simhash.drop_near(docs_of(["a"]).limit(0)).count() == 0


def test_rows_with_columns_named_like_helpers(spark):
    names = ["doc_id", "text", "id", "doc", "row", "sha", "words", "digest", "__gone", "__id", "kept", "n", "root", "node"]
    rows = [(i, t, *["c"] * 12) for i, t in ((1, "a b c"), (2, "ab c"), (2, "other"), (None, "a bc"), (None, "other text"), (3, None), (4, ""))]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    for drop in (exact.drop_exact, simhash.drop_near):
        left = drop(docs)
        assert left.columns == names
        got = {(r.doc_id, r.text) for r in left.collect()}
        assert (2, "other") in got and (None, "other text") in got
        assert ((3, None) in got) != ((4, "") in got)
    assert {r.doc_id for r in exact.drop_exact(docs).where("text LIKE '%a%b%c%'").collect()} == {1}


def test_drop_near_drops_what_the_fingerprint_index_links(docs_of):
    # A line of 21 words, repeated, decides every bit; the sets of shingles share little.
    line = " ".join(f"w{i}" for i in range(21))
    texts = [" ".join([line] * 60 + [f"{name}{i}" for i in range(30)]) for name in "abc"]
    five = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    assert len(five[0] & five[1]) < 0.5 * len(five[0] | five[1])
    texts.append("quite another text")
    assert simhash.simhash_dedup(docs_of(texts)).select("component_id").distinct().count() == 2
    assert [r.doc_id for r in simhash.drop_near(docs_of(texts)).orderBy("doc_id").collect()] == [0, 3]
