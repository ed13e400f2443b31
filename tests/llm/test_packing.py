import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairgate.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_both_encoders_agree(text):
    slow, fast = test_both_encoders_agree.pair
    assert fast(text) == slow(text)


test_both_encoders_agree.pair = (packing.encoder(JSON)(), packing.encoder(JSON, RANKS)())


def test_special_strings_follow_the_tokenizer():
    slow, fast = test_both_encoders_agree.pair
    text = "a <|endoftext|> b   c\n\n d  e"
    assert fast(text) == slow(text) == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 40), max_size=200))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_length_once(lengths):
    h = np.bincount(np.array(lengths, int), minlength=41)
    made = np.zeros(41, int)
    for row, n in packing.plan(h, 40):
        assert sum(row) <= 40 and n > 0
        for k in row:
            made[k] += n
    assert (made == h).all()


def test_plan_is_tight_and_independent_of_scale():
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(10, 1200, 5000), minlength=2049)
    for scale in (1, 10_000):
        n = sum(k for _, k in packing.plan(h * scale, 2048))
        assert n <= 1.002 * -(-int((h * scale * np.arange(2049)).sum()) // 2048) + 1


@pytest.mark.parametrize("parts", [1, 4])
def test_pieces_tile_documents_and_sequences(docs_of, parts):
    texts = [None, "", "one", "one", "word " * 3000, "x" * 9000, "é " * 2047, "many words here " * 100] * 4
    ids = [None, *range(1, len(texts))]
    got = packing.pack(docs_of(texts, ids).repartition(parts), packing.encoder(JSON, RANKS), 512).collect()
    slow = Tokenizer.from_file(JSON)
    whole = {d: slow.encode(t or "", add_special_tokens=False).ids + [0] for d, t in zip(ids, texts)}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    assert set(of_doc) == set(ids)
    for d, rows in of_doc.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        at = 0
        for r in rows:
            assert r.start == at and 0 < r.length <= 512 and (r.piece == 0 or r.length == 512)
            part = np.array(whole[d][at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(whole[d]) and (len(rows) == 1 or at > 512)
    for rows in of_sequence.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 512
    total = sum(map(len, whole.values()))
    assert len(of_sequence) <= -(-total // 512) + 1


def test_empty_table(docs_of):
    assert packing.pack(docs_of(["a"]).limit(0), packing.encoder(JSON, RANKS)).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "\t" * 2_000_000, "\u3000" * 700_000, "x" * 2_000_000])
def test_very_long_runs_of_one_character(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = packing.pack(docs, packing.encoder(JSON, RANKS), packing.CAPACITY).collect()
    want = len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got if r.doc_id == 1) == want
