import hashlib
import random

from pairgate.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"


def brute(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(turns)] for c, turns in out.items()}


def test_round_trip_and_loss_mask(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "<r>", "<t>", "[INST]", "[/INST]", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "é", "😀", "a", "\n", " "]
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "<s>odd<r>", None])
            text = rng.choice([None, "", "".join(rng.choices(bits, k=rng.randrange(12)))])
            rows.append((c, rng.choice([t, t, None]), role, text))
    rows += [(None, 1, "user", "x"), (None, 1, "user", "x"), (5000, 0, "assistant", "long " * 40_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    made = chat.format_conversations(df)
    want = brute(rows)
    for r in made.collect():
        turns = want.pop(r.conv_id)
        learnt = [r.formatted[s.start : s.start + s.length] for s in r.loss]
        assert len(learnt) == sum(role == "assistant" for role, _ in turns)
        assert r.formatted.count("<s>") == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert not any(m in x for x in learnt for m in ("<s>", "</s>", "[INST]", "[/INST]", "<t>", "<r>"))
    assert not want
    want = brute(rows)
    for r in chat.read_back(made).collect():
        turns = want[r.conv_id]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty_table(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
