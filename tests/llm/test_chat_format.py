import hashlib
import random

from pyspark.sql import functions as F

from quillon.llm import chat_format as c


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<|esc|>", "<|", "|>", "<", "|", "\\", "\\\\", "\n", "\\n", "user", "ok", "é", "😀", "<\\|"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "system", "<|esc|>", "a\nb", "", "x<|esc|>", "\\"]) if conv % 3 == 0 else rng.choice(["user", "assistant"])
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randrange(8))), "x"))
    rows += [(500, None, None, None, "x"), (501, 1, "user", "twice", "x"), (501, 1, "user", "twice", "x"), (None, 1, "assistant", "no id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = c.format_conversations(df)
    read = {r[0]: [(t.role, t.text) for t in r[1]] for r in formatted.select("conv_id", c.parse(F.col("formatted"))).collect()}
    source = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        source.setdefault(conv, []).append((role or "", text or ""))
    assert {k: sorted(v) for k, v in read.items()} == {k: sorted(v) for k, v in source.items()}
    for r in c.summarize(formatted).collect():
        turns = read[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    for text, spans, turns in formatted.select("formatted", c.loss_spans(F.col("formatted")), c.parse(F.col("formatted"))).collect():
        assert [text[s.start : s.end] for s in spans] == [t.written for t in turns if t.role == "assistant"]
        assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)


def test_empty_and_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes\nno")], "conv_id long, turn long, role string, text string")
    assert c.format_conversations(df).first().formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes\nno<|im_end|>\n"
    assert c.summarize(c.format_conversations(df.limit(0))).count() == 0


def test_rows_without_a_conversation_are_alone(spark):
    rows = [(None, i % 3, "assistant", f"text {i % 5}") for i in range(200)] + [(1, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = c.summarize(c.format_conversations(df)).collect()
    assert len(found) == 201 and {r.n_turns for r in found} == {1}
