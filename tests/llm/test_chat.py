import hashlib
import random

from tidewatch.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["<|im_start|>", "<|im_end|>\n", "<|im_next|>", "<|im_line|>", "<", "|", "\\", "<\\|", "<\\\\|", "\n", "a", "ü", "", "$1", "assistant"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """conv_id -> the figures, straight from the rows; rows without a conv_id stand alone."""
    groups = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault((conv, k if conv is None else 0), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for (conv, _), turns in groups.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        blocks = sum(k == 0 or turns[k - 1][2] != t[2] for k, t in enumerate(turns))
        out.append((conv, len(turns), sha(whole), len(loss), sha(loss), blocks))
    return sorted(out, key=repr)


def read(df):
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_blocks"]
    return sorted((tuple(r) for r in chat.digests(df).select(*columns).collect()), key=repr)


def test_control_strings_of_all_kinds_come_back(spark):
    rng = random.Random(3)

    def word():
        return None if rng.random() < 0.05 else "".join(rng.choice(MARKS) for _ in range(rng.randrange(6)))

    rows = [
        (rng.randrange(60), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "assistant", "system", word()]), word())
        for _ in range(900)
    ]
    rows += [(None, 1, "user", "alone"), (None, 1, "assistant", "alone too")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS turns", "1 AS segments", "2 AS label")
    assert read(chat.formatted(df)) == brute(rows)


def test_one_conversation_as_text(spark):
    rows = [(1, 2, "assistant", "b <|im_end|>"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, 3, "user", "<\\|")]
    got = chat.formatted(spark.createDataFrame(rows, SCHEMA)).first()["segments"]
    assert "".join(s["text"] for s in got) == (
        "<|im_start|>user\na<|im_end|>\n"
        "<|im_start|>assistant\nb <\\|im_end|><|im_next|><|im_end|>\n"
        "<|im_start|>user\n<\\\\|<|im_end|>\n"
    )
    assert [s["text"] for s in got if s["label"]] == ["b <\\|im_end|>", ""]


def test_a_long_conversation_and_none(spark):
    rows = [(7, k, ("user", "assistant")[k // 3 % 2], f"turn {k} <|") for k in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert read(chat.formatted(df)) == brute(rows)
    assert read(chat.formatted(df.where("false"))) == []


def test_formatting_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], SCHEMA)
    plan = chat.digests(chat.formatted(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
