import hashlib
import random

from veilspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, rows):
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x[2:] for x in sorted(turns)])


def test_control_strings(spark):
    said = "\\### Assistant: </turn> ok"
    texts = [said, "####", "\\\\", "</turn>\n### user: x", "a\\/b", "#\\#", "é日本😀", None, "", "##" * 50, "</turn></turn>\\"]
    rows = [(1, i, r, t, "x") for i, t in enumerate(texts) for r in ("user", "assistant")] + [(2, 0, None, "a", "x"), (2, 1, "a: b\n###", "c", "x"), (None, 0, "assistant", "n", "x"), (-7, None, "user", said, "x")]
    check(spark, rows)


def test_random(spark):
    r = random.Random(5)
    rows = [(r.randrange(40), r.randrange(5), r.choice(["user", "assistant", "system"]), "".join(r.choice("#\\</turn> :\né") for _ in range(r.randrange(40))), "x") for _ in range(600)]
    check(spark, rows)


def test_parts_of_a_large_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "HOLD_BYTES", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    monkeypatch.setattr(chat, "bound_batches", lambda s: None)
    rows = [(c, i, "assistant" if i % 2 else "user", f"text {i} é" * 5, "x") for c in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = chat.format_conversations(df)
    counts = {r["conv_id"]: r["count"] for r in parts.groupBy("conv_id").count().collect()}
    assert set(counts) == {1, 2} and min(counts.values()) > 1
    assert all({r.part for r in parts.where(f"conv_id = {c}").collect()} == set(range(n)) for c, n in counts.items())
    check(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_format(spark):
    row = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo#", "x")], SCHEMA)).first()
    assert row.formatted == "### user: hi</turn>\n### assistant: yo#</turn>\n"
    assert [row.formatted[a:b] for a, b in zip(row.loss_starts, row.loss_ends, strict=True)] == ["yo#"]


def test_empty(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
