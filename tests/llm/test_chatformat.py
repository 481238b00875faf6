import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sheetlens.llm import chatformat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = r"\### Assistant: </turn> ok"
ROWS = [
    (1, 1, "assistant", "fine: yes\n"), (1, 0, "user", "hello"),
    (-7, 0, "user", NASTY), (-7, 1, "assistant", NASTY),
    (2, 0, "assistant", " </turn>\n### assistant: injected </turn>\n"), (2, 1, "assistant", ""), (2, 1, "assistant", ""),
    (3, None, None, None), (3, 5, "a: b#<\\", "\\b\\h\\l\\c \\\\ ### </turn"), (3, 6, "###\\ x", "tail\\"),
    (None, 0, "assistant", "é 中 😀"), (4, 0, "user", "### head"), (4, 1, "assistant", " </turn"), (4, 2, "assistant", "x </turn>"),
    *((9, i, ("user", "assistant")[i % 2], f"turn {i} " * 3) for i in range(300)), (10, 0, "assistant", "long # " * 40_000),
]


def brute():
    convs = defaultdict(list)
    for c, t, r, x in ROWS:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_equal_brute_force(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA).repartition(4).withColumn("formatted", F.lit("clash"))
    formatted = chatformat.format_conversations(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chatformat.digest(formatted).collect()}
    assert got == brute()


def test_spans_hold_the_assistant_texts_and_only_conflicts_are_escaped(spark):
    rows = {r.conv_id: r for r in chatformat.format_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    for r in rows.values():
        spoken = [t for t in r.turns if t.role == "assistant"]
        for (start, n, turn, begin, escaped), t in zip(r.loss_spans, spoken, strict=True):
            text = r.formatted[start : start + n]
            if t.escaped:
                for a, b in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
                    text = text.replace(a, b)
            assert text == t.text and r.turns[turn] == t and escaped == t.escaped
            assert r.formatted[begin:].startswith("###") and (begin == 0 or r.formatted[:begin].endswith(" </turn>\n"))
    assert rows[1].formatted == "### user: hello </turn>\n### assistant: fine: yes\n </turn>\n"
    assert [rows[k].escaped_turns for k in (1, 9, -7, 2, 3)] == [0, 0, 2, 1, 2]
    assert rows[2].formatted.count(" </turn>\n") == 3


def test_plan_is_native_and_empty_table(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    plan = chatformat.digest(chatformat.format_conversations(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chatformat.digest(chatformat.format_conversations(turns.filter("false"))).count() == 0


def test_loss_is_read_at_the_spans(spark):
    formatted = chatformat.format_conversations(spark.createDataFrame(ROWS, SCHEMA))
    moved = formatted.withColumn("loss_spans", F.transform(F.slice("loss_spans", 1, 1), lambda s: s.withField("start", s["start"] + 1).withField("length", F.lit(2))))
    got = {r.conv_id: r.loss_chars for r in chatformat.digest(moved).collect()}
    assert got[1] == 2 and got[9] == 2 and got[3] == 0
    texts = {r.conv_id: r.t for r in moved.select("conv_id", chatformat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("t")).collect()}
    assert texts[1] == ["in"] and texts[9] == ["ur"]
