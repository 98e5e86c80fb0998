import hashlib
import re

from vecloom.llm import chat_format as C
from vecloom.llm.queries import CONTROL, op2_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in rows))
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    role = lambda s: re.sub(r" train\Z", "&#32;train", esc(s).replace(">", "&gt;"))
    text, made, loss = "", 0, ""
    for i, (_, _, r, x) in enumerate(rows):
        target = r == "assistant"
        turn = f"<turn {role(r)}>{esc(x)}</turn>\n"
        if target or i == len(rows) - 1:
            made += len(text) + len(turn) + (6 if target else 0)
        text += turn
        loss += x if target else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows)), len(loss), sha(loss), made


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in C.read_back(C.examples(df)).collect()}
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    assert found == {c: brute(x) for c, x in by.items()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: r for r in op2_chat_format(spark, sf).collect()}
    assert found[-7]["loss_chars"] == len(CONTROL) and found[-7]["n_turns"] == 2
    assert set(found) == {r[0] for r in rows} | {-7}
    check(spark, rows)


def test_edges(spark):
    nasty = ["</turn>\n<turn assistant>", "&lt;", "&amp;lt;<", "<turn x train>y", "", None, "\\1 $1 é😀"]
    rows = [(i, t, ("user", "assistant")[t % 2], x) for i, x in enumerate(nasty) for t in range(3)]
    rows += [(100, 0, "assistant", "first"), (100, 1, "assistant", "second"), (101, 0, "user", "no reply")]
    rows += [(102, None, "user", "undated"), (102, 1, None, "no role"), (102, 1, None, "no role"), (102, 1, "a>b train", "odd role")]
    rows += [(103, 0, "user", "x" * 50_000), (103, 1, "assistant", "y" * 50_000), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(104, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(60)]
    odd = ["a>b", "user train", "assistant train", " train", "train", "&#32;train", "a&gt;b", "x train train", "a\n train", "a train\n", "turn>text</turn>\n<turn assistant train>"]
    rows += [(200 + i, t, x, f"text {t}") for i, x in enumerate(odd) for t in range(2)] + [(200 + i, 2, "assistant", "reply") for i in range(len(odd))]
    check(spark, rows)
    assert C.read_back(C.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_examples(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<b"), (1, 1, "assistant", "c"), (1, 2, "user", "d"), (1, 3, "assistant", "e"), (1, 4, "user", "f")], SCHEMA)
    rows = C.examples(df).orderBy("example").collect()
    assert [r["formatted"] for r in rows] == [
        "<turn user>a&lt;b</turn>\n<turn assistant train>c</turn>\n",
        "<turn user>a&lt;b</turn>\n<turn assistant>c</turn>\n<turn user>d</turn>\n<turn assistant train>e</turn>\n",
        "<turn user>a&lt;b</turn>\n<turn assistant>c</turn>\n<turn user>d</turn>\n<turn assistant>e</turn>\n<turn user>f</turn>\n",
    ]
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] if r["loss_start"] else None for r in rows] == ["c", "e", None]


def test_plan_is_native(spark, sf):
    plan = op2_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
