"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable.
Turns after the last assistant turn (or all, where there is none) would be lost; they become a closing example
without a target, so each conversation can be read back whole from its last example.

Template, for each turn:   <turn ROLE>TEXT</turn>\\n     where the target's tag is <turn ROLE train>
Inside roles and texts & becomes &amp; and < becomes &lt;, in that order, and the reverse on reading. So `<` in the
output always begins a tag, whatever strings the texts hold. In roles > becomes &gt; as well, and the space of a last
` train` becomes &#32;, so a role neither ends its tag nor marks a target.

The loss mask is a span of code points of the example: the escaped text of the target, without its tags.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), then role and text, so repeated
rows stay, side by side; rows without a conversation id form one conversation; very long texts are formatted whole, a
conversation's longest example must fit in a task; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vecloom.llm.common import at

OPEN, CLOSE, TRAIN = "<turn ", "</turn>\n", " train"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    plain = F.replace(escape(c), F.lit(">"), F.lit("&gt;"))
    return F.when(F.endswith(plain, F.lit(TRAIN)), F.concat(F.left(plain, F.char_length(plain) - len(TRAIN)), F.lit("&#32;" + TRAIN.strip()))).otherwise(plain)


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("&#32;"), F.lit(" ")), F.lit("&gt;"), F.lit(">")))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trainable: str = "assistant") -> DataFrame:
    """conv_col, example (0, 1, ... in turn order), formatted, loss_start, loss_end (null, null: nothing is trainable)."""
    empty = F.lit("")
    slim = turns.select(
        at(conv_col).alias("conv"),
        at(turn_col).alias("turn"),
        F.coalesce(at(role_col).cast("string"), empty).alias("role"),
        F.coalesce(at(text_col).cast("string"), empty).alias("text"),
    )
    held = slim.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "role", "text"))).alias("turns"))
    # Each turn is written once; an example joins the turns before its target.
    held = held.select(
        "conv",
        F.transform(
            "turns",
            lambda t: F.struct((t["role"] == trainable).alias("target"), escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")),
        ).alias("turns"),
    )
    plain = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(">"), t["text"], F.lit(CLOSE)))
    last = F.size("turns") - 1
    targets = F.filter(F.transform("turns", lambda t, i: F.when(t["target"], i)), lambda i: i.isNotNull())
    ends = F.when(F.element_at("turns", -1)["target"], F.array().cast("array<int>")).otherwise(F.array(last))
    held = held.select("conv", "turns", plain.alias("plain"), F.concat(targets, ends).alias("ends"))
    each = held.select("conv", "turns", "plain", F.posexplode("ends").alias("example", "end"))
    turn = F.col("turns")[F.col("end")]
    head = F.concat(F.array_join(F.slice("plain", F.lit(1), F.col("end")), ""), F.lit(OPEN), turn["role"], F.when(turn["target"], TRAIN).otherwise(""), F.lit(">"))
    each = each.select("conv", "example", turn["target"].alias("target"), turn["text"].alias("text"), head.alias("head"))
    start = F.when(F.col("target"), F.char_length("head"))
    return each.select(
        F.col("conv").alias(conv_col),
        "example",
        F.concat("head", "text", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"),
        (start + F.char_length("text")).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example, as an array of (role, text)."""
    parts = F.split(formatted, OPEN)
    parts = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        tag = F.substring_index(part, ">", 1)
        role = F.when(F.endswith(tag, F.lit(TRAIN)), F.left(tag, F.char_length(tag) - len(TRAIN))).otherwise(tag)
        body = F.substring(part, F.instr(part, ">") + 1, F.char_length(part))
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring_index(body, "</turn>", 1)).alias("text"))

    return F.transform(parts, turn)


def read_back(made: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each conversation, from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = made.select(
        F.col(conv_col).alias("conv"),
        "example",
        (F.size(F.split("formatted", OPEN)) - 1).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        loss.alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    # Examples of a conversation are still in one partition: no shuffle here.
    back = each.groupBy("conv").agg(
        F.max(F.struct("example", "n_turns", "turns_sha256")).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return back.select(
        F.col("conv").alias(conv_col),
        F.col("whole.n_turns").alias("n_turns"),
        F.col("whole.turns_sha256").alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
