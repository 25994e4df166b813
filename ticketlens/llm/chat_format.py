"""Chat formatting: prefix-target expansion of conversations.

Every assistant turn becomes its own example: all preceding turns are the
context and only that reply is trainable.  A turn is written as
``<|role|>text<|end|>``.  Control strings inside roles and texts are broken
with a backslash (backslashes are doubled first), so a text can never open or
close a turn and the original is read back exactly.

Defined results: null text or role counts as empty; turns are ordered by
(turn, role, text) with null turns first, so ties and repeated rows have one
order; rows with a null ``conv_id`` form one conversation; turns after the
last reply (or a conversation without any) give one *remainder* row without a
loss span, so every turn is written.  An example holds its whole context by
definition, so one conversation is one row of work; its size is that of its
own longest example.  Other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPEN_END, CLOSE = "<|", "|>", "<|end|>"

#: Control strings of the common chat templates, each with the
#: form in which it may stand inside a text.
ESCAPES = (
    ("<|", "<\\|"),
    ("|>", "|\\>"),
    ("<s>", "<\\s>"),
    ("</s>", "<\\/s>"),
    ("[INST]", "[\\INST]"),
    ("[/INST]", "[\\/INST]"),
)


def escape(text: Column) -> Column:
    """Break every control string; reversible by :func:`unescape`."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(broken))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text",
                         trainable: str = "assistant") -> DataFrame:
    """One row per trainable turn (and one remainder row where turns follow
    the last one): ``conv_id, example, text, loss_start, loss_chars``.
    ``loss_start`` counts code points from 0; a remainder has nulls there."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    conversations = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = conversations.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == trainable).alias("trained"),
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit(OPEN_END)).alias("head"),
        escape(t["text"]).alias("body"))).alias("turns"))
    # the 1-based positions of the replies, and the last position for a remainder
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (
        F.element_at("turns", i)["trained"] | (i == F.size("turns"))))
    examples = written.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    last = F.element_at("turns", F.col("upto"))
    context = F.array_join(F.transform(
        F.slice("turns", 1, F.col("upto") - 1),
        lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    parts = examples.select("conv_id", "example", context.alias("context"), last.alias("last"))
    return parts.select(
        "conv_id", "example",
        F.concat("context", "last.head", "last.body", F.lit(CLOSE)).alias("text"),
        F.when(F.col("last.trained"), F.char_length("context") + F.char_length("last.head"))
        .cast("long").alias("loss_start"),
        F.when(F.col("last.trained"), F.char_length("last.body")).cast("long").alias("loss_chars"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from one formatted text."""
    pattern = r"(?s)<\|((?:(?!\|>).)*)\|>((?:(?!<\|).)*)<\|end\|>"
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), unescape).alias("text"))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: its turns, as written in its longest example, and
    all text under the loss mask in order."""
    masked = F.col("text").substr((F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    return examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct(
            F.col("example"), unescape(masked).alias("loss"))))).alias("losses"),
        F.sum(F.char_length("text").cast("long")).alias("formatted_chars"),
    ).select("conv_id", read_turns(F.col("longest")).alias("turns"),
             F.array_join("losses.loss", "").alias("loss"), "formatted_chars")
