"""Chat formatting by prefix-target expansion, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The strings that steer a model, of this template and of others like it.
CONTROL = r"/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>|<SYS>>|</SYS>>"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """`text` with a backslash set into each control string, after its first character.

    A text that holds such an escaped string already gets one more backslash,
    so `unescaped` always gives the text back.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*)(?=(?:{CONTROL}))", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?=(?:{CONTROL}))", "$1$2")


def _role(c: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(c: Column) -> Column:
    parts = F.split(unescaped(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expand(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_col, example, n_turns, target, formatted, loss_start, loss_end, last`, a row for each example.

    A turn is written as `<s>role`, a line break, its text, `</s>` and a line
    break; control strings inside roles and texts are escaped. Every assistant
    turn becomes an example of its own: all turns before it, then it. Only its
    text is trainable: the code points from loss_start to loss_end, exclusive.
    Turns after the last assistant turn stand in one more example, without a
    target, so that nothing of a conversation is lost. `last` marks the example
    that holds all turns.

    A null text or role is empty; turns of equal number are sorted by role and
    text, repeated rows are turns each; rows of a null conversation are one
    conversation; an empty table gives no rows. Other columns are not looked
    at. A conversation's turns meet in one row, as an example must hold them.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    convs = conversations.groupBy(F.col(conv_col).alias("__conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.select(
        "__conv",
        F.transform("turns", lambda t: t["role"] == TARGET_ROLE).alias("aims"),
        F.transform("turns", lambda t: F.concat(F.lit("<s>"), _role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("bodies"),
    )
    n = F.size("aims")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("aims", i) | (i == n))
    each = convs.select("*", n.alias("all"), F.posexplode(ends).alias("example", "n_turns"))
    k, end = F.col("n_turns"), F.lit("</s>\n")
    before = F.array_join(F.transform(F.slice(F.arrays_zip("heads", "bodies"), F.lit(1), k - 1), lambda t: F.concat(t["heads"], t["bodies"], end)), "")
    each = each.select("__conv", "example", "n_turns", F.element_at("aims", k).alias("target"), F.concat(before, F.element_at("heads", k)).alias("lead"), F.element_at("bodies", k).alias("body"), (k == F.col("all")).alias("last"))
    start = F.length("lead")
    return each.select(
        F.col("__conv").alias(conv_col), "example", "n_turns", "target", F.concat("lead", "body", end).alias("formatted"),
        F.when(F.col("target"), start).alias("loss_start"), F.when(F.col("target"), start + F.length("body")).alias("loss_end"), "last",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    whole = r"(?s)<s>([^\n]*)\n(.*?)</s>\n"
    both = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(whole), F.lit(1)).alias("role"), F.regexp_extract_all(formatted, F.lit(whole), F.lit(2)).alias("text"))
    return F.transform(both, lambda t: F.struct(_role_back(t["role"]).alias("role"), unescaped(t["text"]).alias("text")))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped; empty without a target."""
    return F.coalesce(unescaped(F.substring(formatted, start + 1, end - start)), F.lit(""))


def digest(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Of each conversation, read back from its examples: its turns, its trainable text and the sizes."""
    turns = F.when(F.col("last"), F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    count = F.when(F.col("last"), F.size(read_back(F.col("formatted"))))
    rows = examples.select(conv_col, "example", turns.alias("turns"), count.alias("n_turns"), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), F.length("formatted").alias("chars"))
    found = rows.groupBy(conv_col).agg(F.max("n_turns").cast("long").alias("n_turns"), F.max("turns").alias("turns"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return found.select(conv_col, "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
