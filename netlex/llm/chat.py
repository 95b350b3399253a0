"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all preceding turns as context and that reply as the only trainable
span. What follows the last assistant turn (or a conversation without one) becomes a last example without a trainable
span, so that no turn is lost. A turn is written as

    <|im_start|>role\\n text <|im_end|>\\n

Control strings inside a role or text are escaped by a backslash after their first character: `</s>` is
written `<\\/s>`, and `<\\/s>` is written `<\\\\/s>`; reading takes one backslash away again.

Nulls: a null role or text is empty; null conv_id values form one conversation; null turns come first. Turns with the
same number are ordered by role, then text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rest of each control string after its first character `<` or `[`.
CONTROL_REST = r"\|im_start\||\|im_end\||\|endoftext\||/?s>|/?INST\]|<SYS>>|</SYS>>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ESCAPE = rf"([<\[])(\\*)({CONTROL_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({CONTROL_REST})"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def _escape_role(c: Column) -> Column:
    """Roles stay on one line: a line feed in a role is written as backslash n, a backslash is doubled."""
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    # A written role has no line feed: doubled backslashes become one for a while, backslash n a backslash; then they change places.
    marked = F.replace(F.replace(c, F.lit("\\\\"), F.lit("\n")), F.lit("\\n"), F.lit("\\"))
    return unescape(F.translate(marked, "\n\\", "\\\n"))


def expand(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), n_turns (in this example), loss_start, loss_end (code points; equal: none), formatted."""
    turns = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    head = lambda t: F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n"))
    parts = convs.select(
        "conv_id",
        F.transform("turns", head).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.filter(
            F.transform("turns", lambda t, i: F.when((t["role"] == assistant) | (i == n - 1), F.struct((i + 1).alias("upto"), (t["role"] == assistant).alias("trained")))),
            lambda x: x.isNotNull(),
        ).alias("ends"),
    )
    shown = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(f"{CLOSE}\n")))
    examples = parts.select("conv_id", shown.alias("shown"), "bodies", F.posexplode("ends").alias("k", "end"))
    context = F.array_join(F.slice("shown", 1, F.col("end.upto")), "")
    tail = F.lit(len(CLOSE) + 1)
    body = F.char_length(F.element_at("bodies", F.col("end.upto")))
    made = examples.select("conv_id", (F.col("k") + 1).alias("example"), F.col("end.upto").alias("n_turns"), F.col("end.trained").alias("trained"), context.alias("formatted"), body.alias("body"))
    loss_end = (F.char_length("formatted") - tail).cast("long")
    return made.select("conv_id", "example", "n_turns", F.when(F.col("trained"), loss_end - F.col("body")).otherwise(loss_end).alias("loss_start"), loss_end.alias("loss_end"), "formatted")


def read_back(examples: DataFrame) -> DataFrame:
    """One row a conversation from its written examples: turns, loss text (both unescaped) and sizes."""
    loss = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    slim = examples.select("conv_id", "example", F.char_length("formatted").cast("long").alias("chars"), loss.alias("loss"), "formatted")
    g = slim.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    blocks = F.split(F.substr("longest", F.lit(1), F.char_length("longest") - len(CLOSE) - 1), r"<\|im_end\|>\n")
    turn = lambda b: F.struct(
        _unescape_role(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text"),
    )
    return g.select("conv_id", F.transform(blocks, turn).alias("turns"), "loss", "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
