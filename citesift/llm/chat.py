r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
text is trainable. An example is a prefix of the formatted conversation, so a conversation is
formatted once and its examples are cuts of that string, made row by row when they are exploded.
Turns behind the last assistant turn are in no such prefix; they are kept in one more row without a
target (``trainable`` false), so that nothing is lost.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` for each turn. Control strings inside roles and
texts are broken by a backslash behind their first character, after doubling every backslash that
the text has; so the doubled ones stand in even runs, and a single one between those characters can
only be an escape. Line ends inside a role become ``[\NL]`` by the same argument.

The sum of all prefixes grows with the square of a conversation's length, which is what the method
asks for. Rows with one formatted conversation and its list of targets (``format_conversations``)
do not, and are the form to store.

Defined cases: NULL roles and texts are empty; turns with equal numbers are ordered by role and
text, NULL numbers come first; repeated rows are turns like any other; a NULL ``conv_id`` is a
conversation; a conversation without an assistant turn is one row without a target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.frames import column

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"
# Control strings of this template and of other common ones. The first character
# of each is followed by the rest in the look-ahead.
CONTROL = r"([<\[])(?=\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])\\(?=\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
LINE_END, LINE_END_ESCAPED = "\n", "[\\NL]"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1"), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(LINE_END), F.lit(LINE_END_ESCAPED))


def unescape_role(role: Column) -> Column:
    # Line ends go back first: a doubled backslash never stands alone between "[" and "NL]".
    return unescape(F.replace(role, F.lit(LINE_END_ESCAPED), F.lit(LINE_END)))


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``n_turns`` and ``targets``.

    ``targets`` lists ``start`` and ``length`` (code points) of each assistant text in ``formatted``.
    """
    said = F.struct(
        column(turn).alias("turn"),
        F.coalesce(column(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(column(text).cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.select(column(conv).alias("conv_id"), said.alias("said"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # (before, text, after) of every turn; offsets are running sums of their lengths.
    pieces = F.transform(
        "said",
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == TARGET_ROLE).alias("target"),
        ),
    )
    turns = turns.select("conv_id", pieces.alias("pieces"))
    lengths = F.transform(
        "pieces",
        lambda p: F.struct(
            F.length(p["head"]).cast("bigint").alias("head"),
            F.length(p["body"]).cast("bigint").alias("body"),
            p["target"].alias("target"),
        ),
    )
    turns = turns.withColumn("lengths", lengths)
    nothing = F.expr("named_struct('at', 0L, 'found', array())").cast(
        "struct<at:bigint,found:array<struct<start:bigint,length:bigint>>>"
    )

    def walk(state: Column, p: Column) -> Column:
        start = state["at"] + p["head"]
        one = F.array(F.struct(start.alias("start"), p["body"].alias("length")))
        found = F.when(p["target"], F.concat(state["found"], one)).otherwise(state["found"])
        return F.struct((start + p["body"] + len(END)).alias("at"), found.alias("found"))

    return turns.select(
        "conv_id",
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""
        ).alias("formatted"),
        F.size("pieces").cast("bigint").alias("n_turns"),
        F.aggregate("lengths", nothing, walk, lambda s: s["found"]).alias("targets"),
    )


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: ``conv_id, example, trainable, formatted, loss_start, loss_length, last``.

    ``example`` numbers them within a conversation from 0; ``last`` marks the one that holds all turns.
    """
    n_end = F.lit(len(END))
    cuts = F.transform(
        "targets",
        lambda t: F.struct(
            F.lit(True).alias("trainable"),
            t["start"].alias("start"),
            t["length"].alias("length"),
            (t["start"] + t["length"] + n_end).alias("cut"),
        ),
    )
    total = F.length("formatted").cast("bigint")
    rest = F.array(
        F.struct(
            F.lit(False).alias("trainable"),
            total.alias("start"),
            F.lit(0).cast("bigint").alias("length"),
            total.alias("cut"),
        )
    )
    covered = F.coalesce(F.try_element_at("cuts", F.lit(-1))["cut"], F.lit(-1)) == total
    cutting = (
        conversations.withColumn("cuts", cuts)
        .withColumn("cuts", F.when(covered, F.col("cuts")).otherwise(F.concat("cuts", rest)))
        .select("conv_id", "formatted", F.posexplode("cuts").alias("example", "cut"), F.size("cuts").alias("n"))
    )
    return cutting.select(
        "conv_id",
        F.col("example").cast("bigint"),
        "cut.trainable",
        F.substring(F.col("formatted"), F.lit(1), F.col("cut.cut").cast("int")).alias("formatted"),
        F.col("cut.start").alias("loss_start"),
        F.col("cut.length").alias("loss_length"),
        (F.col("example") == F.col("n") - 1).alias("last"),
    )


def chat_examples(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Formatted examples of a table of turns, see the module."""
    return expand(format_conversations(rows, conv, turn, role, text))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inside = F.transform(turns, lambda t: F.substring(t, F.lit(len(START) + 1), F.length(t)))
    return F.transform(
        inside,
        lambda t: F.struct(
            unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(
                F.substring(t, F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t))
            ).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), length.cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what the examples say when they are read back."""
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("bigint").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.when(F.col("last"), parse(F.col("formatted"))).alias("turns"),
    ).select(
        "conv_id",
        "example",
        "chars",
        "loss",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(
            F.array_join(
                F.transform(
                    "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
                ),
                "",
            ).cast("binary"),
            256,
        ).alias("turns_sha256"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("example", "loss")))
    per_conv = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(ordered, lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return per_conv.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
