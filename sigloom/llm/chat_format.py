"""Chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The template: a turn is OPEN, role, MIDDLE, text, CLOSE. No escaped text has a character of OPEN's or CLOSE's first.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What stands for a character inside a text; the backslash's own comes first on the way in and last on the way back.
TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))
TRAINED = "assistant"


def escape(text: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=TEXT_ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_targets(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One example per assistant turn: (conv_id, n_turns, formatted, loss_start, loss_chars, trained).

    ``formatted`` holds all turns up to the target; ``loss_start`` (code
    points, from 0) and ``loss_chars`` mark the target's escaped text, which
    alone is trained on. Turns after the last assistant turn, and
    conversations without one, make a row with ``trained`` false and an empty
    mask, so no turn is lost.

    Turns are ordered by turn, then role and text, so ties and repeated rows
    have one order. Null role and text count as empty, a null turn comes
    first, null ids are one conversation. Other columns are not read. An
    example is one string, so a conversation must fit in one.
    """
    cell = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    talks = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(cell)).alias("turns"))
    header = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(MIDDLE))
    parts = F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), header(t).alias("header"), escape(t["text"]).alias("body"))
    )
    targets = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.get(F.col("turns"), i - 1)["role"] == TRAINED) | (i == F.size("turns")),
    )
    talks = talks.select("conv_id", parts.alias("parts"), targets.alias("targets"))
    rows = talks.select("conv_id", "parts", F.explode("targets").alias("n_turns"))
    written = lambda upto: F.array_join(
        F.transform(F.slice("parts", F.lit(1), upto), lambda p: F.concat(p["header"], p["body"], F.lit(CLOSE))), ""
    )
    target = F.get(F.col("parts"), F.col("n_turns") - 1)
    trained = target["role"] == TRAINED
    return rows.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        written(F.col("n_turns")).alias("formatted"),
        F.when(trained, F.char_length(written(F.col("n_turns") - 1)) + F.char_length(target["header"]))
        .otherwise(0)
        .cast("bigint")
        .alias("loss_start"),
        F.when(trained, F.char_length(target["body"])).otherwise(0).cast("bigint").alias("loss_chars"),
        trained.alias("trained"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted example."""
    blocks = F.split(formatted, CLOSE, -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def one(block: Column) -> Column:
        head = F.substring_index(block, MIDDLE, 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        text = F.substr(block, F.char_length(head) + F.lit(len(MIDDLE) + 1))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, one)


def masked_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), chars.cast("int")))
