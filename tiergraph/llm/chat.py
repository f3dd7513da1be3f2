"""Chat formatting that proves itself by a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template. Every role has an opening and a closing mark; roles
# without marks of their own are spelled out before their text.
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
    "system": ("<<SYS>> ", " <</SYS>>"),
}
ROLE, TEXT = ("[ROLE] ", " [/ROLE]"), ("[TEXT] ", " [/TEXT]")
#: What follows the first character of a control string.
SQUARE, ANGLE = r"/?(?:INST|ROLE|TEXT)\]", r"(?:/?s>|</?SYS>>)"
CONTROL = rf"(\[(?=\\*{SQUARE})|<(?=\\*{ANGLE}))"
ESCAPED = rf"(\[(?=\\+{SQUARE})|<(?=\\+{ANGLE}))\\"
TURN = (
    r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>"
    r"|\[ROLE\] .*? \[/ROLE\]\[TEXT\] .*? \[/TEXT\]"
)


def escape(text: Column) -> Column:
    """Break every control string by one more backslash after its first character."""
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    """Take one backslash out of every broken control string."""
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1"))


def _between(turn: Column, marks: tuple[str, str]) -> Column:
    before, after = map(len, marks)
    return F.substring(turn, F.lit(before + 1), F.length(turn) - before - after)


def render(turns: Column) -> Column:
    """One string of an array of (role, text), both as they should appear."""

    def one(t: Column) -> Column:
        out = F.concat(
            F.lit(ROLE[0]), escape(t["role"]), F.lit(ROLE[1] + TEXT[0]), t["text"], F.lit(TEXT[1])
        )
        for role, (before, after) in MARKS.items():
            marked = F.concat(F.lit(before), t["text"], F.lit(after))
            out = F.when(t["role"] == role, marked).otherwise(out)
        return out

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text), by the grammar.

    A turn ends at the first closing mark of its kind. Null where anything is left
    between or after turns.
    """

    def one(m: Column) -> Column:
        split = F.instr(m, ROLE[1] + TEXT[0])
        role = F.substring(m, F.lit(len(ROLE[0]) + 1), split - len(ROLE[0]) - 1)
        tail = F.substring(m, split + len(ROLE[1]), F.length(m))
        out = F.struct(
            unescape(role).alias("role"), unescape(_between(tail, TEXT)).alias("text")
        )
        for name, marks in MARKS.items():
            known = F.struct(
                F.lit(name).alias("role"), unescape(_between(m, marks)).alias("text")
            )
            out = F.when(m.startswith(marks[0]), known).otherwise(out)
        return out

    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    whole = F.array_join(found, "") == formatted
    return F.when(whole, F.transform(found, one))


def format_chats(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``id``, ``formatted``, ``turns`` read back from it, ``loss_text``.

    The turns are rendered as they are, parsed again and compared. Texts that do not
    survive alone are escaped and the conversation is rendered again; should it still
    differ, all its texts are escaped, which always survives. ``turns`` and ``loss_text``
    (what the assistant says, in order, nothing between) come from parsing the result.

    Turns are in order of their number, ties by role and text; a null number comes
    first. Null texts and roles count as empty; any role is accepted. Rows with a null
    id are one conversation. A conversation is one string, so its rows meet in one task;
    nothing else is gathered. Other columns are not read. An empty table gives an empty
    result.
    """
    source = (
        rows.select(
            F.col(id_col).alias("id"),
            F.struct(
                F.col(turn_col).alias("turn"),
                F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("source"))
    )
    survives = lambda t: F.coalesce(parse(render(F.array(t))) == F.array(t), F.lit(False))
    escaped = lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))
    same = lambda c: F.coalesce(parse(F.col(c)) == F.col("source"), F.lit(False))
    drafts = (
        source.withColumn("plain", render(F.col("source")))
        .withColumn("fits", same("plain"))
        .withColumn(
            "mended",
            F.when(
                ~F.col("fits"),
                render(F.transform("source", lambda t: F.when(survives(t), t).otherwise(escaped(t)))),
            ),
        )
        .withColumn("mends", same("mended"))
    )
    return (
        drafts.select(
            "id",
            F.when(F.col("fits"), F.col("plain"))
            .when(F.col("mends"), F.col("mended"))
            .otherwise(render(F.transform("source", escaped)))
            .alias("formatted"),
        )
        .withColumn("turns", parse(F.col("formatted")))
        .withColumn(
            "loss_text",
            F.array_join(
                F.transform(
                    F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]
                ),
                "",
            ),
        )
    )
