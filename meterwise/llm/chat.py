"""Chat formatting with a grammar round trip: render, reparse, compare, escape, compare again.

The rendered grammar (control strings are fixed values of the template):

    conversation := turn*
    turn         := "<s>[INST] " role "\n" text " [/INST]</s>"

Roles and texts hold no control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``). Inside roles and texts a control string is written with a backslash behind its first character,
and one that already has backslashes there gets one more, so no control string remains and the
change can be undone. A role's line breaks and percent signs are written as ``%0A`` and ``%25``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.native import chunks, cut, let, sums_before

OPEN, SPLIT, CLOSE, END = "<s>[INST] ", "\n", " [/INST]", "</s>"
_TURN = r"(?s)^<s>\[INST\] ([^\n]*)\n(.*) \[/INST\]\z"
_CONTROL = r"</?s>|\[/?INST\]"
_CONFLICT = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape_text(text: Column) -> Column:
    """Break every control string by one backslash."""
    return F.regexp_replace(text, F.lit(_CONFLICT), F.lit(r"$1$2\\$3"))


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def escape_role(role: Column) -> Column:
    lines = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return escape_text(lines)


def unescape_role(role: Column) -> Column:
    # Every % is followed by 25 or 0A here, so "%250A" holds no "%0A".
    return F.replace(F.replace(unescape_text(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column) -> Column:
    """The text of an array of turns whose roles and texts are written as they are."""
    pieces = F.transform(
        turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SPLIT), t["text"], F.lit(CLOSE + END))
    )
    return F.array_join(pieces, "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered text.

    What does not follow the grammar, a control string inside a role or text included, parses
    as a null role and text, which no source has.
    """
    pieces = F.split(formatted, F.lit(END), F.lit(-1))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role, text = F.regexp_extract(piece, _TURN, 1), F.regexp_extract(piece, _TURN, 2)
        good = piece.rlike(_TURN) & ~role.rlike(_CONTROL) & ~text.rlike(_CONTROL)
        return F.struct(
            F.when(good, unescape_role(role)).alias("role"), F.when(good, unescape_text(text)).alias("text")
        )

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``id_col``, ``turns``, ``formatted``, ``escaped``, ``loss_spans``.

    Turns are ordered by ``turn_col``, then role and text, so ties and repeated rows have a
    fixed order and each is a turn. A null turn comes first, a null role or text is empty, rows
    with a null id form one conversation. ``turns`` is the source as an array of (role, text);
    ``loss_spans`` are the (start, length) of the learnt role's texts in ``formatted``, in code
    points. Other columns are not read. An empty table gives an empty one.

    A conversation is rendered as it is and parsed again; only if the parsed turns differ from
    the source, it is rendered with its conflicting content escaped and must then parse to the
    source, or the job fails. A conversation is one row of the result, so its turns meet in one
    row; conversations are spread by their ids.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("sorted"))
    grouped = grouped.select(
        id_col,
        F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )
    plain = grouped.withColumn("plain", render(F.col("turns")))
    plain = plain.withColumn("escaped", ~F.col("turns").eqNullSafe(parse(F.col("plain"))))
    written = plain.withColumn(
        "written",
        F.when(
            F.col("escaped"),
            F.transform(
                "turns",
                lambda t: F.struct(escape_role(t["role"]).alias("role"), escape_text(t["text"]).alias("text")),
            ),
        ).otherwise(F.col("turns")),
    )
    done = written.withColumn("formatted", F.when(F.col("escaped"), render(F.col("written"))).otherwise(F.col("plain")))
    agrees = ~F.col("escaped") | F.col("turns").eqNullSafe(parse(F.col("formatted")))
    done = done.withColumn(
        "formatted", F.when(agrees, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back")).cast("string"))
    )
    lengths = F.transform(
        "written", lambda t: F.length(t["role"]) + F.length(t["text"]) + len(OPEN + SPLIT + CLOSE + END)
    )

    def span(turn: Column, start: Column) -> Column:
        return F.struct(
            (start + len(OPEN + SPLIT) + F.length(turn["role"])).alias("start"),
            F.length(turn["text"]).cast("long").alias("length"),
        )

    spans = F.zip_with("written", sums_before(lengths), span)
    learnt = F.zip_with(spans, F.transform("turns", lambda t: t["role"] == learn_role), lambda s, on: F.when(on, s))
    return done.select(
        id_col, "turns", "formatted", "escaped", F.filter(learnt, lambda s: s.isNotNull()).alias("loss_spans")
    )


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text itself says: ``parsed`` turns and ``loss_text`` under the mask."""
    masked = let(
        chunks(F.col("formatted")),
        lambda pieces: F.transform(
            "loss_spans", lambda s: unescape_text(cut(pieces, s["start"], s["length"]))
        ),
    )
    return formatted.select(
        id_col, "formatted", parse(F.col("formatted")).alias("parsed"), F.array_join(masked, "").alias("loss_text")
    )
