"""Chat formatting with typed content parts, with DataFrame functions alone.

A turn's content is an array of parts ``struct<type, text, ref, size>``. A visitor turns
each part into text: texts are escaped, other parts become one placeholder, in order, and
leave an attachment record with the number of tokens the placeholder expands to. A turn is
written as ``<|im_start|>role\\ntext<|im_end|>\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,size:bigint>"
# Units of ``size`` per token: pixels of an image, milliseconds of audio, bytes of a document.
UNITS = {"image": 784, "audio": 40, "document": 4}


def escape(text: Column) -> Column:
    """No control mark survives: a backslash goes between ``<``, any backslashes, and ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Takes back what ``escape`` put in."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role in one line: ``%`` and line feed are percent-coded, marks escaped."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("%0A"), F.lit("\n"))
    return F.replace(plain, F.lit("%25"), F.lit("%"))


def text_parts(text: str | Column) -> Column:
    """A plain text as the one part of a turn; null counts as empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("size"),
        )
    )


def expanded_tokens(part: Column, units: dict[str, int] = UNITS) -> Column:
    """Tokens a placeholder stands for: size over unit, rounded up, one at least."""
    per = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    tokens = F.ceil(F.coalesce(part["size"], F.lit(0)) / F.coalesce(per[part["type"]], F.lit(1)))
    return F.greatest(tokens, F.lit(1)).cast("long")


def visit_part(part: Column) -> Column:
    """Text of one part: escaped text, or a placeholder that names the part's type."""
    kind = F.coalesce(part["type"], F.lit("text"))
    mark = F.concat(F.lit("<|"), F.regexp_replace(kind, "[^0-9A-Za-z_]", "_"), F.lit("|>"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def format_chat(
    turns: DataFrame,
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    parts: str | Column = "parts",
    loss_role: str = "assistant",
    units: dict[str, int] = UNITS,
) -> DataFrame:
    """One row per conversation: its formatted text and what it holds.

    ``formatted`` is the text. ``turns`` has, per turn and in order, ``at`` (where it
    starts), ``loss_at`` and ``loss_chars`` (where the text under the loss mask starts and
    how long it is; -1 and 0 for other roles). ``attachments`` has ``turn`` (its place
    from 0), ``type``, ``ref`` and ``tokens`` of each placeholder, in order, and
    ``attachment_tokens`` their sum.

    Turns are ordered by ``order``, then role and content, so repeated turn numbers are
    kept in a fixed order. Null parts, texts and roles count as empty, a part without a
    type is text, null conversation ids form one conversation. Extra columns are ignored,
    an empty table gives an empty table. A conversation is one output row and therefore
    one row in memory; nothing else is gathered.
    """
    content = F.coalesce(
        F.col(parts) if isinstance(parts, str) else parts, F.array().cast(f"array<{PART}>")
    )
    other = F.filter(content, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    read = turns.select(
        F.col(conv).alias("conv"),
        F.col(order).alias("order"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.array_join(F.transform(content, visit_part), "").alias("body"),
        F.transform(
            other,
            lambda p: F.struct(
                p["type"].alias("type"), p["ref"].alias("ref"),
                expanded_tokens(p, units).alias("tokens"),
            ),
        ).alias("held"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    drawn = read.select(
        "conv", "order", "role", "held",
        F.length(head).alias("head_chars"), F.length("body").alias("body_chars"),
        F.concat(head, F.col("body"), F.lit(END + "\n")).alias("drawn"),
    )
    w = Window.partitionBy("conv").orderBy("order", "role", "drawn")
    chars = F.length("drawn").cast("long")
    placed = drawn.select(
        "*",
        (F.row_number().over(w) - 1).alias("place"),
        (F.sum(chars).over(w.rowsBetween(Window.unboundedPreceding, 0)) - chars).alias("at"),
    )
    loss = F.col("role") == loss_role
    marks = F.struct(
        "at",
        F.when(loss, F.col("at") + F.col("head_chars")).otherwise(-1).alias("loss_at"),
        F.when(loss, F.col("body_chars").cast("long")).otherwise(0).alias("loss_chars"),
    )
    rows = placed.groupBy("conv").agg(
        F.sort_array(
            F.collect_list(F.struct("place", "drawn", marks.alias("marks"), "held"))
        ).alias("t")
    )
    held = F.flatten(
        F.transform(
            "t",
            lambda t: F.transform(
                t["held"],
                lambda h: F.struct(
                    t["place"].alias("turn"), h["type"].alias("type"), h["ref"].alias("ref"),
                    h["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return rows.select(
        F.col("conv").alias(conv),
        F.array_join("t.drawn", "").alias("formatted"),
        F.col("t.marks").alias("turns"),
        held.alias("attachments"),
        F.aggregate(held["tokens"], F.lit(0).cast("long"), lambda a, x: a + x).alias(
            "attachment_tokens"
        ),
    )


def read_chat(chats: DataFrame) -> DataFrame:
    """Reads ``formatted`` back: adds ``said``, role and text per turn, and ``learned``.

    ``learned`` holds, in order, the unescaped texts under the loss mask, each cut out of
    ``formatted`` by its place. Texts with placeholders keep these as they stand.
    """
    pieces = F.slice(
        F.split("formatted", r"<\|im_start\|>"), F.lit(2), F.size("turns")
    )
    role = lambda p: unescape_role(F.substring_index(p, "\n", 1))
    text = lambda p: F.substring_index(
        F.substr(p, F.locate("\n", p) + 1), END, 1
    )
    cut = lambda p, m: F.substr(
        p, (m["loss_at"] - m["at"] - len(START) + 1).cast("int"), m["loss_chars"].cast("int")
    )
    pairs = F.filter(
        F.arrays_zip(pieces.alias("p"), F.col("turns").alias("m")),
        lambda x: x["m"]["loss_at"] >= 0,
    )
    return chats.withColumns({
        "said": F.transform(
            pieces, lambda p: F.struct(role(p).alias("role"), unescape(text(p)).alias("text"))
        ),
        "learned": F.transform(pairs, lambda x: unescape(cut(x["p"], x["m"]))),
    })
