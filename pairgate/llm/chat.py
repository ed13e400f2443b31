"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs and sorted; neighbours of one role become one
block, and blocks are concatenated:

    <s>role<r>text<t>text of the same role</s><s>role<r>...</s>

Control strings inside roles and texts get a backslash after their first character (one more, if
there are some already), so none of them can be taken for the template's, and the text comes back
exactly.  ``loss`` holds the (start, length) of every assistant text in code points of the
formatted string: the tokens to learn from; markers are never in it.

A conversation becomes one string, so it is bounded by what one row can hold; nothing larger than
a conversation meets in a task.  The running positions are kept in an array per conversation.

Defined cases: null text and null role are empty; turns order by (turn, role, text), null turns
first; repeated rows are turns of their own; a null conv_id is a conversation; empty tables give
an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and common ones that are escaped with them.
OPEN, ROLE, NEXT, CLOSE = "<s>", "<r>", "<t>", "</s>"
TAIL = r"(/?s>|r>|t>|/?INST\])"
ESCAPE = r"([<\[])(\\*)" + TAIL
UNESCAPE = r"([<\[])\\(\\*)" + TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def format_conversations(rows: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (array of start, length; starts count from 0)."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # Where a block starts: at the first turn, and where the role changes.
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]),
    )
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.col("turns")[s]["role"].alias("role"),
            F.transform(
                F.slice(
                    "turns",
                    s + 1,
                    F.coalesce(F.get("starts", k + 1), F.size("turns")) - s,
                ),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    merged = turns.withColumn("starts", starts).select("conv_id", blocks.alias("blocks"))
    # One piece per text: what stands before it, and the text.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.when(
                        j == 0,
                        F.concat(F.when(k > 0, CLOSE).otherwise(""), F.lit(OPEN), escape(b["role"]), F.lit(ROLE)),
                    )
                    .otherwise(NEXT)
                    .alias("before"),
                    t.alias("text"),
                    (b["role"] == learn_role).alias("learn"),
                ),
            ),
        )
    )
    flat = merged.select("conv_id", pieces.alias("pieces"))
    walked = F.aggregate(
        "pieces",
        F.struct(
            F.lit(0).cast("long").alias("at"),
            F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["before"]) + F.char_length(p["text"])).cast("long").alias("at"),
            F.when(
                p["learn"],
                F.array_append(
                    acc["spans"],
                    F.struct(
                        (acc["at"] + F.char_length(p["before"])).cast("long").alias("start"),
                        F.char_length(p["text"]).cast("long").alias("length"),
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.concat(
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(CLOSE)
    )
    return flat.select("conv_id", text.alias("formatted"), walked.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    blocks = F.transform(F.split(formatted, CLOSE, -1), lambda b: F.split(F.substr(b, F.lit(4)), ROLE, 2))
    whole = F.filter(blocks, lambda b: F.size(b) == 2)
    return F.flatten(
        F.transform(
            whole,
            lambda b: F.transform(
                F.split(b[1], NEXT, -1),
                lambda t: F.struct(unescape(b[0]).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: unescape(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the output."""
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
