"""Chat formatting with Spark expressions only.

``format_chat`` sorts each conversation's collected turn structs, merges
adjacent turns of one role into a block, and concatenates the blocks:

    <|turn|>role\\n text <|also|> text <|done|>\\n

A block's texts stay apart by ``<|also|>``, so merging loses no turn.  Inside
texts and roles every ``<`` + backslashes + ``|`` gets one more backslash; no
marker can then occur there, and ``read_chat`` takes it off again.  A line
break in a role is written as ``<|line|>``.

Defined results: null text and null role count as empty; null turns sort
first; equal turns sort by role, then text, and repeated rows stay; rows with a
null ``conv_id`` form one conversation; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, ALSO, DONE, LINE = "<|turn|>", "<|also|>", "<|done|>\n", "<|line|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_chat(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` are the pieces of ``formatted`` in order as (text, loss);
    ``loss`` marks the texts of ``loss_roles``, without markers.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # block starts: the first turn and every turn whose role differs from the one before
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )
    blocks = starts.select(
        "conv_id",
        F.transform(
            "starts",
            lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - s),
        ).alias("blocks"),
    )

    def pieces(b: Column) -> Column:
        role = F.get(b, F.lit(0))["role"]
        head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
        texts = F.transform(
            b,
            lambda t, i: F.array(
                F.struct(F.when(i == 0, head).otherwise(F.lit(ALSO)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), role.isin(*loss_roles).alias("loss")),
            ),
        )
        end = F.array(F.struct(F.lit(DONE).alias("text"), F.lit(False).alias("loss")))
        return F.concat(F.flatten(texts), end)

    out = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return out.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text as they were) and ``loss`` (texts under the mask), parsed from the output."""
    blocks = F.split("formatted", r"<\|done\|>\n", -1)
    parsed = formatted.withColumn("blocks", F.slice(blocks, 1, F.size(blocks) - 1))

    def block(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.replace(F.substr(head, F.lit(len(TURN) + 1)), F.lit(LINE), F.lit("\n")))
        body = F.substr(b, F.char_length(head) + 2)
        return F.transform(
            F.split(body, r"<\|also\|>", -1),
            lambda x: F.struct(role.alias("role"), unescape(x).alias("text")),
        )

    return parsed.withColumn("turns", F.flatten(F.transform("blocks", block))).withColumn(
        "loss",
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])),
    ).drop("blocks")


def digest(read: DataFrame) -> DataFrame:
    """The digest columns of a formatted table that has been read back."""
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.withColumn("loss_text", F.array_join("loss", "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
