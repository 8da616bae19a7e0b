"""Chat formatting in relational terms: turns are collected as structs, sorted, merged and joined by Spark expressions.

A formatted conversation is one text. Turns of one role that follow each other share a block::

    <|im_start|>role
    text<|im_next|>text of the same role<|im_end|>

Every ``<|`` of a text or role is written ``<\\|``, and one backslash more stands wherever there were some already, so
no text can hold a control string and the way back is exact. A line break inside a role is ``<|im_line|>``.

The text is kept as ``segments``: (label, text) pairs whose texts on end are the formatted conversation, and whose
label says whether the loss counts there. It counts for the texts of the learned role, never for control strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END, LINE = "<|im_start|>", "<|im_next|>", "<|im_end|>\n", "<|im_line|>"
SEGMENTS = "array<struct<label:boolean,text:string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _literal(mark: str) -> str:
    return mark.replace("|", r"\|")


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation as sorted (turn, role, text) structs."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    known = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return known.union(rows.where("conv_id IS NULL").select("conv_id", F.array("turn")))


def formatted(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """Per conversation of ``conversations`` (``conv_id, turn, role, text``; other columns are ignored): ``conv_id``
    and ``segments``.

    Rows of a conversation come by turn, those of an equal turn by role and text, those without a turn first; repeated
    rows are turns like any other. A null text or role is empty. Rows without a conv_id can't be said to belong
    together, so each is a conversation by itself. An empty table gives an empty one. A conversation is one value of
    its row, so it may hold what a Spark string and array can (2 GB); a hot conv_id beyond that fails.
    """
    turns = turns_of(conversations)

    def role(i: Column) -> Column:
        return F.get("turns", i)["role"]

    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    # a block is a stretch of turns of one role: from its start to the start of the next
    cut = turns.withColumn("starts", starts)
    blocks = cut.select(
        "conv_id",
        F.transform(
            "starts",
            lambda at, k: F.struct(
                role(at).alias("role"),
                F.slice("turns", at + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - at)["text"].alias("texts"),
            ),
        ).alias("blocks"),
    )

    def segment(label: bool, text: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), text.alias("text"))

    def segments(block: Column) -> Column:
        name = F.replace(escaped(block["role"]), F.lit("\n"), F.lit(LINE))
        head = F.concat(F.lit(START), name, F.lit("\n"))
        texts = F.transform(block["texts"], escaped)
        plain = F.array(segment(False, F.concat(head, F.array_join(texts, NEXT), F.lit(END))))
        parts = F.transform(
            texts,
            lambda text, k: F.array(segment(False, F.when(k == 0, head).otherwise(F.lit(NEXT))), segment(True, text)),
        )
        taught = F.concat(F.flatten(parts), F.array(segment(False, F.lit(END))))
        return F.when(block["role"] == learned, taught).otherwise(plain)

    return blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(segments["text"], "")


def turns_read(text: Column) -> Column:
    """The (role, text) structs that a formatted text was made of."""

    def of_block(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + 2, F.length(block))
        name = unescaped(F.replace(F.replace(head, F.lit(START), F.lit("")), F.lit(LINE), F.lit("\n")))
        return F.transform(
            F.split(body, _literal(NEXT), -1), lambda part: F.struct(name.alias("role"), unescaped(part).alias("text"))
        )

    blocks = F.filter(F.split(text, _literal(END), -1), lambda block: block != "")
    return F.flatten(F.transform(blocks, of_block))


def digests(segments: DataFrame) -> DataFrame:
    """What a reader gets out of formatted conversations: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars`` and ``n_blocks``, all from the ``segments`` alone.

    ``turns_sha256`` is over role, line break, text, line break of every turn; ``loss_*`` are over the unescaped texts
    under the loss, on end.
    """
    read = segments.select(
        "conv_id",
        formatted_text(F.col("segments")).alias("formatted"),
        F.array_join(
            F.transform(F.filter("segments", lambda s: s["label"]), lambda s: unescaped(s["text"])), ""
        ).alias("loss"),
    )
    read = read.withColumn("turns", turns_read(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        (F.size(F.split("formatted", _literal(END), -1)) - 1).cast("long").alias("n_blocks"),
    )
