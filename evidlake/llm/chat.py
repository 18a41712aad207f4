"""Chat formatting: every assistant turn becomes an example of its own.

The template writes a turn as ``<|im_start|>role<|im_sep|>text<|im_end|>``. A ``<|`` inside a role or text gets a
backslash between its two characters (one more, if it has some already), so no control string survives there and
``unescape`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
ANSWERS = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def prefix_targets(conversations: DataFrame, answers: str = ANSWERS) -> DataFrame:
    """An example for each turn of role ``answers``: all turns up to it, of which only its text is trainable.

    Takes rows (conv_id, turn, role, text); other columns are ignored. Gives conv_id, n_turns (turns in the
    example), is_last (the example holds the whole conversation), formatted, loss_start (from 0) and loss_length,
    in code points of ``formatted``.

    Turns are in the order of turn, role, text, nulls first; repeated rows are repeated turns. A null role or text
    is empty. Null conv_ids form one conversation. A conversation that doesn't end with such a turn has one example
    more, with all its turns and nothing trainable (loss_length 0), so no turn is lost. No rows: no examples.

    The turns of a conversation meet in one row, as they do in its longest example; the prefixes are made row by
    row behind that, and are never held or shuffled together.
    """
    c = conversations
    turns = c.select(
        c["conv_id"].alias("conv_id"),
        F.struct(
            c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"),
            F.coalesce(c["text"], F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.concat(F.lit(OPEN), escape(t.role), F.lit(MIDDLE), escape(t.text), F.lit(CLOSE)),
        ).alias("turns"),
        F.filter(
            F.transform(
                "turns",
                lambda t, i: F.struct(
                    (i + 1).alias("n_turns"), (i + 1 == F.size("turns")).alias("is_last"),
                    (t.role == answers).alias("answer"), F.length(escape(t.text)).alias("length"),
                ),
            ),
            lambda x: x.answer | x.is_last,
        ).alias("targets"),
    )
    one = whole.select("conv_id", "turns", F.explode("targets").alias("x"))
    return one.select(
        "conv_id",
        F.col("x.n_turns").cast("long").alias("n_turns"),
        "x.is_last",
        F.array_join(F.slice("turns", 1, F.col("x.n_turns")), "").alias("formatted"),
        F.col("x.answer").alias("answer"),
        F.col("x.length").alias("length"),
    ).select(
        "conv_id", "n_turns", "is_last", "formatted",
        F.when(F.col("answer"), F.length("formatted") - F.lit(len(CLOSE)) - F.col("length")).otherwise(0)
        .cast("long").alias("loss_start"),
        F.when(F.col("answer"), F.col("length")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What a reader finds in the examples of each conversation: its turns, and the text under the loss mask.

    Per conv_id: n_turns, turns_sha256 (of role, line feed, text, line feed per turn), loss_chars, loss_sha256 (of
    all trainable text, unescaped, in order), formatted_chars (of all its examples). Every conversation has exactly
    one example with is_last, whose text is taken apart for the turns.
    """
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    small = examples.select(
        "conv_id",
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
        F.when(F.col("loss_length") > 0, F.struct("n_turns", loss.alias("text"))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    found = small.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x.text), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    # Every turn ends with CLOSE, so what follows the last one is empty.
    turns = F.transform(
        F.slice(F.split("whole", r"<\|im_end\|>"), 1, F.size(F.split("whole", r"<\|im_end\|>")) - 1),
        lambda t: F.concat(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)), F.lit("\n"),
            unescape(F.substring_index(t, MIDDLE, -1)), F.lit("\n"),
        ),
    )
    return found.select("conv_id", turns.alias("turns"), "loss", "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
