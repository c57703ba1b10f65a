"""Chat formatting with Spark expressions only.

A conversation becomes one string: its turns in order, adjacent turns of one
role merged into a block. The marks cannot occur in a text, since a backslash is
put inside every one found there (and before every backslash), so the string can
be read back into the very turns it was made of.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import bound_to, text_or_empty

BEGIN, HEAD, NEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = (BEGIN, HEAD, NEXT, END)
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without any of the marks; ``unescaped`` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(m[0] + "\\" + m[1:])), MARKS, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, formatted, segments)``, one row per conversation.

    ``segments`` are the parts of ``formatted`` in order, each with ``loss``: true
    for the texts of assistant turns. Turns are ordered by number, null first;
    equal numbers by role and text, so repeated rows are turns of their own. Null
    texts and roles count as empty; rows with a null conversation are one
    conversation. An empty table has no conversations; other columns are not
    looked at. A conversation is one row of the result and so must fit in a task.
    """
    ordered = turns.groupBy(F.col(conv).alias("c")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).alias("turn"),
                    text_or_empty(role).alias("role"),
                    text_or_empty(text).alias("text"),
                )
            )
        ).alias("turns")
    )
    parts = ordered.select("c", bound_to(F.col("turns"), _segments).alias("segments"))
    return parts.select(
        F.col("c").alias(conv), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"
    )


def _segments(turns: Column) -> Column:
    """The segments of all blocks; a block starts where the role changes."""
    places = F.sequence(F.lit(1), F.size(turns))
    at = lambda i: F.element_at(turns, i)
    starts = F.filter(places, lambda i: (i == 1) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"]))

    def block(starts: Column) -> Column:
        def one(start: Column, number: Column) -> Column:
            following = F.coalesce(F.get(starts, number + 1), F.size(turns) + 1)
            members = F.slice(turns, start, following - start)
            plain = lambda t: F.struct(t.alias("text"), F.lit(False).alias("loss"))
            texts = F.transform(
                members,
                lambda m, i: F.array(
                    plain(F.when(i == 0, F.concat(F.lit(BEGIN), escaped(m["role"]), F.lit(HEAD))).otherwise(NEXT)),
                    F.struct(escaped(m["text"]).alias("text"), (m["role"] == LEARNT_ROLE).alias("loss")),
                ),
            )
            return F.concat(F.flatten(texts), F.array(plain(F.lit(END))))

        return F.flatten(F.transform(starts, one))

    return bound_to(starts, block)


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text)."""
    cut_at = lambda c, mark: F.split(c, re.escape(mark), -1)

    def turns(block: Column) -> Column:
        head = F.substring_index(F.substring(block, len(BEGIN) + 1, 2147483647), HEAD, 1)
        body = F.substring(block, F.length(head) + len(BEGIN) + len(HEAD) + 1, F.lit(2147483647))
        return F.transform(
            cut_at(body, NEXT), lambda t: F.struct(unescaped(head).alias("role"), unescaped(t).alias("text"))
        )

    # What follows the last end mark is empty.
    blocks = cut_at(formatted, END)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
