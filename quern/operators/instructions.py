"""Instruction conversations: roles, rendering, loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .messages import turn


def usable_turns(conversations: DataFrame, min_turns: int = 2) -> DataFrame:
    """(conv_id, messages): user and assistant turns in order with their thoughts taken out; empty turns go, and conversations of too few."""
    said = conversations.where(F.col("role").isin("user", "assistant")).withColumn("content", tx.drop_thoughts(F.col("text")))
    said = said.where(F.coalesce(F.col("content"), F.lit("")) != "")
    who = F.when(F.col("role") == "user", "USER").otherwise("ASSISTANT")
    parts = F.array_sort(F.collect_list(F.struct("turn", who.alias("speaker"), "content")))
    return said.groupBy("conv_id").agg(parts.alias("messages")).where(F.size("messages") >= min_turns)


def render(messages: DataFrame) -> DataFrame:
    body = F.array_join(F.transform("messages", lambda m: turn(m["speaker"], m["content"])), "")
    return messages.select("conv_id", F.size("messages").cast("long").alias("n_turns"), F.concat(F.lit("<s><|conv|>"), body, F.lit("</s>")).alias("text"))


def masked_tokens(messages: DataFrame, scored_speaker: str = "ASSISTANT") -> DataFrame:
    """(conv_id, tokens, mask): words and marks with a flag for each.

    The mask comes from the turns, not from the rendered text, so a text that holds a mark can't mislead it: a scored
    speaker's words and end mark count, the label doesn't, and neither do the marks around the conversation.
    """

    def piece(m: Column) -> Column:
        words = tx.word_array(m["content"])
        on = (m["speaker"] == scored_speaker).cast("int")
        head = F.array(F.struct(F.lit("<|turn|>").alias("token"), F.lit(0).alias("on")), F.struct(F.concat(m["speaker"], F.lit(":")).alias("token"), F.lit(0).alias("on")))
        return F.concat(head, F.transform(words, lambda w: F.struct(w.alias("token"), on.alias("on"))), F.array(F.struct(F.lit("<|end|>").alias("token"), on.alias("on"))))

    edge = lambda t: F.array(F.struct(F.lit(t).alias("token"), F.lit(0).alias("on")))
    cells = F.concat(edge("<s>"), edge("<|conv|>"), F.flatten(F.transform("messages", piece)), edge("</s>"))
    return messages.select("conv_id", cells.alias("cells")).select("conv_id", F.transform("cells", lambda c: c["token"]).alias("tokens"), F.transform("cells", lambda c: c["on"]).alias("mask"))


#: Letters of options and the cue after which a model gives one, in the benchmark's language.
LETTERS = ["\u0623", "\u0628", "\u062c", "\u062f", "\u0647"]
CUE = "\n\u0627\u0644\u0625\u062c\u0627\u0628\u0629:"


def choice_prompt(question: Column, context: Column, options: Column, order: Column) -> Column:
    """A question as an instruction, behind its context on a line of its own if there is one, then the options in the given order with their letters, then the cue."""
    asked = F.concat(F.coalesce(F.concat(F.nullif(context, F.lit("")), F.lit("\n")), F.lit("")), question)
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(order, lambda o, i: F.concat(F.get(letters, i), F.lit(" "), F.get(options, o)))
    return F.concat(F.lit("[inst] "), asked, F.lit(" [/inst]\n"), F.array_join(lines, "\n"), F.lit(CUE))


def gold_place(answer: Column, order: Column) -> Column:
    """Where the option that the answer's letter (a, b, ...) names stands in the order, from 0; -1 if it isn't there."""
    return (F.array_position(order, (F.ascii(F.lower(tx.strip(answer))) - 97).cast("int")) - 1).cast("long")


def prompt_labels(prompt: Column, answer: Column, end: int, length: int = 1024, ignored: int = -100) -> Column:
    """Labels of an instruction example: the prompt's positions are ignored, the answer and the end are scored, all cut to length."""
    return F.slice(F.concat(F.array_repeat(F.lit(ignored), F.size(prompt)), answer, F.array(F.lit(end))), 1, length)


def padded(ids: Column, pad: int, length: int = 1024) -> Column:
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def shifted(ids: Column, begin: int, end: int) -> tuple[Column, Column]:
    """Inputs that begin with a mark, and labels that finish with one."""
    return F.concat(F.array(F.lit(begin)), ids), F.concat(ids, F.array(F.lit(end)))
