"""Chat prompts: message lists and their rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import col, fill_template
from corpusmill.plans.prefix import dense_positions

# Markers of the plain chat layout.
USER_MARK = "<User>: "
ASSISTANT_MARK = " <Assistant>: "
GENERATION_MARK = " <Assistant>:"


def to_messages(
    instruction: Column | str, text: Column | str, system: str, template: str = "{instruction}\n\n{text}"
) -> Column:
    """Message list of one example: a system turn, then a user turn with instruction and text."""
    head, _, tail = template.partition("{instruction}")
    user = F.concat(F.lit(head), F.coalesce(col(instruction), F.lit("")), fill_template(tail, "text", text))
    return F.array(message("system", F.lit(system)), message("user", user))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def turn_text(role: Column, content: Column, is_first: Column, eos: str) -> Column:
    """Rendered text of one turn.

    A system turn opens the user turn that follows; the user marker is written only
    where the conversation starts with a user turn. NULL content is blank, its markers stay.
    """
    content = F.coalesce(content, F.lit(""))
    return (
        F.when(role == "system", F.concat(F.lit(USER_MARK), content, F.lit("\n\n")))
        .when(role == "user", F.concat(F.when(is_first, USER_MARK).otherwise(""), content))
        .when(role == "assistant", F.concat(F.lit(ASSISTANT_MARK), content, F.lit(eos)))
        .otherwise(F.lit(""))
    )


def render_messages(messages: Column | str, eos: str, add_generation_prompt: bool = False) -> Column:
    """Prompt text of a message list."""
    turns = F.transform(
        col(messages), lambda m, i: turn_text(m["role"], m["content"], i == F.lit(0), eos)
    )
    return F.concat(F.array_join(turns, ""), F.lit(GENERATION_MARK if add_generation_prompt else ""))


def render_chat(
    turns: DataFrame,
    eos: str,
    add_generation_prompt: bool = False,
    id_col: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """Prompt text of each turn at its place in the conversation, from one row per turn.

    The prompt of a conversation is the concatenation of its turns; turn numbers need only
    order them. Conversations have one shape at any length. The last turn carries the
    generation marker.
    """
    placed = dense_positions(turns.select(id_col, turn, "role", "text"), [id_col], [turn, "role", "text"])
    sizes = turns.groupBy(id_col).agg(F.count("*").alias("n_turns"))
    text = turn_text(F.col("role"), F.col("text"), F.col("position") == 0, eos)
    last = F.col("position") == F.col("n_turns") - 1
    closing = F.when(last, F.lit(GENERATION_MARK if add_generation_prompt else "")).otherwise("")
    return placed.join(sizes, id_col).select(
        id_col, "position", "n_turns", F.concat(text, closing).alias("prompt")
    )
