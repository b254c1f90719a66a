"""Chat messages: ``ARRAY<STRUCT<role, content>>`` columns and their rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: marks of the chat template --------------------------------------------------
BEGIN_OF_TEXT = "<|begin_of_text|>"
END_OF_TURN = "<|eot_id|>"
SYSTEM_HEADER = "<|start_header_id|>system<|end_header_id|>\n"
USER_HEADER = "<|start_header_id|>user<|end_header_id|>\n"
USER_HEADER_MISSPELT = "<|start_header_id|>user<|end_header_id|}\n"
ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>\n"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_prompt(system: str, user: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", user))


def first_content(messages: Column) -> Column:
    """Content of a conversational completion: its first message."""
    return F.get(messages, F.lit(0))["content"]


def last_content(messages: Column) -> Column:
    """Content of the last message of a prompt: the question."""
    return F.get(messages, F.size(messages) - 1)["content"]


def render_message(role: Column, content: Column, compat: bool = False) -> Column:
    """One message in template form; other roles render as the empty string.

    ``compat`` keeps the published template's misspelt user header.
    """
    user_header = USER_HEADER_MISSPELT if compat else USER_HEADER
    header = (
        F.when(role == "system", F.lit(BEGIN_OF_TEXT + SYSTEM_HEADER))
        .when(role == "user", F.lit(user_header))
        .when(role == "assistant", F.lit(ASSISTANT_HEADER))
    )
    return F.coalesce(F.concat(header, content, F.lit(END_OF_TURN)), F.lit(""))


def render_chat(
    messages: Column, add_generation_prompt: bool = True, compat: bool = False
) -> Column:
    """A message list as one text, row by row: no grouping, no shuffle."""
    pieces = F.transform(messages, lambda m: render_message(m["role"], m["content"], compat))
    text = F.array_join(pieces, "")
    return F.concat(text, F.lit(ASSISTANT_HEADER)) if add_generation_prompt else text
