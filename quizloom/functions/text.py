"""Prompt, chat and length columns. All are built-in expressions, so they also run on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that the trained models expect.
SYSTEM_MESSAGE = "지문을 읽고 질문의 답을 구하세요."
PARAGRAPH_HEAD = "지문:\n"
QUESTION_HEAD = "\n\n질문:\n"
PLUS_HEAD = "\n\n<보기>:\n"
CHOICES_HEAD = "\n\n선택지:\n"
ANSWER_HEAD = "\n\n1, 2, 3, 4, 5 중에 하나를 정답으로 고르세요.\n정답:"
TURN_START, TURN_END = "<start_of_turn>", "<end_of_turn>"
RESPONSE = "<start_of_turn>model"

MESSAGES = "array<struct<role:string,content:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def present(c: Column) -> Column:
    """Neither null nor empty; white space counts as text."""
    return F.coalesce(c, F.lit("")) != ""


def full_question(question: Column, plus: Column) -> Column:
    return F.when(present(plus), F.concat_ws(" ", question, plus)).otherwise(question)


def numbered_choices(choices: Column) -> Column:
    """'1 - a', '2 - b'... on lines; a null choice keeps its number."""
    lines = F.transform(choices, lambda c, i: F.concat((i + 1).cast("string"), F.lit(" - "), _text(c)))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def prompt(paragraph: Column, question: Column, choices: Column, plus: Column) -> Column:
    """The user's message. Inserted texts are never read as patterns or formats."""
    block = F.when(present(plus), F.concat(F.lit(PLUS_HEAD), plus)).otherwise("")
    return F.concat(F.lit(PARAGRAPH_HEAD), _text(paragraph), F.lit(QUESTION_HEAD), _text(question), block, F.lit(CHOICES_HEAD), numbered_choices(choices), F.lit(ANSWER_HEAD))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def inference_messages(user: Column, system: str = SYSTEM_MESSAGE) -> Column:
    return F.array(message("system", F.lit(system)), message("user", user))


def training_messages(user: Column, answer: Column, system: str = SYSTEM_MESSAGE) -> Column:
    return F.array(message("system", F.lit(system)), message("user", user), message("assistant", _text(answer)))


def turn_template(messages: Column, add_generation_prompt: bool = False) -> Column:
    """Turn-tagged chat text. A leading system message stands alone; a user's turn opens the model's,
    so add_generation_prompt changes nothing; other roles say nothing."""
    first = F.try_element_at(messages, F.lit(1))
    lead = F.when(first["role"] == "system", _text(first["content"])).otherwise("")
    turn = lambda m: (
        F.when(m["role"] == "user", F.concat(F.lit(f"{TURN_START}user\n"), _text(m["content"]), F.lit(f"{TURN_END}\n{TURN_START}model\n")))
        .when(m["role"] == "assistant", F.concat(_text(m["content"]), F.lit(f"{TURN_END}\n")))
        .otherwise("")
    )
    return F.concat(lead, F.array_join(F.transform(messages, turn), ""))


TEMPLATES: dict[str, Callable[..., Column]] = {"turns": turn_template}


def choose_template(template: Callable[..., Column] | None = None, model_name: str | None = None, own: Callable[..., Column] | None = None) -> Callable[..., Column]:
    """An explicit template, else by the model's name, else the tokenizer's own, else turns."""
    if template is not None:
        return template
    if model_name and "gemma" in model_name.lower():
        return turn_template
    return own or turn_template
