"""Token, label and logit arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def attention_mask(ids: Column) -> Column:
    """A 1 for each id."""
    return F.transform(ids, lambda _: F.lit(1))


def last_match(ids: Column, template: Column, size: int) -> Column:
    """1-based start of the last occurrence of template; null if there is none."""
    starts = F.when(F.size(ids) >= size, F.sequence(F.lit(1), F.greatest(F.size(ids) - (size - 1), F.lit(1))))
    return F.array_max(F.filter(starts, lambda i: F.slice(ids, i, size) == template))


def completion_mask(ids: Column, template: Column, size: int, ignored: Column) -> Column:
    """Labels: ids after the last template; everything else, or all without a match, is ignored."""
    end = F.coalesce(last_match(ids, template, size) + (size - 1), F.size(ids))
    return F.concat(F.array_repeat(ignored, end), F.slice(ids, end + 1, F.size(ids)))


def gather(logits: Column, ids: Column) -> Column:
    """The logits of some vocabulary ids (from 0; an unknown id, null, is 0); null beyond the vocabulary."""
    return F.transform(ids, lambda i: F.try_element_at(logits, F.coalesce(i, F.lit(0)) + 1))


def answer_logits(sequence: Column, ids: Column, answer_offset: int = -2) -> Column:
    """The logits of some vocabulary ids at one position of a sequence of logits, from its end if negative:
    before the end of the sequence stands the answer. Null where the sequence is shorter."""
    return gather(F.try_element_at(sequence, F.lit(answer_offset)), ids)


def first_choices(logits: Column, n: Column) -> Column:
    return F.slice(logits, 1, n)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """0-based; the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def answer_text(index: Column, n: Column) -> Column:
    """'1'.. for an index; null where the number of choices isn't 1 to 5."""
    return F.when(n.between(1, 5), (index + 1).cast("string"))


def rejection(index: Column, n: Column) -> Column:
    """Why answer_text is null; null where it isn't."""
    return F.when(n.isNull() | (n < 1), "no choices").when(n > 5, "more than 5 choices").when(index.isNull(), "no scores")


def class_of(text: Column, default: int | None = 0) -> Column:
    """'1'..'5' to 0..4; other texts get the default."""
    known = F.create_map(*(F.lit(x) for i in range(5) for x in (str(i + 1), i)))
    found = F.try_element_at(known, text)
    return found if default is None else F.coalesce(found, F.lit(default))
