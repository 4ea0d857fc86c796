"""Python literals in columns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PROBLEM = "struct<question:string,choices:array<string>,answer:int,question_plus:string>"
#: Literals that mean the same as JSON with either kind of quotes: one flat dict of strings without
#: escapes or control characters, whole and decimal numbers, and lists. No names, tuples, spare commas.
FLAT = r"""^\{(?:[ :,\[\]]|"[^"\\\x00-\x1f]*+"|'[^'\\\x00-\x1f]*+'|-?+(?:0|[1-9][0-9]{0,17}+)(?:\.[0-9]{1,15}+)?+(?![\w.]))*+\}$"""


def plain(value: object) -> str:
    """What JSON has no form for, as text; a set's members in order, which is another in each process otherwise."""
    return "{" + ", ".join(sorted(map(repr, value))) + "}" if isinstance(value, set) and value else repr(value)


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def _evaluated(texts: pd.Series) -> pd.DataFrame:
    """Each literal as JSON, or the name of the error that reading it raised; null stays null."""
    rows = []
    for text in texts:
        if text is None:
            rows.append((None, None))
            continue
        try:
            rows.append((json.dumps(ast.literal_eval(text), ensure_ascii=False, default=plain), None))
        except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError) as e:
            rows.append((None, type(e).__name__))
    return pd.DataFrame(rows, columns=["json", "error"])


def literal_json(text: str | Column) -> Column:
    """A struct of json, each literal as JSON, and error, the name of what reading it raised; null stays null.

    Literals that are JSON, too, are read by Spark. A literal's grammar is wider (None, tuples,
    escapes): what Spark can't read goes to Python, in Arrow batches that hold nulls for all else.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = F.when(text.rlike(FLAT), F.get_json_object(text, "$"))
    read = _evaluated(F.when(plain.isNull(), text))
    return F.struct(F.coalesce(plain, read["json"]).alias("json"), read["error"].alias("error"))


def parse_json(text: Column, schema: str) -> Column:
    """For columns known to hold clean JSON: no Python."""
    return F.from_json(text, schema)


def field_error(json: Column, parsed: Column, required: list[str], fields: list[str]) -> Column:
    """KeyError where a required field is missing, TypeError where a field's value isn't of its type or
    the whole isn't a dict; a field that holds None is neither."""
    keys = F.json_object_keys(json)
    missing, unread = F.lit(False), F.lit(False)
    for name in required:
        missing |= ~F.array_contains(keys, name)
    for name in fields:
        unread |= F.get_json_object(json, f"$.{name}").isNotNull() & parsed[name].isNull()
    return F.when(json.isNotNull(), F.when(keys.isNull(), "TypeError").when(missing, "KeyError").when(unread, "TypeError"))
