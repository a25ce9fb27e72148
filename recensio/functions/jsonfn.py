"""JSON helpers for model answers."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from recensio.functions.text import SPACE


# Fixed value: the fences around a model answer.
FENCE = "```json\n?|```"


def strip_fences(content: Column) -> Column:
    """Remove an opening ```json fence (with its newline) and every bare
    ``` fence, then trim surrounding whitespace."""
    t = F.regexp_replace(content, FENCE, "")
    return F.regexp_replace(t, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def _valid(s: str | None) -> bool:
    if s is None:
        return False
    try:
        value = json.loads(s)
    except (ValueError, RecursionError):
        return False
    # An answer is searched for its keys: an object, a list or a string can
    # be, a number, a truth value or null cannot and counts as invalid.
    return isinstance(value, (dict, list, str))


def _valid_series(s: pd.Series) -> pd.Series:
    return s.map(_valid).astype(bool)


@functools.cache
def _valid_udf():
    return pandas_udf(_valid_series, "boolean")


def is_valid_json(col: Column) -> Column:
    """Strict parse check (text after the value is an error).  Spark's own
    JSON readers accept trailing text, so this one check runs in Python,
    Arrow-batched, on the (few) answer rows only."""
    return _valid_udf()(col)
