"""Delimited strings with quotes and escapes."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DelimitedStringError(ValueError):
    """A quote without its end."""


@lru_cache(maxsize=64)
def _item(delimiters: str, quotes: str) -> re.Pattern:
    d, q = re.escape(delimiters), re.escape(quotes)
    # a quote ends at the next one of its kind that no backslash stands before
    quoted = "|".join(rf"{c}(?:[^{c}]|(?<=\\){c})*(?<!\\){c}" for c in map(re.escape, quotes))
    return re.compile(rf"(?P<escape>\\[{d}])|(?P<mark>\\[{q}])|(?P<quoted>{quoted})|(?P<open>[{q}])|(?P<end>[{d}])|(?P<plain>(?s:.))")


def parse(text: str | None, delimiters: str = ";", quotes: str = '"') -> list[str]:
    """The values of ``text``: split at ``delimiters`` outside quotes, trimmed, empty ones left out.

    Quotes protect what they hold and stay part of the value, as does a backslash before a
    quote. A backslash before a delimiter outside of quotes is dropped and the delimiter kept.
    """
    values = [""]
    for m in _item(delimiters, quotes).finditer(text or ""):
        if m.lastgroup == "open":
            raise DelimitedStringError(f"Closing quote missing in delimited string: {text}")
        if m.lastgroup == "end":
            values.append("")
        else:
            values[-1] += m[0][1:] if m.lastgroup == "escape" else m[0]
    return [v for v in map(str.strip, values) if v]


def unquote(text: str, quotes: str = '"') -> str:
    """``text`` without the quotes around it, and escaped quotes of that kind inside restored; as it is if not wholly quoted."""
    if len(text) < 2 or text[0] != text[-1] or text[0] not in quotes or text[-2] == "\\":
        return text
    return text.replace("\\" + text[0], text[0])[1:-1]


def split_delimited(col, delimiter: str = ";"):
    """Column: the values of a delimited string; plain strings stay in the JVM, others go through the parser."""
    special = F.regexp_like(col, F.lit(r"[\"'\\]"))
    plain = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "[" + delimiter + "]"), lambda v: F.trim(v)), lambda v: v != "")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def quoted(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else parse(v, delimiter))

    return F.when(special, quoted(F.when(special, col))).otherwise(plain)


def unquoted(col):
    """Column: ``col`` without the double quotes around it."""
    quoted = F.regexp_like(col, F.lit(r'(?s)^".*(?<!\\)"$')) & (F.length(col) >= 2)
    return F.when(quoted, F.replace(F.substring(col, F.lit(2), F.greatest(F.length(col) - 2, F.lit(0))), F.lit('\\"'), F.lit('"'))).otherwise(col)
