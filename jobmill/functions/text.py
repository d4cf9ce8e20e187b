"""Column expressions and Arrow functions for text."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Java: white space in the Unicode sense, no-break spaces included.
SPACE = r"(?U)\s+"


def squeeze(c: Column | str) -> Column:
    """Trimmed, each run of white space (no-break spaces included) made one blank; null stays null."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, SPACE, " "))


def posting_id(c: Column | str) -> Column:
    """A list row's id as a string, trimmed and in lower case; null stays null."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def blank_to_null(c: Column) -> Column:
    return F.when(squeeze(c) != "", c)


_BLOCK = re.compile(r"<\s*/?\s*(?:li|ul|ol|p|div|br)\b[^>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^>]*>", re.S)
_ESCAPED_TAG = re.compile(r"&lt;\s*/?\s*[a-zA-Z][^&<>]*?/?\s*&gt;", re.I)


def html_item_list(content: str | None) -> list[str] | None:
    """The runs of text between block-level tags, in reading order; inline tags removed, escapes resolved, squeezed.

    Content that was escaped as a whole (`&lt;li&gt;`) is first unescaped once. Null gives null, text without
    tags one item, empty runs none.
    """
    if content is None:
        return None
    if not _TAG.search(content) and _ESCAPED_TAG.search(content):
        content = html.unescape(content)
    items = (" ".join(html.unescape(_TAG.sub("", run)).split()) for run in _BLOCK.split(content))
    return [x for x in items if x]


def plain_item(text: str | None) -> str | None:
    """One element of a content array: escapes resolved, tags removed, squeezed; null or empty gives null."""
    return None if text is None else " ".join(html_item_list(text)) or None


@F.pandas_udf(ArrayType(StringType()))
def html_items(content: pd.Series) -> pd.Series:
    memo: dict = {}
    return content.map(lambda c: memo[c] if c in memo else memo.setdefault(c, html_item_list(c)), na_action="ignore")


@F.pandas_udf(StringType())
def html_item(content: pd.Series) -> pd.Series:
    return content.map(plain_item, na_action="ignore")


#: Otherwise a filter on the result runs the function a second time.
html_item = html_item.asNondeterministic()
