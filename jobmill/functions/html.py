"""HTML to plain text with light markup."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("p", "div", "ul", "ol", "tr", "table"):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(" ".join(data.split()) if data.strip() else " " if data else "")
            if data and data[-1].isspace() and data.strip():
                self.out.append(" ")
            if data and data[0].isspace() and data.strip():
                self.out.insert(len(self.out) - (2 if data[-1].isspace() else 1), " ")


def to_text(raw: str | None) -> str | None:
    """Headings as #, items as *, bold as **, paragraphs apart; HTML escaped as a whole is unescaped first; null and
    empty give null."""
    if not raw:
        return None
    text = raw if "<" in raw else html.unescape(raw)
    writer = _Writer()
    writer.feed(text)
    writer.close()
    lines = [" ".join(line.split()) for line in "".join(writer.out).split("\n")]
    kept: list[str] = []
    for line in lines:
        if line not in ("*", "**", "****") and (line or (kept and kept[-1])):
            kept.append(line)
    return "\n".join(kept).strip() or None


@F.pandas_udf(StringType())
def html_text(raw: pd.Series) -> pd.Series:
    return raw.map(to_text, na_action="ignore")
