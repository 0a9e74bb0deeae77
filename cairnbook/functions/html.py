"""HTML pages to markdown, one Arrow batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


_SILENT = {"script", "style", "noscript", "template", "svg"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul",
          "ol", "table", "tr", "blockquote", "pre", "form", "figure", "dl", "dt", "dd"}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.silent = 0
        self.in_title = False
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in ("title", "body"):
            self.in_title = tag == "title"
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href") or "")
            self.parts.append("[")
        elif tag in ("td", "th"):
            self.parts.append(" | ")
        elif tag in _BLOCK:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")
        elif tag == "a" and self.hrefs:
            self.parts.append(f"]({self.hrefs.pop()})")
        elif tag in _BLOCK or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.parts.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> tuple[str, str]:
    """``(title, markdown)`` of one page; malformed markup is read as far as it goes."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [line.strip() for line in "".join(parser.parts).split("\n")]
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return " ".join("".join(parser.title).split()), body


def html_to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html",
                     parts: int | None = None) -> DataFrame:
    """``(key, title, markdown)`` of every page, as one map-only stage of ``parts`` tasks if asked for."""
    key_type = pages.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [to_markdown(h) for h in batch[html]]
            yield pd.DataFrame({key: batch[key], "title": [m[0] for m in made],
                                "markdown": [m[1] for m in made]})

    slim = pages.select(key, html)
    return (slim if parts is None else slim.repartition(parts)).mapInPandas(
        convert, f"{key} {key_type}, title string, markdown string")
