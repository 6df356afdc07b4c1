"""HTML to plain text with the standard library's parser, for markup that patterns cannot follow: tags inside
attribute values, nested or unclosed links, character references without semicolon."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions.html import BLANKS, CLOSE, MARKS, OPEN, respaced

_MARK = {name: mark for mark, names in MARKS.items() for name in names}
_HIDDEN = {"head", "script", "style"}


def _escaped(text: str) -> str:
    return re.sub(r"([\\\[\]()])", r"\\\1", text)


class _Marked(HTMLParser):
    """Collects visible text with marks for tags and targets behind links."""

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self._hidden = 0
        self._links: list[str] = []  # what closes each open link
        self._address: str | None = None  # of a link that has shown nothing yet

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self._hidden += 1
        elif tag == "body":
            self._hidden = 0  # a head that was never closed
        elif tag == "a":
            self._open_link(dict(attrs))
        else:
            self._write(_MARK.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "a":
            self._close_link()
        else:
            self._write(_MARK.get("/" + tag, ""))

    def handle_data(self, data: str) -> None:
        if data and data == self._address and re.match("[a-zA-Z+]+://", data):
            # The bracket was written already; the address stands for itself.
            self.out[-1], self._links[-1] = OPEN, CLOSE
        self._write(re.sub(BLANKS, " ", data))

    def close(self) -> None:
        super().close()
        while self._links:
            self._close_link()

    def _open_link(self, attrs: dict) -> None:
        target, title = attrs.get("href"), attrs.get("title") or ""
        if target is None or target.startswith("#") or self._hidden:
            self._links.append("")
            self._write("")
            return
        shown = f' "{_escaped(title)}"' if title.strip() else ""
        self._links.append(f"]({_escaped(target)}{shown})")
        self._write("[")
        self._address = target

    def _close_link(self) -> None:
        if self._links:
            self._write(self._links.pop())

    def _write(self, text: str) -> None:
        self._address = None
        if not self._hidden:
            self.out.append(text)


def _marked(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Marked()
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


def parsed_html_to_text(c: Column) -> Column:
    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(_marked)

    return respaced(parse(c))
