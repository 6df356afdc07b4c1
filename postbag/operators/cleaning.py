"""From message bodies to clean text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.functions.html import html_to_text
from postbag.functions.html_parsing import parsed_html_to_text
from postbag.functions.replies import newest_reply
from postbag.functions.text import message_block, trim

Convert = Callable[[Column], Column]


def body(text: Column, html: Column, convert: Convert = html_to_text) -> Column:
    """The plain text if there is any, else the HTML as text, else nothing."""
    return (
        F.when(F.length(text) > 0, text)
        .when(F.length(html) > 0, convert(html))
        .otherwise("")
    )


def clean(
    text: Column,
    html: Column,
    languages: Iterable[str] | None = None,
    convert: Convert = html_to_text,
) -> Column:
    """What the sender typed: body without quoted history and signature, trimmed."""
    return trim(newest_reply(body(text, html, convert), languages))


def with_content(
    messages: DataFrame,
    languages: Iterable[str] | None = None,
    headers: bool = False,
    robust_html: bool = False,
) -> DataFrame:
    """Replace the bodies by ``content``; with ``headers`` each message shows From, Date and Subject.

    ``robust_html`` parses the HTML in Python workers, which only pays off for broken markup. The parser is
    given the HTML of those messages alone that have no plain text.
    """
    html = F.col("html")
    if robust_html:
        needed = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, html)
        messages = messages.withColumn("html", parsed_html_to_text(needed))
    content = clean(
        F.col("text"), html, languages, convert=(lambda c: c) if robust_html else html_to_text
    )
    if headers:
        content = message_block(
            F.col("sender"), F.col("date_local"), F.col("date_offset_min"), F.col("subject"), content
        )
    return messages.withColumn("content", content).drop("text", "html")
