"""Which answers carry no information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions.text import let, trim

# Answers that match one of these say that nothing was found.
EMPTY_ANSWERS = (
    r"^\s*$",
    r"^\s*\(.*no.*found.*\)\s*$",
    r"^\s*\[.*no.*found.*\]\s*$",
    r"^.*did not find any.*$",
    r"^.*no.*orders.*found.*$",
    r"^.*no.*serial.*numbers.*$",
    r"^.*no.*license.*keys.*$",
    r"^.*no.*relevant.*$",
    r"^.*nothing.*found.*$",
    r"^.*none.*found.*$",
    r"^.*could not find.*$",
    r"^.*unable to find.*$",
    r"^\s*n/?a\s*$",
    r"^\s*-+\s*$",
    r"^\s*none\s*$",
)
SHORTEST_ANSWER = 10


def _in_order(text: Column, words: list[str], start: int | Column = 1) -> Column:
    """The words occur one after the other. Each is taken where it first comes, so one walk decides, where a
    regular expression would try all combinations."""
    word, *others = words
    at = F.position(F.lit(word), text, F.lit(start) if isinstance(start, int) else start)
    if not others:
        return at > 0
    return let(at, lambda p: (p > 0) & _in_order(text, others, p + len(word)))


def _says(text: Column, pattern: str) -> Column:
    """The pattern matches. Those that only ask for words in order need no regular expression."""
    middle = pattern.removeprefix("^.*").removesuffix(".*$")
    if len(middle) == len(pattern) - 6:
        return _in_order(text, middle.split(".*"))
    return text.rlike(f"(?is){pattern}")


def is_empty_answer(content: Column) -> Column:
    """True for a missing, very short or "nothing found" answer."""
    return let(
        F.lower(trim(F.coalesce(content, F.lit("")))),
        lambda said: reduce(
            lambda a, b: a | b,
            [_says(said, pattern) for pattern in EMPTY_ANSWERS],
            F.length(said) < SHORTEST_ANSWER,
        ),
    )
