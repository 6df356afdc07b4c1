"""Cutting texts to the size of a model's context, and measuring them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions.text import trim

# Room kept for prompt and answer, and the least that is left for content.
RESERVED = 1000
SMALLEST = 100
WORD = "[A-Za-z0-9_]+"


def chunk_size(max_context: int) -> int:
    """Characters of content that fit into a context."""
    return max(max_context - RESERVED, SMALLEST)


def chunk_pattern(size: int) -> str:
    """One chunk: as much as fits up to the strongest boundary there is.

    The alternatives are tried in this order: end of text or of a paragraph, end of a line, of a sentence,
    of a word, and last a cut inside a word. Each takes the longest stretch that ends at its boundary, and
    swallows the blanks behind it, which do not count.
    """
    blanks, spaces = "[ \\t\\r\\f]*", "[ \\t\\r\\f\\n]"
    return (
        "(?s)"
        f".{{1,{size}}}(?:{blanks}\\n{blanks}\\n{spaces}*|{spaces}*\\z)"
        f"|.{{1,{size}}}{blanks}\\n{spaces}*"
        f"|.{{0,{size - 1}}}[.!?]{spaces}+"
        f"|.{{1,{size}}}{spaces}+"
        f"|.{{1,{size}}}"
    )


def _short_runs(c: Column, size: int) -> Column:
    """Runs of more than ``size`` blanks cut down to that many.

    No chunk reaches over such a run, so all that counts of it is whether it holds a line end, two or none. The
    pattern of a chunk would look over the whole run from each place where a chunk may end.
    """
    start = f"(?<![ \\t\\r\\f\\n])(?=[ \\t\\r\\f\\n]{{{size + 1},}}+)"
    blanks = "[ \\t\\r\\f]*+"
    for run, end in (
        (f"{blanks}\\n{blanks}\\n[ \\t\\r\\f\\n]*+", "\n\n"),
        (f"{blanks}\\n{blanks}", "\n"),
        (f"{blanks}", ""),
    ):
        c = F.regexp_replace(c, start + run, end + " " * (size - len(end)))
    return c


def chunks(c: Column, size: int) -> Column:
    """Array of chunks of at most ``size`` characters; no chunk for an empty text.

    One regular expression walks each text once, inside the JVM.
    """
    long_run = c.rlike(f"(?<![ \\t\\r\\f\\n])[ \\t\\r\\f\\n]{{{size + 1},}}+")
    text = F.when(long_run, _short_runs(c, size)).otherwise(c)
    pieces = F.regexp_extract_all(text, F.lit(chunk_pattern(size)), F.lit(0))
    return F.filter(F.transform(pieces, trim), lambda x: x != "")


def fixed_chunks(c: Column, size: int) -> Column:
    """Chunks of exactly ``size`` characters (the last may be shorter), wherever the cut falls."""
    count = F.ceil(F.length(c) / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(c, i * size + 1, F.lit(size)))


def token_estimate(c: Column) -> Column:
    """Words and single marks, counted without a model's tables.

    Every word shrinks to one letter and blanks go; what is left is as long as there are tokens.
    """
    left = F.regexp_replace(F.regexp_replace(c, WORD, "w"), "\\s+", "")
    return F.coalesce(F.length(left), F.lit(0)).cast("long")


def token_count(make_encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Exact token counts with a model's own tokenizer, built once per task by ``make_encoder``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield texts.map(lambda text: len(encode(text)) if text else 0).astype("int64")

    return count
