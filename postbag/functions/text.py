"""Column functions on single strings: trimming, lists, addresses, slugs, headers, dates."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ELLIPSIS = "…"
SEPARATOR = "\n---\n"


# Letters, in lower case, that a slug writes with other letters.
SPELLED = {
    # Latin
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "ng",
    "ŧ": "t", "ə": "e", "ɛ": "e", "ɔ": "o", "ƒ": "f",
    # Greek
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l",
    "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph",
    "χ": "kh", "ψ": "ps", "ω": "o",
    # Cyrillic
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ё": "io",
    "є": "ie", "і": "i", "ї": "yi", "ґ": "g", "ђ": "dj", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "ch", "џ": "dzh",
}


@cache
def letter_table() -> dict[str, str]:
    """How characters beyond ASCII are written in a slug: their compatibility decomposition without marks, letters
    spelled as ``SPELLED`` says. Characters that this doesn't bring to ASCII letters and digits aren't in it."""
    table = {}
    for code in (*range(0x80, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0)):
        char = chr(code)
        if char in SPELLED or char != char.lower():
            continue
        parts = [c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c)]
        spelled = "".join(SPELLED.get(c, c if c.isascii() else "-") for c in parts)
        if any(c.isalnum() for c in spelled):
            table[char] = spelled
    return table | SPELLED


def _spelled(c: Column) -> Column:
    """Characters beyond ASCII in ASCII letters, where the table has them."""
    table = letter_table()
    single = {char: to for char, to in table.items() if len(to) == 1}
    folded = F.translate(c, "".join(single), "".join(single.values()))
    longer = F.from_json(F.lit(json.dumps({char: to for char, to in table.items() if len(to) != 1})), "map<string,string>")

    def one(char: Column) -> Column:
        return F.when(char < "\x80", char).otherwise(F.coalesce(F.try_element_at(longer, char), char))

    # What a single letter stands for is done; few texts have more.
    each = lambda text: F.array_join(F.transform(F.split(text, ""), one), "")
    return let(folded, lambda text: F.when(text.rlike("[^\\x00-\\x7F]"), each(text)).otherwise(text))


def let(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then(c)`` with ``c`` computed once, however often ``then`` uses it.

    A column that is named several times is copied into the plan each time; a chain of such steps grows
    exponentially, and costly steps run again and again.
    """
    return F.get(F.transform(F.array(c), then), F.lit(0))


def trim(c: Column) -> Column:
    """Cut white space (in the Unicode sense) from both ends."""
    return F.trim(c, F.lit(WHITESPACE))


def csv_list(c: Column) -> Column:
    """``" one , two,"`` becomes ``[one, two]``; a list with nothing in it is NULL."""
    items = F.filter(F.transform(F.split(c, ","), trim), lambda x: x != "")
    return let(items, lambda x: F.when(F.size(x) > 0, x))


def email_address(sender: Column) -> Column:
    """The address inside ``<...>``; without one the sender as it is, trimmed if it holds an ``@``."""
    return (
        F.when(sender.rlike("<[^>]+>"), F.regexp_extract(sender, "<([^>]+)>", 1))
        .when(sender.contains("@"), trim(sender))
        .otherwise(sender)
    )


def truncate(c: Column, length: int = 30) -> Column:
    """At most ``length`` characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(c) <= length, c).otherwise(
        F.concat(F.left(c, F.lit(length - 1)), F.lit(ELLIPSIS))
    )


def slug(c: Column, length: int | None = None) -> Column:
    """Lower-case ASCII words joined by dashes, for use in file names.

    Latin, Greek and Cyrillic letters, digits and letters in other forms (wide, raised, circled, joined) are spelled
    out. Other scripts have no spelling here and count as no letters: Armenian, Georgian, Hebrew, Arabic, those of
    India and South-East Asia, Ethiopic, Chinese, Japanese and Korean among them.
    """
    folded = _spelled(F.lower(c))
    # "1,000" is one word; twice, because the matches of "1,2,3" overlap.
    for _ in range(2):
        folded = F.regexp_replace(folded, "([0-9]),([0-9])", "$1$2")
    dashed = F.trim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-"))
    return dashed if length is None else F.trim(F.left(dashed, F.lit(length)), F.lit("-"))


def offset_text(offset_min: Column) -> Column:
    """Minutes east of UTC as ``+hh:mm``; nothing for a date without offset."""
    sign = F.when(offset_min < 0, "-").otherwise("+")
    size = F.abs(offset_min)
    return F.when(
        offset_min.isNotNull(),
        F.format_string("%s%02d:%02d", sign, F.floor(size / 60).cast("int"), (size % 60).cast("int")),
    ).otherwise("")


def _with_fraction(date_local: Column, pattern: str) -> Column:
    """Microseconds are shown only when there are any."""
    fraction = F.date_format(date_local, "SSSSSS")
    whole = F.date_format(date_local, pattern)
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def iso_date(date_local: Column, offset_min: Column) -> Column:
    """ISO 8601 with the offset of the message's own Date header."""
    return F.concat(_with_fraction(date_local, "yyyy-MM-dd'T'HH:mm:ss"), offset_text(offset_min))


def header_date(date_local: Column, offset_min: Column) -> Column:
    """The same moment with a blank between day and time, as message blocks show it."""
    return F.concat(_with_fraction(date_local, "yyyy-MM-dd HH:mm:ss"), offset_text(offset_min))


def header_line(date_local: Column, sender: Column, subject: Column, max_subject: int = 30) -> Column:
    """``2024-01-15 10:30 | al@example.com | Subject`` for reports."""
    return F.concat_ws(
        " | ",
        F.date_format(date_local, "yyyy-MM-dd HH:mm"),
        email_address(sender),
        truncate(subject, max_subject),
    )


def batch_header(emails: Column, shown: int = 3, max_subject: int = 25) -> Column:
    """Header lines of the first messages of a batch and how many more there are.

    ``emails`` is an array of structs with ``date_local``, ``sender`` and ``subject``.
    """
    lines = F.transform(
        F.slice(emails, 1, shown),
        lambda e: header_line(e["date_local"], e["sender"], e["subject"], max_subject),
    )
    more = F.concat(F.lit("  ... (+"), (F.size(emails) - shown).cast("string"), F.lit(" more emails)"))
    listed = F.when(F.size(emails) > shown, F.concat(lines, F.array(more))).otherwise(lines)
    return F.when(F.size(emails) > 0, F.array_join(listed, "\n")).otherwise("Batch: (empty)")


def output_key(date_local: Column, sender: Column, subject: Column) -> Column:
    """File name of a message's record: ``yyMMdd-HHmmss-sender-subject.jsonl``; a missing part is empty."""
    local_part = F.substring_index(sender, "@", 1)
    return F.concat(
        F.coalesce(F.date_format(date_local, "yyMMdd-HHmmss"), F.lit("")),
        F.lit("-"),
        F.coalesce(slug(local_part, 20), F.lit("")),
        F.lit("-"),
        F.coalesce(slug(subject, 30), F.lit("")),
        F.lit(".jsonl"),
    )


def message_block(sender: Column, date_local: Column, offset_min: Column, subject: Column, body: Column) -> Column:
    """A message with its From/Date/Subject lines, as transcripts and thread mode show it."""
    blank = F.lit("")
    return F.concat(
        F.lit("From: "),
        F.coalesce(sender, blank),
        F.lit("\nDate: "),
        F.coalesce(header_date(date_local, offset_min), blank),
        F.lit("\nSubject: "),
        F.coalesce(subject, blank),
        F.lit("\n\n"),
        F.coalesce(body, blank),
    )
