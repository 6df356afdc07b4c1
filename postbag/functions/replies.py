"""Quoted history and signatures: keep what the sender of a message typed.

All patterns are free of look-around, so that any regular-expression engine reads them alike. Each is
guarded by a plain substring test, which spares the search on the many bodies that hold no marker.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions.text import let


@dataclass(frozen=True)
class Markers:
    """How mail programs of one language announce quoted text."""

    wrote: str  # last word of the line that introduces a quote
    wrote_line: str
    original: tuple[str, ...]
    sender: str
    details: tuple[str, ...]
    sent_from: tuple[str, ...]


# Reply markers by language.
LANGUAGES = {
    "en": Markers(
        "wrote:",
        r"On [^\n]+(?:\n[^\n]*)?wrote:",
        ("Original Message", "Forwarded message"),
        "From:",
        ("Sent:", "Date:", "To:"),
        ("Sent from my ", "Get Outlook for "),
    ),
    "de": Markers(
        "schrieb",
        r"Am [^\n]+(?:\n[^\n]*)?schrieb[^\n]*:",
        ("Ursprüngliche Nachricht", "Weitergeleitete Nachricht"),
        "Von:",
        ("Gesendet:", "Datum:", "An:"),
        ("Von meinem ", "Gesendet von "),
    ),
    "fr": Markers(
        "écrit",
        r"Le [^\n]+(?:\n[^\n]*)?écrit ?:",
        ("Message d'origine", "Message transféré"),
        "De :",
        ("Envoyé :", "Date :", "À :"),
        ("Envoyé de mon ", "Envoyé depuis "),
    ),
    "es": Markers(
        "escribió",
        r"El [^\n]+(?:\n[^\n]*)?escribió:",
        ("Mensaje original", "Mensaje reenviado"),
        "De:",
        ("Enviado:", "Fecha:", "Para:"),
        ("Enviado desde ",),
    ),
}

SIGNATURE = r"(?s)\n-- ?\n.*\z"
# Up to the last line that is neither blank nor quoted.
UNQUOTED = r"(?s)\A(.*(?:\A|\n)[ \t\r]*[^>\s][^\n]*)"


def markers(languages: Iterable[str] | None) -> list[Markers]:
    names = list(languages or ["en"])
    unknown = [name for name in names if name not in LANGUAGES]
    if unknown:
        raise ValueError(f"no reply markers for: {', '.join(unknown)}")
    return [LANGUAGES[name] for name in names]


def wrote_pattern(m: Markers) -> str:
    return r"(?s)(?:\A|\n+)[ \t]*" + m.wrote_line + r"[ \t\r]*(?:\n.*)?\z"


def original_pattern(m: Markers) -> str:
    return r"(?s)(?:\A|\n+)-{2,} ?(?:" + "|".join(m.original) + r") ?-{2,}.*\z"


def sender_pattern(m: Markers) -> str:
    return r"(?s)\n+\*?" + m.sender + r"[^\n]+\n\*?(?:" + "|".join(m.details) + r")[^\n]+(?:\n.*)?\z"


def sent_from_pattern(m: Markers) -> str:
    return r"(?s)(?:\A|\n)(?:" + "|".join(m.sent_from) + r")[^\n]*\s*\z"


def _cut(c: Column, pattern: str, *words: str) -> Column:
    """Delete what matches, in texts that hold one of the words."""

    def cut(text: Column) -> Column:
        guard = reduce(lambda a, b: a | b, [text.contains(word) for word in words])
        return F.when(guard, F.regexp_replace(text, pattern, "")).otherwise(text)

    return let(c, cut)


def strip_quotes(c: Column, languages: Iterable[str] | None = None) -> Column:
    """Drop everything from the first reply header on, then quoted lines at the end."""
    text = c
    for m in markers(languages):
        text = _cut(text, wrote_pattern(m), m.wrote)
        text = _cut(text, original_pattern(m), *m.original)
        text = _cut(text, sender_pattern(m), m.sender)
    return let(
        text,
        lambda t: F.when(
            t.contains("\n>") | t.startswith(">"), F.regexp_extract(t, UNQUOTED, 1)
        ).otherwise(t),
    )


def strip_signature(c: Column, languages: Iterable[str] | None = None) -> Column:
    """Drop the text below a signature line and the advertising line of a mail app."""
    text = _cut(c, SIGNATURE, "\n--")
    for m in markers(languages):
        text = _cut(text, sent_from_pattern(m), *m.sent_from)
    return text


def newest_reply(c: Column, languages: Iterable[str] | None = None) -> Column:
    """The text its sender typed; the whole text if the cut yields nothing usable (NULL)."""
    return let(c, lambda t: F.coalesce(strip_signature(strip_quotes(t, languages), languages), t))
