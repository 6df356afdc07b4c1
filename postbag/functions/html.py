"""HTML to plain text with built-in column functions.

The text keeps what helps a reader of a mail (link targets, headings, list marks, emphasis, paragraphs) and
drops what does not (head, scripts, styles, comments, images). Nothing is wrapped.

Invisible parts are found by regular expressions, links by a walk over their tags with a stack. All other tags are
handled in one pass: the text is split at ``<``, and each piece gives its tag for a mark.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions.text import let, trim

# Stands for list marks until blanks are collapsed.
BULLET = "\x02"

INVISIBLE = (
    r"(?is)<head\b.*?</head\s*>"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"|<!--.*?(?:-->|\z)"
)
# Where a link begins or ends. A tag holds no other tag, so a text full of half tags is read once.
LINK_TAG = r"(?i)(?=<a\s[^<>]*>)|(?=</a\s*>)"
LINK_START, LINK_END = r"(?i)^<a\s[^<>]*>", r"(?i)^</a\s*>"
# Stand for < and > of a bare address until tags are replaced.
OPEN, CLOSE = "\x03", "\x04"
# Runs of blanks that are not a single space; single ones are left alone, there are so many.
BLANKS = r" *[\t\n\f\r][ \t\n\f\r]*|  +"
# What may follow an ampersand.
REFERENCE = "^(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
# What stands for a tag; any other tag is dropped.
MARKS = {
    "**": ("b", "/b", "strong", "/strong"),
    "_": ("i", "/i", "em", "/em"),
    "\n" + BULLET: ("li",),
    **{"\n\n" + "#" * level + " ": (f"h{level}",) for level in range(1, 7)},
    "\n\n* * *\n\n": ("hr",),
    "\n": ("br", "tr", "/tr", "/li"),
    " | ": ("/td", "/th"),
    "\n\n": (
        *("p", "/p", "div", "/div", "blockquote", "/blockquote", "pre", "/pre", "table", "/table"),
        *("ul", "/ul", "ol", "/ol", "dl", "/dl"),
        *(f"/h{level}" for level in range(1, 7)),
    ),
}
# Spacing of the finished text: what shows that a step is needed, its pattern, what stands for a match.
SPACING = (
    (("\xa0",), "\xa0", " "),
    ((" \n", "\n "), " *\n *", "\n"),
    (("  ",), "  +", " "),
    (("\n\n\n",), "\n\n\n+", "\n\n"),
)


def _map(values: dict[str, str]) -> Column:
    """A constant map, as one expression."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _numeric(name: Column) -> Column:
    """Character of ``#233`` or ``#xe9``; NULL if there is no such character."""
    code = F.when(
        name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10).try_cast("long")
    ).otherwise(F.substring(name, 2, 8).try_cast("long"))
    return let(
        code,
        lambda n: F.when(
            n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF),
            F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"),
        ),
    )


def decode_entities(c: Column) -> Column:
    """Replace character references in one pass, so that ``&amp;lt;`` becomes ``&lt;`` and not ``<``.

    As in browsers the semicolon may be missing.
    """
    # Looked up from the front: the usual ones come first.
    usual = {name: chr(name2codepoint[name]) for name in ("amp", "nbsp", "quot", "lt", "gt")} | {"apos": "'"}
    named = _map(usual | {name: chr(code) for name, code in name2codepoint.items()})

    def one(piece: Column) -> Column:
        def char(name: Column) -> Column:
            return F.when(name.startswith("#"), _numeric(name)).otherwise(F.try_element_at(named, name))

        return let(
            F.regexp_extract(piece, REFERENCE, 0),
            lambda ref: F.coalesce(
                F.concat(
                    let(F.rtrim(ref, F.lit(";")), char), F.substr(piece, F.length(ref) + 1)
                ),
                F.concat(F.lit("&"), piece),
            ),
        )

    def all_of(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.concat(pieces[0], F.array_join(F.transform(rest, one), ""))

    return let(
        c, lambda text: F.when(text.contains("&"), let(F.split(text, "&"), all_of)).otherwise(text)
    )


def _replace_tags(c: Column) -> Column:
    marks = _map({name: mark for mark, names in MARKS.items() for name in names})

    def one(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, "^(/?[a-zA-Z][a-zA-Z0-9]*)", 1))
        mark = F.coalesce(F.try_element_at(marks, name), F.lit(""))
        end = F.instr(piece, ">")
        return F.when(
            (end > 0) & piece.rlike("^[a-zA-Z/!?]"), F.concat(mark, F.substr(piece, end + 1))
        ).otherwise(F.concat(F.lit("<"), piece))

    def all_of(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.concat(pieces[0], F.array_join(F.transform(rest, one), ""))

    return let(F.split(c, "<"), all_of)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; NULL if the tag hasn't got it."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']*))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), value)


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]()])", r"\\$1")


def _follow_links(c: Column) -> Column:
    """Links as ``[text](target "title")``.

    The text is cut at link tags, and a stack says what each end tag closes: links may lie in each other. Links into
    the page itself and anchors show their text alone, an address that is its own text comes in angle brackets, and a
    link that is never closed ends with the text.
    """
    state = "struct<open: array<string>, out: array<string>>"

    def step(so_far: Column, piece: Column) -> Column:
        tag = F.substring_index(piece, ">", 1)
        rest = F.substr(piece, F.length(tag) + 2)

        def begun(target: Column) -> Column:
            title = F.coalesce(_attribute(tag, "title"), F.lit(""))
            shown = F.when(F.trim(title) != "", F.concat(F.lit(' "'), _escaped(title), F.lit('"'))).otherwise("")
            end = F.concat(F.lit("]("), _escaped(target), shown, F.lit(")"))
            shows = target.isNotNull() & ~target.startswith("#")
            bare = shows & (rest == target) & target.rlike("^[a-zA-Z+]+://")
            return F.struct(
                F.concat(so_far["open"], F.array(F.when(shows & ~bare, end).otherwise(""))).alias("open"),
                F.concat(
                    so_far["out"],
                    F.array(
                        F.when(bare, F.concat(F.lit(OPEN), rest, F.lit(CLOSE)))
                        .when(shows, F.concat(F.lit("["), rest))
                        .otherwise(rest)
                    ),
                ).alias("out"),
            ).cast(state)

        last = F.coalesce(F.try_element_at(so_far["open"], F.lit(-1)), F.lit(""))
        ended = F.struct(
            F.slice(so_far["open"], F.lit(1), F.greatest(F.size(so_far["open"]) - 1, F.lit(0))).alias("open"),
            F.concat(so_far["out"], F.array(F.concat(last, rest))).alias("out"),
        ).cast(state)
        other = F.struct(so_far["open"].alias("open"), F.concat(so_far["out"], F.array(piece)).alias("out")).cast(state)
        return (
            F.when(piece.rlike(LINK_START), let(_attribute(tag, "href"), begun))
            .when(piece.rlike(LINK_END), ended)
            .otherwise(other)
        )

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), none.alias("out")).cast(state)
    whole = lambda s: F.concat(F.array_join(s["out"], ""), F.array_join(F.reverse(s["open"]), ""))
    linked = lambda text: F.aggregate(F.split(text, LINK_TAG), start, step, whole)
    return let(c, lambda text: F.when(text.rlike(r"(?i)<a\s"), linked(text)).otherwise(text))


def _where_needed(c: Column, signs: tuple[str, ...], pattern: str, to: str) -> Column:
    """Replace in texts that hold one of the signs."""

    def step(text: Column) -> Column:
        needed = reduce(lambda x, y: x | y, [text.contains(sign) for sign in signs])
        return F.when(needed, F.regexp_replace(text, pattern, to)).otherwise(text)

    return let(c, step)


def respaced(c: Column) -> Column:
    """Tidy up blanks and line breaks of a text with marks."""
    for signs, pattern, to in SPACING:
        c = _where_needed(c, signs, pattern, to)
    bare = F.translate(trim(c), OPEN + CLOSE, "<>")
    return F.replace(bare, F.lit(BULLET), F.lit("  * "))


def html_to_text(c: Column) -> Column:
    visible = _follow_links(F.regexp_replace(c, INVISIBLE, ""))
    marked = _replace_tags(F.regexp_replace(visible, BLANKS, " "))
    return respaced(decode_entities(marked))
