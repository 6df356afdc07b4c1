import re
import time
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postbag.functions import chunks, html, replies, text, verdicts
from postbag.functions.html_parsing import parsed_html_to_text


@pytest.mark.parametrize(
    "given_, expected",
    [
        (None, None),
        ("", None),
        (" , ", None),
        ("one", ["one"]),
        ("one, two, three", ["one", "two", "three"]),
        ("  one  ,  two  ", ["one", "two"]),
    ],
)
def test_csv_list(value, given_, expected):
    assert value(text.csv_list, given_) == expected


@pytest.mark.parametrize(
    "sender, address",
    [
        ("Al <al@example.com>", "al@example.com"),
        (" al@example.com ", "al@example.com"),
        ("nobody ", "nobody "),
        ("A <> B <b@x>", "b@x"),
        ("<a@x> <b@x>", "a@x"),
    ],
)
def test_email_address(value, sender, address):
    assert value(text.email_address, sender) == address


def test_truncate(value):
    assert value(lambda c: text.truncate(c, 5), "12345") == "12345"
    assert value(lambda c: text.truncate(c, 5), "123456") == "1234…"


@pytest.mark.parametrize(
    "subject, slug",
    [
        ("Important Meeting Notes", "important-meeting-notes"),
        ("Re: [URGENT!] Meeting?? (updated)", "re-urgent-meeting-updated"),
        ("Crème brûlée à Zürich, Straße", "creme-brulee-a-zurich-strasse"),
        ("1,234,567 items", "1234567-items"),
        ("", ""),
        ("???", ""),
        ("A" * 100, "a" * 30),
        ("a" * 29 + " b", "a" * 29),
        ("\ufb01ne Łódź ø", "fine-lodz-o"),
        ("ＷＩＤＥ ｔｅｘｔ １２", "wide-text-12"),
        ("x² №5 ½ ⑫ Ⅷ", "x2-no5-1-2-12-viii"),
        ("Привет, Щука!", "privet-shchuka"),
        ("Объём ёж Київ", "obiom-iozh-kiyiv"),
        ("Ελλάδα ψυχή θεός", "ellada-psukhe-theos"),
        ("Ærø Þór ǆ", "aero-thor-dz"),
        ("日本語 mail", "mail"),
    ],
)
def test_slug(value, subject, slug):
    assert value(lambda c: text.slug(c, 30), subject) == slug


def _dated(spark, when, offset):
    return spark.createDataFrame(
        [(when, offset, "john.doe@example.com", "Important Meeting Notes")],
        "date_local timestamp_ntz, offset int, sender string, subject string",
    )


@pytest.mark.parametrize(
    "when, offset, iso",
    [
        (datetime(2024, 7, 15, 9, 42), 120, "2024-07-15T09:42:00+02:00"),
        (datetime(2024, 7, 15, 9, 42), -330, "2024-07-15T09:42:00-05:30"),
        (datetime(2024, 7, 15, 9, 42), 0, "2024-07-15T09:42:00+00:00"),
        (datetime(2024, 1, 15, 10, 30, 5, 120), None, "2024-01-15T10:30:05.000120"),
        (datetime(1999, 12, 31, 23, 59, 59), None, "1999-12-31T23:59:59"),
    ],
)
def test_dates(spark, when, offset, iso):
    row = (
        _dated(spark, when, offset)
        .select(
            text.iso_date(F.col("date_local"), F.col("offset")).alias("iso"),
            text.header_date(F.col("date_local"), F.col("offset")).alias("shown"),
        )
        .first()
    )
    assert row["iso"] == iso
    assert row["shown"] == iso.replace("T", " ")


def test_output_key_and_header_line(spark):
    row = (
        _dated(spark, datetime(2024, 1, 15, 10, 30), None)
        .select(
            text.output_key(F.col("date_local"), F.col("sender"), F.col("subject")).alias("key"),
            text.header_line(F.col("date_local"), F.col("sender"), F.col("subject"), 10).alias("line"),
        )
        .first()
    )
    assert row["key"] == "240115-103000-john-doe-important-meeting-notes.jsonl"
    assert row["line"] == "2024-01-15 10:30 | john.doe@example.com | Important…"


def test_output_key_uses_the_text_before_the_at_sign(spark):
    key = text.output_key(F.lit(datetime(2024, 1, 15)), F.lit("Al <al@x>"), F.lit(""))
    assert spark.range(1).select(key.alias("k")).first()["k"] == "240115-000000-al-al-.jsonl"


def test_batch_header(spark):
    emails = "array<struct<date_local: timestamp_ntz, sender: string, subject: string>>"
    one = (datetime(2024, 1, 15, 10, 30), "a@x", "s" * 40)
    rows = spark.createDataFrame([(0, []), (2, [one] * 2), (5, [one] * 5)], f"n int, emails {emails}")
    headers = {
        row["n"]: row["h"] for row in rows.select("n", text.batch_header(F.col("emails")).alias("h")).collect()
    }
    line = "2024-01-15 10:30 | a@x | " + "s" * 24 + "…"
    assert headers[0] == "Batch: (empty)"
    assert headers[2] == "\n".join([line] * 2)
    assert headers[5] == "\n".join([line] * 3) + "\n  ... (+2 more emails)"


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(text.WHITESPACE + "ab"), max_size=12), min_size=40))
def test_trim_is_the_unicode_strip(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in rows.select("x", text.trim(F.col("x")).alias("y")).collect():
        assert row["y"] == row["x"].strip()


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<p><strong>Hello</strong> world</p>", "**Hello** world"),
        ("<p>one</p><p>two</p>", "one\n\ntwo"),
        ("a<br>b<BR/>c", "a\nb\nc"),
        ("<h1>Top</h1>text<h3 class=x>Sub</h3>", "# Top\n\ntext\n\n### Sub"),
        ("<ul><li>one</li><li>two</li></ul>", "  * one\n\n  * two"),
        ('<a class="x" href="http://x/?a=1">the <b>link</b></a>', "[the **link**](http://x/?a=1)"),
        ("<a href='/q'>q</a><a href=/r>r</a>", "[q](/q)[r](/r)"),
        ('<p>see <img src="x.png" alt="y"> it</p>', "see it"),
        ('<a href="#top">up</a> <a name=top>here</a>', "up here"),
        ('<a href="/x" title="The x">one</a>', '[one](/x "The x")'),
        ("<a href=/1>one <A HREF='/2'>two</A> more</a > end</a>", "[one [two](/2) more](/1) end"),
        ('<p>x <a href="/x">never closed', "x [never closed](/x)"),
        ("<a href=/1>a<a href=/2>b", "[a[b](/2)](/1)"),
        ('<a href="http://x/y">http://x/y</a>, <a href="/y">/y</a>', "<http://x/y>, [/y](/y)"),
        ('<a href="http://x/y_(z)">z</a>', r"[z](http://x/y_\(z\))"),
        ('<a href=""></a><a href="/z"></a>', "[]()[](/z)"),
        ("</a>lone <a>no target</a> <abbr>x</abbr>", "lone no target x"),
        ("a <a half tag", "a <a half tag"),
        ("<head><title>no</title></head><script>if (a < b) c()</script><style>p{}</style>yes<!-- no -->", "yes"),
        ("x<script>never closed", "x"),
        ("fish &amp; chips &lt;b&gt; &eacute;&#233;&#xe9; &copy;", "fish & chips <b> ééé ©"),
        ("&amp;lt; &unknown; &#99999999; &#xD800; & ;", "&lt; &unknown; &#99999999; &#xD800; & ;"),
        ("a &amp b &copy2024 &copy 2024 &#233 &ampersand; &lt", "a & b &copy2024 © 2024 é &ampersand; <"),
        ("a&nbsp;&nbsp;b \n\t c", "a b c"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a | b |"),
        ("one<hr>two", "one\n\n* * *\n\ntwo"),
        ("plain", "plain"),
        ("", ""),
        (None, None),
    ],
)
def test_html_to_text(value, page, expected):
    assert value(html.html_to_text, page) == expected


@pytest.mark.parametrize("page", ["<a " * 350_000, "<a href=/x " * 100_000, "<a " + "x" * 1_000_000, "</a " * 250_000 + "<a href=/x>y</a>"])
def test_half_links_are_read_once(value, page):
    started = time.monotonic()
    found = value(html.html_to_text, page)
    assert found.startswith("<") and time.monotonic() - started < 20


REPLY = "This is my reply."


@pytest.mark.parametrize(
    "languages, mail, expected",
    [
        (None, REPLY + "\n\nOn Mon, Jan 1, 2024, someone wrote:\n> Original message here\n> More", REPLY),
        (None, REPLY + "\n\nOn Mon, Jan 1, 2024 at 10:00, A very long name\n<a@x> wrote:\n> x", REPLY),
        (None, REPLY + "\n-----Original Message-----\nFrom: x\n\nold", REPLY),
        (None, REPLY + "\n---------- Forwarded message ---------\nold", REPLY),
        (None, REPLY + "\n\nFrom: A <a@x>\nSent: Monday\nTo: B\n\nold", REPLY),
        (None, REPLY + "\n> a\n>\n\n> b\n", REPLY),
        (None, "> quoted first\nanswer below", "> quoted first\nanswer below"),
        (None, "> only\n> quotes", ""),
        (None, "On reflection I wrote: nothing", "On reflection I wrote: nothing"),
        (None, REPLY + "\n-- \nAl\nExample Ltd", REPLY),
        (None, REPLY + "\n\nSent from my phone", REPLY),
        (None, REPLY + "\n-- \nAl\n\nOn Monday, B wrote:\n> x", REPLY),
        (None, "a -- b\n--\nc", "a -- b"),
        (None, "no markers", "no markers"),
        (None, "", ""),
        (["de"], "Ja.\n\nAm 1. Januar 2024 um 10:00 schrieb Al <al@x>:\n> x", "Ja."),
        (["en", "fr"], "Oui.\n\nLe 1 janvier 2024 à 10:00, Al a écrit :\n> x", "Oui."),
        (["es"], "Sí.\n\nEl lun, 1 ene 2024, Al escribió:\n> x", "Sí."),
        (["de"], "Ja.\n-----Ursprüngliche Nachricht-----\nx", "Ja."),
        (["fr"], "Oui.\n\nDe : A\nEnvoyé : lundi\n\nvieux", "Oui."),
    ],
)
def test_newest_reply(value, languages, mail, expected):
    assert value(lambda c: text.trim(replies.newest_reply(c, languages)), mail) == expected


def test_unknown_language():
    with pytest.raises(ValueError, match="xx"):
        replies.markers(["en", "xx"])


def test_long_quotes_do_not_exhaust_the_stack(value):
    quoted = "\n".join(["> line of quoted text"] * 50_000)
    assert value(lambda c: replies.newest_reply(c), f"{REPLY}\n{quoted}") == REPLY


SAYS_NOTHING = [
    None,
    "",
    "   \n ",
    "Short",
    "N/A",
    "-------------",
    "none          ",
    "(no software orders with serial numbers found)",
    "[ no thing found ]",
    "We did not find any x",
    "There were no new orders that I found",
    "no serial or numbers",
    "no license or keys",
    "Another very relevant fact",
    "Nothing to be found here",
    "none of it was\nfound in the text",
    "I could not find it at all",
    "I am UNABLE TO FIND it",
    "　no answer　",
]
SAYS_SOMETHING = [
    "This is a meaningful response with enough content",
    "Unable to\nfind the thing",
    "é" * 10,
    "found nothing at all",
    "orders found, no more",
]


@pytest.mark.parametrize(
    "answer, empty", [(a, True) for a in SAYS_NOTHING] + [(a, False) for a in SAYS_SOMETHING]
)
def test_is_empty_answer(value, answer, empty):
    assert value(verdicts.is_empty_answer, answer) is empty


WORDS = "no found find any orders serial numbers license keys relevant nothing none could not did unable to ( ) [ ] - n/a x".split()


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS + ["\n"]), max_size=9).map(" ".join), min_size=60))
def test_is_empty_answer_agrees_with_the_patterns(spark, answers):
    rows = spark.createDataFrame([(answer,) for answer in answers], "x string")
    for row in rows.select("x", verdicts.is_empty_answer(F.col("x")).alias("y")).collect():
        said = row["x"].strip().lower()
        expected = len(said) < 10 or any(
            re.match(pattern, said, re.IGNORECASE | re.DOTALL) for pattern in verdicts.EMPTY_ANSWERS
        )
        assert row["y"] is bool(expected), said


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<a href="/x" title="a > b">one</a>', '[one](/x "a > b")'),
        ('<a href="#top">up</a> <a href=/1>one <a href=/2>two</a> more</a> end', "up [one [two](/2) more](/1) end"),
        ('<a href="http://x/y">http://x/y</a>, <a href="http://x/y_(z)">z</a>', r"<http://x/y>, [z](http://x/y_\(z\))"),
        ('<a href="/z"></a><p>text</p>', "[](/z)\n\ntext"),
        ('<p>x <a href="/x">never closed', "x [never closed](/x)"),
        ("<a name=top>no target</a>", "no target"),
        ("<head><title>no</title><body><b>bold</b>", "**bold**"),
        ("<p>one<p>two &copy 2024 <img alt='x'>", "one\n\ntwo © 2024"),
        ("<ul><li>a<li>b</ul>", "  * a\n  * b"),
        ("<script>var t='</p>'</script>seen<!-- <b> -->", "seen"),
        (None, None),
    ],
)
def test_parsed_html(value, page, expected):
    assert value(parsed_html_to_text, page) == expected


def test_long_reply_headers_are_cut_off(value):
    names = ", ".join(f"Person {i} <p{i}@example.com>" for i in range(40))
    assert value(replies.newest_reply, f"Hi\n\nOn Mon, {names}\n{names} wrote:\n> old") == "Hi"
    assert value(lambda c: replies.newest_reply(c, ["de"]), f"Hi\n\nAm Mo schrieb {names}:\n> alt") == "Hi"


def test_output_key_with_missing_parts(spark):
    row = spark.range(1).select(text.output_key(F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string"), F.lit("a b")).alias("k"))
    assert row.first()["k"] == "--a-b.jsonl"


@pytest.mark.parametrize("size", [200, 7192])
def test_long_blank_runs_are_quick_and_change_nothing(value, size):
    start = time.perf_counter()
    assert value(lambda c: chunks.chunks(c, size), " " * 10_000_000) == []
    assert value(lambda c: chunks.chunks(c, size), "a" + " " * 5_000_000 + "\n b") == ["a", "b"]
    assert time.perf_counter() - start < 10


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["ab", "c.", "defg"]), st.sampled_from([" ", "\n", "\n\n", "\t \n \n"]), st.integers(1, 30)), min_size=1, max_size=12))
def test_short_runs_cut_alike(spark, pieces):
    long = "".join(word + (blank * n)[:40] for word, blank, n in pieces)
    plain = F.filter(F.transform(F.regexp_extract_all(F.lit(long), F.lit(chunks.chunk_pattern(10)), F.lit(0)), text.trim), lambda x: x != "")
    row = spark.range(1).select(chunks.chunks(F.lit(long), 10).alias("ours"), plain.alias("plain")).first()
    assert row["ours"] == row["plain"]
