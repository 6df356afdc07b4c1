"""Messages from a mail provider's API, landed as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.functions.text import let, trim
from postbag.schema import MESSAGE, PROVIDER_JSON

# Where a line that cannot be read is kept.
CORRUPT = "_corrupt"

# Zone names of mail dates and their offsets.
ZONES = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}
DATE_PARTS = (
    r"^\s*(?:[A-Za-z]{3,9},?\s+)?"
    r"([0-9]{1,2})[ -]+([A-Za-z]{3})[a-z]*[ -]+([0-9]{2,4})\s+"
    r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?"
    r"\s*([+-][0-9]{4}|[A-Za-z]{1,4})?"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def header(headers: Column, name: str) -> Column:
    """Value of a header, whatever its case; the last one counts, a missing one is empty."""
    named = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.coalesce(F.try_element_at(named, F.lit(-1))["value"], F.lit(""))


def decode_data(data: Column) -> Column:
    """URL-safe base64 to text; NULL if it is no base64."""
    return F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64")).cast("string")


def _part(parts: Column, mime_type: str) -> Column:
    fitting = F.filter(
        parts, lambda p: (p["mimeType"] == mime_type) & p["body"]["data"].isNotNull()
    )
    return F.try_element_at(fitting, F.lit(-1))["body"]["data"]


def body_data(payload: Column) -> tuple[Column, Column]:
    """Still encoded text and HTML of a message.

    Of a message in parts the last top-level part of each type counts; a message without parts is HTML or
    else text.
    """
    whole, is_html = payload["body"]["data"], payload["mimeType"] == "text/html"
    in_parts = payload["parts"].isNotNull()
    text = F.when(in_parts, _part(payload["parts"], "text/plain")).when(
        ~F.coalesce(is_html, F.lit(False)), whole
    )
    html = F.when(in_parts, _part(payload["parts"], "text/html")).when(is_html, whole)
    return text, html


def mail_date(value: Column) -> Column:
    """Struct of wall clock and offset in minutes of a mail date header; NULL fields if unreadable.

    ``-0000`` and a missing zone mean that the offset is unknown.
    """

    def of(v: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(v, DATE_PARTS, i)

        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2)))
        year = part(3).try_cast("int")
        # Two-digit years: up to 68 in this century, as in the POSIX rule.
        year = (
            F.when(F.length(part(3)) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)
        )
        clock = F.concat_ws(
            " ",
            F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")),
            F.concat_ws(
                ":", F.lpad(part(4), 2, "0"), part(5), F.when(part(6) != "", part(6)).otherwise("00")
            ),
        )
        zone = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
        named = F.coalesce(F.try_element_at(zone, F.upper(part(7))), part(7))
        hours, minutes = F.substring(named, 2, 2).try_cast("int"), F.substring(named, 4, 2).try_cast("int")
        offset = F.when(
            named.rlike("^[+-][0-9]{4}$") & (named != "-0000"),
            F.when(named.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes),
        )
        local = F.when(part(1) != "", clock.try_cast("timestamp_ntz"))
        return F.struct(
            local.alias("local"), F.when(local.isNotNull(), offset).cast("int").alias("offset")
        )

    return let(value, of)


def from_json_rows(raw: DataFrame, mailbox: str) -> DataFrame:
    """Provider rows as messages. A message lies in all folders it is labelled with."""
    payload = F.col("payload")
    headers = payload["headers"]
    text, html = body_data(payload)
    dated = raw.withColumn("_date", mail_date(header(headers, "date")))
    messages = dated.select(
        F.lit(mailbox).alias("mailbox"),
        F.lit(None).cast("string").alias("folder"),
        F.col("id").alias("uid"),
        F.col("threadId").alias("thread_id"),
        header(headers, "subject").alias("subject"),
        header(headers, "from").alias("sender"),
        F.filter(F.transform(F.split(header(headers, "to"), ","), trim), lambda r: r != "").alias(
            "recipients"
        ),
        F.col("_date.local").alias("date_local"),
        F.col("_date.offset").alias("date_offset_min"),
        decode_data(text).alias("text"),
        decode_data(html).alias("html"),
        F.col("labelIds").alias("labels"),
    )
    return messages.to(MESSAGE).filter("uid IS NOT NULL")


def read_provider_json(spark: SparkSession, path: str, mailbox: str = "gmail") -> DataFrame:
    """Messages of JSON lines. What cannot be read of them is in ``provider_json_errors``."""
    return from_json_rows(spark.read.schema(PROVIDER_JSON).json(path), mailbox)


def line_error(line: Column) -> Column:
    """What is wrong with a parsed line, NULL if nothing is: no JSON, no message id, or a body that is no base64.

    A message with an unreadable body is still a message; the other body, if it has one, counts.
    """
    text, html = body_data(line["payload"])
    unreadable = [part.isNotNull() & decode_data(part).isNull() for part in (text, html)]
    return (
        F.when(line[CORRUPT].isNotNull(), "no JSON")
        .when(line["id"].isNull(), "no message id")
        .when(unreadable[0] | unreadable[1], "unreadable body")
    )


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(value, m): lines and what they say; empty ones are left out."""
    schema = T.StructType([*PROVIDER_JSON.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.filter(trim(F.col("value")) != "").select("value", parsed.alias("m"))


def errors_of(parsed: DataFrame, mailbox: str) -> DataFrame:
    """(mailbox, source, error) of parsed lines; ``source`` is the line."""
    found = parsed.select(F.lit(mailbox).alias("mailbox"), F.col("value").alias("source"), line_error(F.col("m")).alias("error"))
    return found.filter("error IS NOT NULL")


def provider_json_errors(spark: SparkSession, path: str, mailbox: str = "gmail") -> DataFrame:
    """(mailbox, source, error) of the lines that are no JSON, have no message id or a body that cannot be read."""
    return errors_of(parsed_lines(spark.read.text(path)), mailbox)
