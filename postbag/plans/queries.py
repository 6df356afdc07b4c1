"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.functions.chunks import chunk_size, token_count, token_estimate
from postbag.functions.html import html_to_text
from postbag.functions.html_parsing import parsed_html_to_text
from postbag.functions.replies import strip_quotes, strip_signature
from postbag.functions.text import (
    batch_header,
    csv_list,
    email_address,
    header_line,
    iso_date,
    output_key,
    slug,
    truncate,
)
from postbag.functions.verdicts import is_empty_answer
from postbag.operators import packing, reports, threads
from postbag.operators.cleaning import body, clean, with_content
from postbag.operators.filters import Criteria, search
from postbag.operators.inference import infer
from postbag.operators.ledger import ask_once
from postbag.operators.ordering import limit, with_order
from postbag.operators.text_index import index_files, search_files
from postbag.plans.ask import AskOptions, ask, fetch
from postbag.plans.corpus import FOLDERS, MAILBOXES, conv_messages, messages, table
from postbag.schema import MESSAGE
from postbag.session import pin, shared_path, spread
from postbag.sources.archive import ThreadArchive
from postbag.sources.provider_json import provider_json_errors, read_provider_json
from postbag.sources.records import read_records, records, with_verdict, write_records
from postbag.sources.registry import read_mailboxes
from postbag.sources.rfc822 import read_packed_rfc822
from postbag.streaming.jobs import (
    ask_stream,
    finish_batches,
    message_stream,
    provider_json_stream,
    write_asked_stream,
    write_records_stream,
    write_stream,
)

PROMPT = "Report the size of this text."
CONTEXT = 1200  # leaves 200 characters of content
CHUNK = chunk_size(CONTEXT)
FULL = chunk_size(8192)
KEY = ("mailbox", "folder", "uid")


def no_wait(seconds: float) -> None:
    """Stands for sleeping between attempts."""


def make_stub() -> Callable[[str, str], dict]:
    """A model without a network: says how long a text is and what its digest is, or that it found nothing.

    Texts whose digest starts with ``f`` cannot be answered.
    """

    def complete(prompt: str, content: str) -> dict:
        digest = hashlib.md5(content.encode()).hexdigest()
        if digest[0] == "f":
            raise ConnectionError("no answer")
        if digest[0] == "0":
            said = "Nothing of that kind was found here"
        elif digest[0] == "1":
            said = None
        else:
            said = f"{len(content)} characters, digest {digest}"
        return {
            "content": said,
            "model": "stub",
            "usage_prompt_tokens": len(prompt) + len(content),
            "usage_completion_tokens": len(said or ""),
        }

    return complete


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(messages(spark, sf_dir))


def ordered(df: DataFrame) -> DataFrame:
    return with_order(df, MAILBOXES, FOLDERS)


def cleaned(spark: SparkSession, sf_dir: str, headers: bool = False) -> DataFrame:
    return with_content(corpus(spark, sf_dir), headers=headers)


def responses(spark: SparkSession, sf_dir: str, size: int = FULL) -> DataFrame:
    """All messages through the stub. The stub's answers are repeatable, so nothing is written first."""
    work = packing.chunked(packing.single_items(cleaned(spark, sf_dir)), size=size)
    return infer(work, PROMPT, make_stub, sleep=no_wait)


# --- filters


def filter_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = Criteria(
        query="THE",
        sender="user, assistant@example.com",
        subject="gespräch",
        date_from="2024-01-02",
        date_to="2024-01-04T12:30:00",
    )
    found = search(messages(spark, sf_dir), criteria, ["conv", "docs"], ["INBOX", "Sent"])
    return found.select(*KEY, "subject")


def filter_recipients_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(messages(spark, sf_dir), Criteria(recipient="team3@, FR@lists , ,"))
    return found.select(*KEY, F.array_join("recipients", ",").alias("recipients"))


def filter_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(corpus(spark, sf_dir), Criteria(query="License")).select(*KEY)


def filter_full_text_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a table of many files: those that cannot hold the word are not read."""
    base = shared_path(spark, "indexed")
    corpus(spark, sf_dir).repartitionByRange(16, "mailbox", "uid").write.parquet(f"{base}/messages")
    index_files(spark, f"{base}/messages", f"{base}/index")
    return search_files(spark, f"{base}/messages", f"{base}/index", Criteria(query="License")).select(*KEY)


def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(messages(spark, sf_dir), Criteria(date_from="2024-01-01", date_to="2024-01-02"))
    return found.groupBy("mailbox").agg(F.count("*").alias("n"))


def filter_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(messages(spark, sf_dir), Criteria(where="length(text) > 2000 OR html LIKE '%</table>%'"))
    return found.select(*KEY)


def filter_folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(messages(spark, sf_dir), None, None, ["unread", "SENT"]).select(*KEY)


def filter_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(messages(spark, sf_dir))
    return found.groupBy("mailbox", "folder").agg(F.count("*").alias("n"))


def csv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    items = docs.select("doc_id", csv_list(F.col("text")).alias("items"))
    return items.select(
        "doc_id",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.array_join("items", "|").alias("items"),
    )


# --- sources


def mailboxes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written as one message table per mailbox and read through the registry."""
    base = shared_path(spark, "mailboxes")
    corpus_rows = messages(spark, sf_dir)
    for name in MAILBOXES:
        corpus_rows.filter(F.col("mailbox") == name).write.parquet(f"{base}/{name}")
    table_of = {name: ("table", f"{base}/{name}") for name in MAILBOXES}
    read = read_mailboxes(spark, table_of, ["web", "conv"])
    return read.select(
        *KEY, "thread_id", "subject", "sender", F.array_join("recipients", ",").alias("recipients"),
        "date_local", "date_offset_min", "text", "html",
    )


def _mail_date(offset: str):
    return F.concat(F.date_format("date_local", "d MMM yyyy HH:mm:ss"), F.lit(f" {offset}"))


def _base64(column: str):
    return F.translate(F.base64(F.encode(column, "UTF-8")), "+/\r\n", "-_")


def gmail_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats as provider JSON, with doubled headers and decoy parts, read back as messages."""
    path = shared_path(spark, "provider-json")

    def named(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def part(mime_type: str, data):
        return F.struct(F.lit(mime_type).alias("mimeType"), F.struct(data.alias("data")).alias("body"))

    rows = conv_messages(table(spark, sf_dir, "conversations"))
    raw = rows.select(
        F.col("uid").alias("id"),
        F.col("thread_id").alias("threadId"),
        F.array("folder").alias("labelIds"),
        F.struct(
            F.lit("multipart/alternative").alias("mimeType"),
            F.array(
                named("SUBJECT", F.lit("overridden")),
                named("Subject", F.col("subject")),
                named("From", F.col("sender")),
                named("To", F.array_join("recipients", " , ")),
                named("Date", F.concat(F.lit("Mon, "), _mail_date("+0230"))),
            ).alias("headers"),
            F.array(
                part("text/plain", F.lit("b3ZlcnJpZGRlbg==")),
                part("text/plain", _base64("text")),
                part("image/png", F.lit("AAAA")),
                part("text/html", F.lit(None).cast("string")),
            ).alias("parts"),
        ).alias("payload"),
    )
    raw.write.json(path)
    read = read_provider_json(spark, path)
    return read.select(
        "uid", "thread_id", F.array_join("labels", ",").alias("labels"), "subject", "sender",
        F.array_join("recipients", ",").alias("recipients"), "date_local", "date_offset_min", "text", "html",
    )


def rfc822_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats as RFC 822 mails, many to a file, read back as messages."""
    path = shared_path(spark, "rfc822")
    rows = conv_messages(table(spark, sf_dir, "conversations"))
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("Subject: =?utf-8?B?"), _base64_mime("subject"), F.lit("?=")),
        F.concat(F.lit("From: "), "sender"),
        F.concat(F.lit("To: "), F.array_join("recipients", ", ")),
        F.concat(F.lit("Date: "), _mail_date("-0700")),
        F.lit("MIME-Version: 1.0"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: base64"),
        F.lit(""),
        F.base64(F.encode("text", "UTF-8")),
    )
    name = F.concat_ws("/", F.lit("mail"), "folder", F.concat("uid", F.lit(".eml")))
    rows.select(name.alias("path"), F.encode(lines, "UTF-8").alias("content")).write.parquet(path)
    read = read_packed_rfc822(spark, path)
    return read.select(
        "uid", "subject", "sender",
        F.array_join("recipients", ",").alias("recipients"), "date_local", "date_offset_min",
        F.trim("text", F.lit("\r\n")).alias("text"),
    )


def _base64_mime(column: str):
    return F.translate(F.base64(F.encode(column, "UTF-8")), "\r\n", "")


# --- threads


def _user_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(messages(spark, sf_dir), Criteria(sender="user@"))


def thread_expand_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = threads.expand_threads(_user_hits(spark, sf_dir), messages(spark, sf_dir), dedup=False)
    return found.select(*KEY, "thread_id", "copies")


def thread_expand_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = threads.expand_threads(_user_hits(spark, sf_dir), messages(spark, sf_dir))
    return found.select(*KEY, "thread_id")


def thread_expand_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with more threads than a broadcast may carry."""
    found = threads.expand_threads(
        messages(spark, sf_dir), messages(spark, sf_dir), dedup=False, broadcast_bytes=0
    )
    return found.select(*KEY, "copies")


def thread_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in all mailboxes, but an archive that ends after two days and holds only the inbox."""
    everything = messages(spark, sf_dir)
    archive = search(everything, Criteria(date_to="2024-01-03"), None, ["INBOX"])
    found = threads.expand_threads(
        search(everything, Criteria(subject="re")), archive, fallback=True
    )
    return found.select(*KEY)


def thread_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread mode: every message of the thread on its own, with its header lines."""
    found = threads.expand_threads(_user_hits(spark, sf_dir), corpus(spark, sf_dir), dedup=False)
    return with_content(found, headers=True).select(*KEY, "copies", "content")


def message_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir, headers=True).select(*KEY, "content")


def _transcripts(spark: SparkSession, sf_dir: str, part_size: int) -> DataFrame:
    blocks = threads.with_thread_key(ordered(cleaned(spark, sf_dir, headers=True)))
    return threads.transcripts(blocks, part_size)


def thread_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir, threads.TRANSCRIPT_PART)


def thread_transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir, 2000)


# --- order and limit


def max_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit(ordered(messages(spark, sf_dir)), 600).select(*KEY)


def max_emails_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all messages."""
    rows = ordered(messages(spark, sf_dir))
    return limit(rows, -(-rows.count() // 2)).select(*KEY)


def max_emails_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = AskOptions(PROMPT, boxes="conv", folders="INBOX", sender="user", thread=True, max_emails=301)
    return fetch(messages(spark, sf_dir), options, MAILBOXES).select(*KEY, "copies")


# --- cleaning


def body_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(*KEY, body(F.col("text"), F.col("html")).alias("body"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


def html_text_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text from a real parser."""
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", parsed_html_to_text(F.col("html")).alias("text"))


def quotes_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = spread(conv_messages(table(spark, sf_dir, "conversations")))
    return mail.select("uid", strip_quotes(F.col("text")).alias("text"))


def quotes_stripped_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote announced in another language than English, below every document."""
    docs = spread(table(spark, sf_dir, "documents"))
    announced = (
        F.when(F.col("lang") == "de", "Am 1. Januar 2024 um 10:00 schrieb Al <al@example.com>:")
        .when(F.col("lang") == "fr", "Le 1 janvier 2024 à 10:00, Al a écrit :")
        .when(F.col("lang") == "es", "El lun, 1 ene 2024, Al escribió:")
        .otherwise("-----Original Message-----")
    )
    text = F.concat("text", F.lit("\n\n"), announced, F.lit("\n> "), F.col("source"))
    return docs.select(
        "doc_id", strip_quotes(text, ["en", "de", "fr", "es"]).alias("text")
    )


def signature_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter("text IS NOT NULL").select(
        *KEY, strip_signature(F.col("text")).alias("text")
    )


def clean_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select(*KEY, "content")


def character_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much cleaning spares, per mailbox."""
    rows = corpus(spark, sf_dir).select(
        "mailbox",
        F.length(F.coalesce("text", "html")).alias("before"),
        F.length(clean(F.col("text"), F.col("html"))).alias("after"),
    )
    return rows.groupBy("mailbox").agg(
        F.sum("before").alias("chars_before"), F.sum("after").alias("chars_after")
    )


# --- packing


def _flat_batches(batched: DataFrame) -> DataFrame:
    return batched.select(
        "batch_id",
        "mailbox",
        F.size("emails").cast("long").alias("n_emails"),
        F.array_join("emails.uid", ",").alias("uids"),
        "content",
    )


def batch_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_batches(packing.batches(ordered(cleaned(spark, sf_dir)))).drop("content")


def batch_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_batches(packing.batches(ordered(cleaned(spark, sf_dir)), 7)).drop("uids")


def batch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_batches(packing.fitted_batches(ordered(cleaned(spark, sf_dir)), FULL))


def _chunk_rows(spark: SparkSession, sf_dir: str, size: int, fixed: bool = False) -> DataFrame:
    items = packing.single_items(cleaned(spark, sf_dir))
    rows = packing.chunked(items, size=size, fixed=fixed).filter("chunk IS NOT NULL")
    return rows.select("item_id", F.col("chunk_ix").cast("long").alias("chunk_ix"), "chunk")


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, CHUNK, fixed=True)


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, CHUNK)


def chunk_semantic_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rows(spark, sf_dir, FULL)


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir).select("mailbox", token_estimate(F.col("content")).alias("tokens"))
    return rows.groupBy("mailbox").agg(
        F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest")
    )


def make_word_encoder() -> Callable[[str], list]:
    return str.split


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by an injected tokenizer, here one that splits at blanks."""
    docs = spread(table(spark, sf_dir, "documents"))
    count = token_count(make_word_encoder)
    return docs.select("doc_id", count(F.col("text")).alias("tokens"))


# --- asking


def _flat_responses(found: DataFrame) -> DataFrame:
    return found.select(
        "item_id",
        F.col("chunk_ix").cast("long").alias("chunk_ix"),
        F.col("response.content").alias("content"),
        F.col("response.model").alias("model"),
        F.col("response.usage_prompt_tokens").alias("prompt_tokens"),
        F.col("response.usage_completion_tokens").alias("completion_tokens"),
        F.col("attempts").cast("long").alias("attempts"),
        "error",
    )


def infer_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_responses(responses(spark, sf_dir).filter("response IS NOT NULL"))


def infer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = responses(spark, sf_dir).filter("error IS NOT NULL")
    return failed.select(
        "item_id", F.col("chunk_ix").cast("long").alias("chunk_ix"),
        F.col("attempts").cast("long").alias("attempts"), "error",
    )


def make_broken_stub() -> Callable[[str, str], dict]:
    """The stub, until half of the texts: what it answers says so, the rest fails for good."""
    answer = make_stub()

    def complete(prompt: str, content: str) -> dict:
        if hashlib.md5(content.encode()).hexdigest()[0] >= "8":
            raise TimeoutError("gone")
        return {**answer(prompt, content), "model": "first run"}

    return complete


def infer_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that got answers to half of its questions, and the run that goes on with the rest."""
    work = pin(packing.chunked(packing.single_items(cleaned(spark, sf_dir)), size=FULL), "work")
    path = shared_path(spark, "ledger")
    for make in (make_broken_stub, make_stub):
        found = ask_once(work, PROMPT, make, path, attempts=1, sleep=no_wait, calls_per_task=1000)
    return _flat_responses(found.filter("response IS NOT NULL"))


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.error_report(pin(responses(spark, sf_dir), "responses"))


def ask_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over two mailboxes: the flagship."""
    options = AskOptions(
        PROMPT, boxes="conv,docs", sender="user,src", date_from="2024-01-01", date_to="2024-01-03", attempts=1
    )
    found = with_verdict(ask(corpus(spark, sf_dir), options, make_stub, MAILBOXES))
    return _flat_responses(found.filter("NOT is_empty"))


def ask_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = AskOptions(PROMPT, boxes=MAILBOXES, batch=True, attempts=1)
    found = with_verdict(ask(corpus(spark, sf_dir), options, make_stub, MAILBOXES))
    return _flat_responses(found.filter("NOT is_empty"))


# --- answers and records


def response_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken for an answer: does it say that nothing was found?"""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", is_empty_answer(F.col("text")).alias("is_empty"))


def skipped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_verdict(responses(spark, sf_dir))
    return found.groupBy("mailbox").agg(
        F.count_if("is_empty").alias("skipped"), F.count_if(~F.col("is_empty")).alias("kept")
    )


def sender_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(*KEY, email_address(F.col("sender")).alias("address"))


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(*KEY, truncate(F.col("subject"), 25).alias("subject"))


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = header_line(F.col("date_local"), F.col("sender"), F.col("subject"))
    return messages(spark, sf_dir).select(*KEY, line.alias("line"))


def batch_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = packing.batches(ordered(cleaned(spark, sf_dir)))
    return batched.select("batch_id", batch_header(F.col("emails")).alias("header"))


def output_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = output_key(F.col("date_local"), F.col("sender"), F.col("subject"))
    return messages(spark, sf_dir).select(*KEY, key.alias("output_key"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", slug(F.col("text")).alias("slug"))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = iso_date(F.col("date_local"), F.col("date_offset_min"))
    return messages(spark, sf_dir).select(*KEY, date.alias("date"))


def _flat_records(found: DataFrame) -> DataFrame:
    return found.select(
        "output_key",
        F.col("email.uid").alias("uid"),
        F.col("email.subject").alias("subject"),
        F.col("email.sender").alias("sender"),
        F.array_join("email.recipients", ",").alias("recipients"),
        F.col("email.date").alias("date"),
        F.col("response.content").alias("content"),
        F.col("response.usage_prompt_tokens").alias("prompt_tokens"),
        F.col("response.usage_completion_tokens").alias("completion_tokens"),
    )


def result_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_records(records(responses(spark, sf_dir)))


def result_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read back."""
    path = shared_path(spark, "records")
    records(responses(spark, sf_dir)).write.option("ignoreNullFields", "false").json(path)
    return _flat_records(read_records(spark, path))


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that broke before it was done, repeated by a restarted driver, beside another run: each record once."""
    path = shared_path(spark, "runs")
    found = records(pin(responses(spark, sf_dir), "responses"))  # asked once, written as often as it takes
    mail = found.filter(F.col("email.uid").startswith("c-"))
    found.write.option("ignoreNullFields", "false").json(f"{path}/run_id=monday")  # written, never marked as done
    write_records(found.filter(~F.col("email.uid").startswith("c-")), path, run_id="monday")
    for _ in range(2):
        write_records(mail, path, run_id="tuesday")
    return _flat_records(read_records(spark, path))


def batch_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch records written as JSON lines and read back, one row per message shown."""
    path = shared_path(spark, "records")
    work = packing.chunked(packing.batch_items(packing.batches(ordered(cleaned(spark, sf_dir)))), size=FULL)
    found = records(infer(work, PROMPT, make_stub, sleep=no_wait), batch=True)
    found.write.option("ignoreNullFields", "false").json(path)
    return _flat_batch_records(read_records(spark, path, batch=True))


def _flat_batch_records(found: DataFrame) -> DataFrame:
    return found.select(
        "output_key",
        F.posexplode("emails").alias("place", "email"),
        F.col("response.content").alias("content"),
    ).select(
        "output_key", F.col("place").cast("long").alias("place"), F.col("email.uid").alias("uid"),
        F.col("email.date").alias("date"), "content",
    )


# --- reports


def mailbox_counts_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(messages(spark, sf_dir), Criteria(date_to="2024-01-02"), None, ["sent"])
    return reports.mailbox_counts(found, MAILBOXES)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_stats(pin(responses(spark, sf_dir), "responses")).drop("no_emails")


# --- streams


def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats as a stream of a message table: searched, cleaned and written."""
    base = shared_path(spark, "stream")
    conv_messages(table(spark, sf_dir, "conversations")).to(MESSAGE).write.parquet(f"{base}/in")
    stream = search(message_stream(spark, f"{base}/in"), Criteria(sender="user"))
    done = write_stream(
        with_content(stream).select(*KEY, "content"), f"{base}/out", f"{base}/checkpoint"
    )
    done.awaitTermination()
    return spark.read.schema("mailbox string, folder string, uid string, content string").parquet(f"{base}/out")


def stream_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as a stream through the stub into JSON lines."""
    base = shared_path(spark, "stream")
    corpus(spark, sf_dir).write.parquet(f"{base}/in")
    options = AskOptions(PROMPT, folders="INBOX,sent", attempts=1)
    found = ask_stream(message_stream(spark, f"{base}/in", max_files=4), options, make_stub)
    write_records_stream(found, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _flat_records(read_records(spark, f"{base}/out"))


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages arrive at once and are asked about in batches."""
    base = shared_path(spark, "stream")
    corpus(spark, sf_dir).write.parquet(f"{base}/in")
    options = AskOptions(PROMPT, boxes=MAILBOXES, folders=FOLDERS, batch=True, attempts=1)
    query = write_asked_stream(
        message_stream(spark, f"{base}/in", max_files=None),
        options, make_stub, f"{base}/out", f"{base}/checkpoint",
    )
    query.awaitTermination()
    return _flat_batch_records(read_records(spark, f"{base}/out", batch=True))


def stream_batches_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in pieces, each in a run of its own that goes on from the checkpoint: batches go on over all of them."""
    base = shared_path(spark, "stream")
    options = AskOptions(PROMPT, boxes=MAILBOXES, folders=FOLDERS, batch=True, attempts=1)
    rows = pin(corpus(spark, sf_dir), "arriving")
    for mailbox in MAILBOXES:
        for folder in FOLDERS:
            piece = rows.filter((F.col("mailbox") == mailbox) & (F.col("folder") == folder))
            if not piece.take(1):
                continue
            piece.write.mode("append").parquet(f"{base}/in")
            query = write_asked_stream(
                message_stream(spark, f"{base}/in", max_files=None),
                options, make_stub, f"{base}/out", f"{base}/checkpoint", carry=True,
            )
            query.awaitTermination()
    finish_batches(spark, options, make_stub, f"{base}/out")
    return _flat_batch_records(read_records(spark, f"{base}/out", batch=True))


def _odd_lines(spark: SparkSession, sf_dir: str) -> str:
    """Documents as provider JSON: by language broken off, without id, with a body that is no base64, or as it should be."""
    path = shared_path(spark, "odd-json")
    name = F.concat(F.lit("doc-"), F.col("doc_id"))

    def line(given, data):
        body = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(data.alias("data")).alias("body"))
        return F.to_json(F.struct(given.alias("id"), name.alias("threadId"), body.alias("payload")))

    whole = line(name, _base64("text"))
    odd = (
        F.when(F.col("lang") == "de", F.left(whole, F.lit(40)))
        .when(F.col("lang") == "fr", line(F.lit(None).cast("string"), _base64("text")))
        .when(F.col("lang") == "es", line(name, F.concat(F.lit("!"), "source")))
        .otherwise(whole)
    )
    spread(table(spark, sf_dir, "documents")).select(odd.alias("value")).write.text(path)
    return path


def _flat_errors(found: DataFrame) -> DataFrame:
    return found.select("mailbox", F.regexp_extract("source", "doc-([0-9]+)", 1).alias("doc"), "error")


def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cannot be read, or not in full."""
    return _flat_errors(provider_json_errors(spark, _odd_lines(spark, sf_dir), "work"))


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as they arrive."""
    base = shared_path(spark, "stream")
    _, bad = provider_json_stream(spark, _odd_lines(spark, sf_dir), "work")
    write_stream(bad, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _flat_errors(spark.read.schema("mailbox string, source string, error string").parquet(f"{base}/out"))


def stream_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns arrive; their threads come from the message table."""
    return _stream_threads(spark, sf_dir, messages(spark, sf_dir))


def stream_threads_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a table kept by thread, of which every micro-batch reads the folders it needs."""
    archive = ThreadArchive(shared_path(spark, "archive"), buckets=64)
    archive.add(messages(spark, sf_dir))
    return _stream_threads(spark, sf_dir, archive)


def _stream_threads(spark: SparkSession, sf_dir: str, archive: DataFrame | ThreadArchive) -> DataFrame:
    base = shared_path(spark, "stream")
    _user_hits(spark, sf_dir).write.parquet(f"{base}/in")
    options = AskOptions(PROMPT, boxes=MAILBOXES, folders=FOLDERS, thread=True, attempts=1)
    query = write_asked_stream(
        message_stream(spark, f"{base}/in"), options, make_stub, f"{base}/out", f"{base}/checkpoint",
        archive=archive,
    )
    query.awaitTermination()
    return _flat_records(read_records(spark, f"{base}/out"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        filter_criteria, filter_recipients_any, filter_full_text, filter_full_text_indexed, filter_dates, filter_where,
        filter_folder_labels, filter_none, csv_lists,
        mailboxes_table, gmail_json_scan, rfc822_scan,
        thread_expand_multi, thread_expand_dedup, thread_expand_shuffled, thread_fallback, thread_rows,
        message_block, thread_transcript, thread_transcript_parts,
        max_emails, max_emails_large, max_emails_threads,
        body_choice, html_text, html_text_parsed, quotes_stripped, quotes_stripped_languages, signature_stripped,
        clean_content, character_savings,
        batch_fixed, batch_text, batch_fit, chunk_fixed, chunk_semantic, chunk_semantic_full,
        token_estimates, token_counts,
        infer_stub, infer_errors, infer_resumed, error_report, ask_messages, ask_batches,
        response_gate, skipped_answers, sender_address, truncated, header_lines, batch_headers,
        output_keys, slugs, iso_dates, result_record, result_readback, run_records, batch_record,
        mailbox_counts_total, run_stats, stream_clean, stream_ask, stream_batches, stream_batches_carried,
        stream_threads, stream_threads_archived, json_errors, stream_errors,
    )
}
