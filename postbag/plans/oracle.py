"""The queries again, as SQL for another engine. Every statement reads whole tables."""

from __future__ import annotations

from postbag.functions.chunks import chunk_pattern
from postbag.functions.html import BLANKS, INVISIBLE, MARKS, SPACING
from postbag.functions.replies import (
    LANGUAGES,
    SIGNATURE,
    UNQUOTED,
    original_pattern,
    sender_pattern,
    sent_from_pattern,
    wrote_pattern,
)
from postbag.functions.text import WHITESPACE
from postbag.functions.verdicts import EMPTY_ANSWERS
from postbag.plans.corpus import MESSAGES_SQL
from postbag.plans.queries import CHUNK, FULL, PROMPT

# Entities that occur in the pages; & itself last, so that nothing is decoded twice.
ENTITIES = (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def text(value: str) -> str:
    """A string literal; control characters are spelled out."""
    parts = []
    for char in value:
        if ord(char) < 32 or ord(char) > 126:
            parts.append(f"' || chr({ord(char)}) || '")
        else:
            parts.append("''" if char == "'" else char)
    return "('" + "".join(parts) + "')"


def replace_all(c: str, pattern: str, to: str) -> str:
    for i in "123":
        to = to.replace(f"${i}", f"\\{i}")
    return f"regexp_replace({c}, {text(pattern)}, {text(to)}, 'g')"


def trim(c: str) -> str:
    return f"trim({c}, {text(WHITESPACE)})"


def html_text(c: str) -> str:
    # The pages' links: one quoted target, no other attribute, no link in another; some lead into the page.
    out = replace_all(replace_all(c, INVISIBLE, ""), '<a href="#[^"]*">(.*?)</a>', "$1")
    out = replace_all(out, '<a href="([^"]*)">(.*?)</a>', "[$2]($1)")
    out = replace_all(out, BLANKS, " ")
    for mark, names in MARKS.items():
        out = replace_all(out, f"(?i)<(?:{'|'.join(names)})\\b[^>]*>", mark)
    out = replace_all(out, "<[a-zA-Z/!?][^>]*>", "")
    for entity, char in ENTITIES:
        out = replace_all(out, rf"&{entity}(?:;|\b)", char)
    for _, pattern, to in SPACING:
        out = replace_all(out, pattern, to)
    return f"replace({trim(out)}, chr(2), '  * ')"


def without_quotes(c: str, languages: tuple[str, ...] = ("en",)) -> str:
    for name in languages:
        m = LANGUAGES[name]
        for pattern in (wrote_pattern(m), original_pattern(m), sender_pattern(m)):
            c = f"regexp_replace({c}, {text(pattern)}, '')"
    # A text without quoted lines keeps its blank end.
    return (
        f"list_transform([{c}], lambda t: CASE WHEN contains(t, chr(10) || '>') OR starts_with(t, '>') "
        f"THEN regexp_extract(t, {text(UNQUOTED)}, 1) ELSE t END)[1]"
    )


def without_signature(c: str) -> str:
    c = f"regexp_replace({c}, {text(SIGNATURE)}, '')"
    return f"regexp_replace({c}, {text(sent_from_pattern(LANGUAGES['en']))}, '')"


BODY = f"CASE WHEN length(text) > 0 THEN text WHEN length(html) > 0 THEN {html_text('html')} ELSE '' END"
CLEAN = trim(without_signature(without_quotes("body")))
OFFSET = (
    "CASE WHEN date_offset_min IS NULL THEN '' ELSE (CASE WHEN date_offset_min < 0 THEN '-' ELSE '+' END) || "
    "lpad(CAST(abs(date_offset_min) // 60 AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST(abs(date_offset_min) % 60 AS VARCHAR), 2, '0') END"
)
BLOCK = (
    f"'From: ' || sender || chr(10) || 'Date: ' || strftime(date_local, '%Y-%m-%d %H:%M:%S') || {OFFSET} || "
    "chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || content"
)
ISO = f"strftime(date_local, '%Y-%m-%dT%H:%M:%S') || {OFFSET}"
ADDRESS = (
    "CASE WHEN regexp_matches(sender, '<[^>]+>') THEN regexp_extract(sender, '<([^>]+)>', 1) "
    f"WHEN contains(sender, '@') THEN {trim('sender')} ELSE sender END"
)
THREAD = (
    "CASE WHEN length(thread_id) > 0 THEN 't:' || thread_id ELSE 'm:|' || folder || '|' || uid END"
)
MAILBOX_ORD = "CASE mailbox WHEN 'conv' THEN 0 WHEN 'docs' THEN 1 ELSE 2 END"
FOLDER_ORD = "CASE folder WHEN 'INBOX' THEN 0 ELSE 1 END"
ORDER = f"{MAILBOX_ORD}, {FOLDER_ORD}, date_local, uid"
ITEM = "'m|' || mailbox || '|' || folder || '|' || uid"
SEPARATOR = "chr(10) || '---' || chr(10)"
SAID = f"lower({trim('coalesce(said, chr(32))')})"
IS_EMPTY = (
    f"(length({SAID}) < 10 OR regexp_matches({SAID}, {text('(?is)(?:' + '|'.join(EMPTY_ANSWERS) + ')')}))"
)


def truncated(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 1}) || '…' END"


# Letters of the tables that have no accent to strip, spelled out independently of the engine.
SPELLINGS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("№", "no"))


def slug(c: str, n: int | None = None) -> str:
    c = f"strip_accents(lower({c}))"
    for letter, spelled in SPELLINGS:
        c = f"replace({c}, '{letter}', '{spelled}')"
    for _ in range(2):
        c = replace_all(c, "([0-9]),([0-9])", "$1$2")
    c = f"trim({replace_all(c, '[^a-z0-9]+', '-')}, '-')"
    return c if n is None else f"trim(left({c}, {n}), '-')"


def header_line(n: int) -> str:
    return (
        f"strftime(date_local, '%Y-%m-%d %H:%M') || ' | ' || ({ADDRESS}) || ' | ' || ({truncated('subject', n)})"
    )


OUTPUT_KEY = (
    "strftime(date_local, '%y%m%d-%H%M%S') || '-' || "
    + slug("split_part(sender, '@', 1)", 20) + " || '-' || " + slug("subject", 30) + " || '.jsonl'"
)


def over_messages(select: str, *steps: str) -> str:
    return "WITH " + ", ".join([MESSAGES_SQL.strip(), *steps]) + "\n" + select


BODIES = f"bodies AS (SELECT *, {BODY} AS body FROM messages)"
CLEANED = f"cleaned AS (SELECT * EXCLUDE (text, html, body), {CLEAN} AS content FROM bodies)"


def over_cleaned(select: str, *steps: str) -> str:
    return over_messages(select, BODIES, CLEANED, *steps)


def regex_chunks(rows: str) -> str:
    """Chunks of ``CHUNK`` characters by the same expression the engine uses."""
    return f"""chunks AS (
  SELECT item_id, mailbox, unnest(range(len(parts))) AS chunk_ix, unnest(parts) AS chunk
  FROM (SELECT *, list_filter(list_transform(regexp_extract_all(content, {text(chunk_pattern(CHUNK))}),
                                             lambda x: {trim('x')}), lambda x: x <> '') AS parts
        FROM {rows}))"""


def walked_chunks(rows: str, size: int = FULL) -> tuple[str, str]:
    """Chunks found step by step: the longest stretch to the strongest boundary, then on from there.

    Boundaries are looked for in the next ``size`` characters and the blanks behind them.
    """
    spaces = "[ \\t\\r\\f\\n]"
    blank = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"

    def reach(boundary: str) -> str:
        return f"length(regexp_extract(ahead, {text('(?s)^' + boundary)}, 1))"

    return (
        f"""walk AS (
  SELECT item_id, mailbox, CAST(0 AS BIGINT) AS chunk_ix, CAST('' AS VARCHAR) AS chunk, content AS rest
  FROM {rows}
  UNION ALL
  SELECT item_id, mailbox, chunk_ix + 1, {trim('left(rest, cut)')}, ltrim(substring(rest, cut + 1), {blank})
  FROM (
    SELECT *, CASE
      WHEN length(rtrim(rest, {blank})) <= {size} THEN length(rest)
      WHEN {reach(r'(.+)\n[ \t\r\f]*\n')} > 0 THEN {reach(r'(.+)\n[ \t\r\f]*\n')}
      WHEN {reach(r'(.+)\n')} > 0 THEN {reach(r'(.+)\n')}
      WHEN {reach(r'(.*[.!?])' + spaces)} > 0 THEN {reach(r'(.*[.!?])' + spaces)}
      WHEN {reach(r'(.+)' + spaces)} > 0 THEN {reach(r'(.+)' + spaces)}
      ELSE {size} END AS cut
    FROM (
      SELECT *, left(rest, {size}) || regexp_extract(substring(rest, {size + 1}), {text('^' + spaces + '*')}) AS ahead
      FROM walk WHERE rest <> ''))
)""",
        "chunks AS (SELECT item_id, mailbox, chunk_ix - 1 AS chunk_ix, chunk FROM walk WHERE chunk_ix > 0)",
    )


ITEMS = f"items AS (SELECT *, {ITEM} AS item_id FROM cleaned)"


def batched(size: int, rows: str = "cleaned", batch: str | None = None) -> str:
    return f"""placed AS (
  SELECT *, CAST({batch or f"(row_number() OVER w - 1) // {size}"} AS BIGINT) AS batch_id FROM {rows}
  WINDOW w AS (ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
batches AS (
  SELECT batch_id, first(mailbox ORDER BY {ORDER}) AS mailbox, count(*) AS n_emails,
         string_agg(uid, ',' ORDER BY {ORDER}) AS uids,
         string_agg(content, {SEPARATOR} ORDER BY {ORDER}) AS content
  FROM placed GROUP BY batch_id)"""


BATCH_ITEMS = "items AS (SELECT 'b|' || batch_id AS item_id, mailbox, content FROM batches)"
ANSWERS = f"""answers AS (
  SELECT *, substring(md5(chunk), 1, 1) = 'f' AS is_bad,
         CASE substring(md5(chunk), 1, 1)
           WHEN '0' THEN 'Nothing of that kind was found here'
           WHEN '1' THEN ''
           ELSE length(chunk) || ' characters, digest ' || md5(chunk) END AS said
  FROM chunks),
good AS (SELECT *, {len(PROMPT)} + length(chunk) AS prompt_tokens, length(said) AS completion_tokens,
                {IS_EMPTY} AS is_empty FROM answers WHERE NOT is_bad),
bad AS (SELECT * FROM answers WHERE is_bad)"""
RESPONSES = """SELECT item_id, chunk_ix, said AS content, 'stub' AS model, prompt_tokens, completion_tokens,
       CAST(1 AS BIGINT) AS attempts, CAST(NULL AS VARCHAR) AS error FROM good"""
FLAT_RECORD = f"""SELECT {OUTPUT_KEY} AS output_key, uid, subject, sender, array_to_string(recipients, ',') AS recipients,
       {ISO} AS date, said AS content, prompt_tokens, completion_tokens
FROM good JOIN items USING (item_id) WHERE NOT is_empty"""


def with_recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def asked(select: str, items: str = ITEMS, *before: str) -> str:
    return with_recursive(over_cleaned(select, *before, items, *walked_chunks("items"), ANSWERS))


KEY = "mailbox, folder, uid"
THREADED = f"threaded AS (SELECT *, {THREAD} AS thread_key FROM messages)"
HITS = "hits AS (SELECT mailbox, thread_key, count(*) AS copies FROM threaded WHERE {} GROUP BY ALL)"
USER_HITS = HITS.format("contains(lower(sender), 'user@')")
BLOCKS = f"blocks AS (SELECT * EXCLUDE (content), {THREAD} AS thread_key, {BLOCK} AS content FROM cleaned)"


def transcript(size: int) -> str:
    return over_cleaned(
        f"""SELECT mailbox, thread_key, part, count(*) AS messages,
       string_agg(content, {SEPARATOR} ORDER BY date_local, uid, folder) AS transcript
FROM (SELECT *, CAST(coalesce(sum(length(content) + 5) OVER (
        PARTITION BY mailbox, thread_key ORDER BY date_local, uid, folder
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {size} AS part FROM blocks)
GROUP BY mailbox, thread_key, part""",
        BLOCKS,
    )


def quoted_in_languages() -> str:
    quoted = (
        "text || chr(10) || chr(10) || CASE lang "
        "WHEN 'de' THEN 'Am 1. Januar 2024 um 10:00 schrieb Al <al@example.com>:' "
        "WHEN 'fr' THEN 'Le 1 janvier 2024 à 10:00, Al a écrit :' "
        "WHEN 'es' THEN 'El lun, 1 ene 2024, Al escribió:' "
        "ELSE '-----Original Message-----' END || chr(10) || '> ' || source"
    )
    stripped = without_quotes("quoted", ("en", "de", "fr", "es"))
    return f"SELECT doc_id, {stripped} AS text FROM (SELECT doc_id, {quoted} AS quoted FROM documents)"


BATCH_RECORD = asked(
    f"""SELECT first({OUTPUT_KEY}) OVER (PARTITION BY item_id, chunk_ix ORDER BY place) AS output_key,
   place, uid, {ISO} AS date, said AS content
FROM good JOIN members USING (item_id) WHERE NOT is_empty""",
    BATCH_ITEMS,
    batched(10),
    f"""members AS (SELECT * EXCLUDE (mailbox), 'b|' || batch_id AS item_id,
  row_number() OVER (PARTITION BY batch_id ORDER BY {ORDER}) - 1 AS place FROM placed)""",
)


JSON_ERRORS = """SELECT 'work' AS mailbox, CAST(doc_id AS VARCHAR) AS doc,
       CASE lang WHEN 'de' THEN 'no JSON' WHEN 'fr' THEN 'no message id' ELSE 'unreadable body' END AS error
FROM documents WHERE lang IN ('de', 'fr', 'es')"""


STREAM_THREADS = asked(
    FLAT_RECORD,
    f"items AS (SELECT *, {ITEM} AS item_id FROM blocks SEMI JOIN hits USING (mailbox, thread_key))",
    BLOCKS,
    THREADED,
    USER_HITS,
)
FULL_TEXT = over_messages(f"""SELECT {KEY} FROM messages
WHERE contains(lower(concat_ws(chr(10), subject, sender, array_to_string(recipients, chr(10)), text, html)), 'license')""")


SQL: dict[str, str] = {
    "filter_criteria": over_messages(f"""SELECT {KEY}, subject FROM messages
WHERE mailbox IN ('conv', 'docs') AND lower(folder) IN ('inbox', 'sent')
  AND (contains(lower(sender), 'user') OR contains(lower(sender), 'assistant@example.com'))
  AND contains(lower(subject), 'gespräch')
  AND date_local >= DATE '2024-01-02' AND date_local < DATE '2024-01-04'
  AND (contains(lower(text), 'the') OR contains(lower(subject), 'the') OR contains(lower(sender), 'the')
       OR len(list_filter(recipients, lambda r: contains(lower(r), 'the'))) > 0)"""),
    "filter_recipients_any": over_messages(f"""SELECT {KEY}, array_to_string(recipients, ',') AS recipients
FROM messages WHERE len(list_filter(recipients,
  lambda r: contains(lower(r), 'team3@') OR contains(lower(r), 'fr@lists'))) > 0"""),
    "filter_full_text": FULL_TEXT,
    "filter_full_text_indexed": FULL_TEXT,
    "filter_dates": over_messages("""SELECT mailbox, count(*) AS n FROM messages
WHERE CAST(date_local AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-01' GROUP BY mailbox"""),
    "filter_where": over_messages(
        f"SELECT {KEY} FROM messages WHERE length(text) > 2000 OR html LIKE '%</table>%'"
    ),
    "filter_folder_labels": over_messages(
        f"SELECT {KEY} FROM messages WHERE lower(folder) = 'sent' OR list_contains(labels, 'Unread')"
    ),
    "filter_none": over_messages("SELECT mailbox, folder, count(*) AS n FROM messages GROUP BY ALL"),
    "csv_lists": f"""SELECT doc_id, len(items) AS n_items,
       CASE WHEN len(items) > 0 THEN array_to_string(items, '|') END AS items
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {trim('x')}),
                                 lambda x: x <> '') AS items FROM documents)""",
    "mailboxes_table": over_messages(f"""SELECT {KEY}, thread_id, subject, sender,
       array_to_string(recipients, ',') AS recipients, date_local, date_offset_min, text, html
FROM messages WHERE mailbox IN ('web', 'conv')"""),
    "gmail_json_scan": over_messages("""SELECT uid, thread_id, folder AS labels, subject, sender,
       array_to_string(recipients, ',') AS recipients, date_local, 150 AS date_offset_min, text,
       CAST(NULL AS VARCHAR) AS html
FROM messages WHERE mailbox = 'conv'"""),
    "rfc822_scan": over_messages("""SELECT uid, subject, sender, array_to_string(recipients, ',') AS recipients,
       date_local, -420 AS date_offset_min, trim(text, chr(13) || chr(10)) AS text
FROM messages WHERE mailbox = 'conv'"""),
    "thread_expand_multi": over_messages(
        f"SELECT {KEY}, thread_id, copies FROM threaded JOIN hits USING (mailbox, thread_key)",
        THREADED, USER_HITS,
    ),
    "thread_expand_dedup": over_messages(
        f"SELECT {KEY}, thread_id FROM threaded SEMI JOIN hits USING (mailbox, thread_key)",
        THREADED, USER_HITS,
    ),
    "thread_expand_shuffled": over_messages(
        f"SELECT {KEY}, count(*) OVER (PARTITION BY mailbox, thread_key) AS copies FROM threaded", THREADED
    ),
    "thread_fallback": over_messages(
        f"""SELECT {KEY} FROM archive SEMI JOIN hits USING (mailbox, thread_key) WHERE length(thread_id) > 0
UNION ALL SELECT {KEY} FROM hits ANTI JOIN archive USING (mailbox, thread_key)
UNION ALL SELECT {KEY} FROM hits SEMI JOIN archive USING (mailbox, thread_key)
WHERE thread_id IS NULL OR thread_id = ''""",
        THREADED,
        "archive AS (SELECT * FROM threaded WHERE folder = 'INBOX' AND date_local < DATE '2024-01-03')",
        "hits AS (SELECT * FROM threaded WHERE contains(lower(subject), 're'))",
    ),
    "thread_rows": over_cleaned(
        f"SELECT {KEY}, copies, content FROM blocks JOIN hits USING (mailbox, thread_key)",
        BLOCKS, THREADED, USER_HITS,
    ),
    "message_block": over_cleaned(f"SELECT {KEY}, content FROM blocks", BLOCKS),
    "thread_transcript": transcript(1_000_000),
    "thread_transcript_parts": transcript(2000),
    "max_emails": over_messages(f"SELECT {KEY} FROM messages ORDER BY {ORDER} LIMIT 600"),
    "max_emails_large": over_messages(f"""SELECT {KEY} FROM messages
QUALIFY row_number() OVER (ORDER BY {ORDER}) <= (count(*) OVER () + 1) // 2"""),
    "max_emails_threads": over_messages(
        f"""SELECT {KEY}, CAST(least(copies, 301 - before) AS BIGINT) AS copies
FROM (SELECT *, coalesce(sum(copies) OVER (ORDER BY {ORDER}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM threaded JOIN hits USING (mailbox, thread_key))
WHERE before < 301""",
        THREADED,
        HITS.format("mailbox = 'conv' AND folder = 'INBOX' AND contains(lower(sender), 'user')"),
    ),
    "body_choice": over_messages(f"SELECT {KEY}, body FROM bodies", BODIES),
    "html_text": f"SELECT page_id, {html_text('html')} AS text FROM pages",
    "html_text_parsed": f"SELECT page_id, {html_text('html')} AS text FROM pages",
    "quotes_stripped": over_messages(
        f"SELECT uid, {without_quotes('text')} AS text FROM messages WHERE mailbox = 'conv'"
    ),
    "quotes_stripped_languages": quoted_in_languages(),
    "signature_stripped": over_messages(
        f"SELECT {KEY}, {without_signature('text')} AS text FROM messages WHERE text IS NOT NULL"
    ),
    "clean_content": over_cleaned(f"SELECT {KEY}, content FROM cleaned"),
    "character_savings": over_messages(
        f"""SELECT mailbox, CAST(sum(length(coalesce(text, html))) AS BIGINT) AS chars_before,
       CAST(sum(length({CLEAN})) AS BIGINT) AS chars_after
FROM bodies GROUP BY mailbox""",
        BODIES,
    ),
    "batch_fixed": over_cleaned("SELECT batch_id, mailbox, n_emails, uids FROM batches", batched(10)),
    "batch_text": over_cleaned("SELECT batch_id, mailbox, n_emails, content FROM batches", batched(7)),
    "batch_fit": over_cleaned(
        "SELECT * FROM batches",
        batched(FULL, rows="cleaned", batch=f"""2 * ((sum(length(content) + 5) OVER w - length(content) - 5) // {FULL})
         + CASE WHEN sum(length(content) + 5) OVER w > ((sum(length(content) + 5) OVER w - length(content) - 5) // {FULL} + 1) * {FULL}
                THEN 1 ELSE 0 END"""),
    ),
    "chunk_fixed": over_cleaned(
        f"""SELECT item_id, chunk_ix, substring(content, chunk_ix * {CHUNK} + 1, {CHUNK}) AS chunk
FROM (SELECT item_id, content, unnest(range((length(content) + {CHUNK - 1}) // {CHUNK})) AS chunk_ix FROM items)""",
        ITEMS,
    ),
    "chunk_semantic": over_cleaned("SELECT item_id, chunk_ix, chunk FROM chunks", ITEMS, regex_chunks("items")),
    "chunk_semantic_full": with_recursive(
        over_cleaned("SELECT item_id, chunk_ix, chunk FROM chunks", ITEMS, *walked_chunks("items"))
    ),
    "token_estimates": over_cleaned(
        f"""SELECT mailbox, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS largest
FROM (SELECT mailbox, len(regexp_extract_all(content, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS tokens FROM cleaned) GROUP BY mailbox"""
    ),
    "token_counts": "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS tokens FROM documents",
    "infer_stub": asked(RESPONSES),
    "infer_resumed": asked(
        RESPONSES.replace("'stub' AS model", "CASE WHEN substring(md5(chunk), 1, 1) < '8' THEN 'first run' ELSE 'stub' END AS model")
    ),
    "infer_errors": asked(
        "SELECT item_id, chunk_ix, CAST(3 AS BIGINT) AS attempts, 'ConnectionError: no answer' AS error FROM bad"
    ),
    "error_report": asked(
        """SELECT mailbox, max(n) AS errors, string_agg(line, '; ' ORDER BY place DESC) AS last_errors,
       greatest(max(n) - 3, 0) AS more
FROM (SELECT mailbox, count(*) OVER (PARTITION BY mailbox) AS n,
             row_number() OVER (PARTITION BY mailbox ORDER BY date_local DESC, item_id DESC, chunk_ix DESC) AS place,
             'no answer on [' || left(subject, 20) || ']: ConnectionError: no answer' AS line
      FROM bad JOIN items USING (item_id, mailbox))
WHERE place <= 3 GROUP BY mailbox"""
    ),
    "ask_messages": asked(
        RESPONSES + " WHERE NOT is_empty",
        f"""items AS (SELECT *, {ITEM} AS item_id FROM cleaned
WHERE mailbox IN ('conv', 'docs') AND folder = 'INBOX'
  AND (contains(lower(sender), 'user') OR contains(lower(sender), 'src'))
  AND date_local >= DATE '2024-01-01' AND date_local < DATE '2024-01-03')""",
    ),
    "ask_batches": asked(
        RESPONSES + " WHERE NOT is_empty",
        BATCH_ITEMS,
        "inbox AS (SELECT * FROM cleaned WHERE folder = 'INBOX')",
        batched(10, "inbox"),
    ),
    "response_gate": f"SELECT doc_id, {IS_EMPTY} AS is_empty FROM (SELECT doc_id, text AS said FROM documents)",
    "skipped_answers": asked(
        """SELECT mailbox, count(*) FILTER (is_empty) AS skipped, count(*) FILTER (NOT is_empty) AS kept
FROM good GROUP BY mailbox"""
    ),
    "sender_address": over_messages(f"SELECT {KEY}, {ADDRESS} AS address FROM messages"),
    "truncated": over_messages(f"SELECT {KEY}, {truncated('subject', 25)} AS subject FROM messages"),
    "header_lines": over_messages(f"SELECT {KEY}, {header_line(30)} AS line FROM messages"),
    "batch_headers": over_messages(
        f"""SELECT batch_id, string_agg(line, chr(10) ORDER BY place) FILTER (place < 3)
       || CASE WHEN count(*) > 3 THEN chr(10) || '  ... (+' || (count(*) - 3) || ' more emails)' ELSE '' END AS header
FROM (SELECT (row_number() OVER w - 1) // 10 AS batch_id, (row_number() OVER w - 1) % 10 AS place,
             {header_line(25)} AS line
      FROM messages WINDOW w AS (ORDER BY {ORDER}))
GROUP BY batch_id"""
    ),
    "output_keys": over_messages(f"SELECT {KEY}, {OUTPUT_KEY} AS output_key FROM messages"),
    "slugs": f"SELECT doc_id, {slug('text')} AS slug FROM documents",
    "iso_dates": over_messages(f"SELECT {KEY}, {ISO} AS date FROM messages"),
    "result_record": asked(FLAT_RECORD),
    "result_readback": asked(FLAT_RECORD),
    "run_records": asked(FLAT_RECORD),
    "batch_record": BATCH_RECORD,
    "mailbox_counts_total": over_messages("""SELECT coalesce(name, 'Total') AS mailbox, count(uid) AS processed
FROM (VALUES ('conv'), ('docs'), ('web')) AS requested (name)
LEFT JOIN messages ON mailbox = name AND folder = 'sent' AND date_local < DATE '2024-01-02'
GROUP BY ROLLUP (name)"""),
    "run_stats": asked(
        f"""SELECT (SELECT count(*) FROM items) AS emails_fetched,
       (SELECT count(*) FROM items ANTI JOIN bad USING (item_id)) AS emails_processed,
       (SELECT count(DISTINCT item_id) FROM bad) AS emails_failed,
       count(*) AS calls,
       2 * (SELECT count(*) FROM bad) AS retries,
       CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens_used,
       count(*) FILTER (NOT is_empty) AS records_written,
       count(*) FILTER (is_empty) AS answers_skipped,
       (SELECT count(DISTINCT {OUTPUT_KEY}) FROM items
        WHERE item_id IN (SELECT item_id FROM good WHERE NOT is_empty)) AS distinct_keys
FROM good"""
    ),
    "stream_clean": over_cleaned(
        f"SELECT {KEY}, content FROM cleaned WHERE mailbox = 'conv' AND contains(lower(sender), 'user')"
    ),
    "stream_ask": asked(FLAT_RECORD),
    "stream_batches": BATCH_RECORD,
    "stream_batches_carried": BATCH_RECORD,
    "json_errors": JSON_ERRORS,
    "stream_errors": JSON_ERRORS,
    "stream_threads": STREAM_THREADS,
    "stream_threads_archived": STREAM_THREADS,
}
