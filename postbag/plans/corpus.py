"""The driver's text tables seen as three mailboxes, in Spark and as SQL.

``conv``  a chat turn is a message, a chat a thread; every turn but the first quotes below itself
``docs``  a document is a message with a signature
``web``   a page is a message that has only HTML
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postbag.schema import MESSAGE

MAILBOXES = ["conv", "docs", "web"]
FOLDERS = ["INBOX", "sent"]
# Given, so that no job has to look at the files to find them.
COLUMNS = {
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _after_start(hours: str, minutes: str) -> str:
    return f"TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, int({hours}), int({minutes}), 0)"


def conv_messages(turns: DataFrame) -> DataFrame:
    sender = "concat(initcap(role), ' <', role, '@example.com>')"
    quote = rf"concat('\n\nOn Mon, Jan 1, 2024, ', {sender}, ' wrote:\n> ', replace(text, '\n', '\n> '))"
    return turns.selectExpr(
        "'conv' AS mailbox",
        "if(role = 'assistant', 'sent', 'INBOX') AS folder",
        "concat('c-', conv_id, '-', turn) AS uid",
        "concat('t-', conv_id) AS thread_id",
        "concat('Re: Gespräch №', conv_id, ' [turn ', turn, '!]') AS subject",
        f"{sender} AS sender",
        "array('me@example.com', concat('Team', conv_id % 7, '@example.com')) AS recipients",
        f"{_after_start('conv_id', 'turn')} AS date_local",
        "CAST(NULL AS INT) AS date_offset_min",
        f"if(turn > 0, concat(text, {quote}), text) AS text",
        "CAST(NULL AS STRING) AS html",
        "CAST(NULL AS ARRAY<STRING>) AS labels",
    )


def docs_messages(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "'docs' AS mailbox",
        "'INBOX' AS folder",
        "concat('d-', doc_id) AS uid",
        "CAST(NULL AS STRING) AS thread_id",
        "concat(lang, ' report from ', source, ', no. 1,', doc_id) AS subject",
        "concat(source, '@example.com') AS sender",
        "array(concat(lang, '@lists.example.com')) AS recipients",
        f"{_after_start('0', 'doc_id')} AS date_local",
        "120 AS date_offset_min",
        r"concat(text, '\n-- \n', source, ' desk') AS text",
        "CAST(NULL AS STRING) AS html",
        "array('INBOX', 'Unread') AS labels",
    )


def web_messages(pages: DataFrame) -> DataFrame:
    return pages.selectExpr(
        "'web' AS mailbox",
        "'INBOX' AS folder",
        "concat('p-', page_id) AS uid",
        "'' AS thread_id",
        "url AS subject",
        "concat('web@', regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS sender",
        "CAST(array() AS ARRAY<STRING>) AS recipients",
        f"{_after_start('0', 'page_id')} AS date_local",
        "-330 AS date_offset_min",
        "CAST(NULL AS STRING) AS text",
        "html",
        "CAST(NULL AS ARRAY<STRING>) AS labels",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        conv_messages(table(spark, sf_dir, "conversations"))
        .unionByName(docs_messages(table(spark, sf_dir, "documents")))
        .unionByName(web_messages(table(spark, sf_dir, "pages")))
        .to(MESSAGE)
    )


MESSAGES_SQL = """
conv_messages AS (
  SELECT *,
         upper(substring(role, 1, 1)) || substring(role, 2) || ' <' || role || '@example.com>' AS sender
  FROM conversations
),
messages AS (
  SELECT 'conv' AS mailbox,
         CASE WHEN role = 'assistant' THEN 'sent' ELSE 'INBOX' END AS folder,
         'c-' || conv_id || '-' || turn AS uid,
         't-' || conv_id AS thread_id,
         'Re: Gespräch №' || conv_id || ' [turn ' || turn || '!]' AS subject,
         sender,
         ['me@example.com', 'Team' || (conv_id % 7) || '@example.com'] AS recipients,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS date_local,
         CAST(NULL AS INTEGER) AS date_offset_min,
         CASE WHEN turn > 0
              THEN text || chr(10) || chr(10) || 'On Mon, Jan 1, 2024, ' || sender || ' wrote:' || chr(10)
                        || '> ' || replace(text, chr(10), chr(10) || '> ')
              ELSE text END AS text,
         CAST(NULL AS VARCHAR) AS html,
         CAST(NULL AS VARCHAR[]) AS labels
  FROM conv_messages
  UNION ALL
  SELECT 'docs', 'INBOX', 'd-' || doc_id, NULL,
         lang || ' report from ' || source || ', no. 1,' || doc_id,
         source || '@example.com', [lang || '@lists.example.com'],
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id), 120,
         text || chr(10) || '-- ' || chr(10) || source || ' desk', NULL, ['INBOX', 'Unread']
  FROM documents
  UNION ALL
  SELECT 'web', 'INBOX', 'p-' || page_id, '', url,
         'web@' || regexp_extract(url, '^https?://([^/:?#]+)', 1), CAST([] AS VARCHAR[]),
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id), -330, NULL, html, NULL
  FROM pages
)
"""
