"""Row types shared by sources, operators and sinks.

A message keeps the wall clock of its own Date header (``date_local``, no zone) next to the offset in
minutes (``date_offset_min``, NULL when the header names none), because a Spark TIMESTAMP would fold both
into one instant and the records have to show the original offset again.

``(mailbox, folder, uid)`` identifies a message, as it does at every mail provider.
"""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("mailbox", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipients", T.ArrayType(T.StringType())),
        T.StructField("date_local", T.TimestampNTZType()),
        T.StructField("date_offset_min", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
    ]
)

_BODY = T.StructType([T.StructField("data", T.StringType())])

# The provider's message JSON, as far as it is read; unknown fields are skipped by the JSON reader.
PROVIDER_JSON = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("threadId", T.StringType()),
        T.StructField("labelIds", T.ArrayType(T.StringType())),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("mimeType", T.StringType()),
                    T.StructField(
                        "headers",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("name", T.StringType()),
                                    T.StructField("value", T.StringType()),
                                ]
                            )
                        ),
                    ),
                    T.StructField("body", _BODY),
                    T.StructField(
                        "parts",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("mimeType", T.StringType()),
                                    T.StructField("body", _BODY),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)

RESPONSE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("usage_prompt_tokens", T.LongType()),
        T.StructField("usage_completion_tokens", T.LongType()),
    ]
)

EMAIL = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipients", T.ArrayType(T.StringType())),
        T.StructField("date", T.StringType()),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("email", EMAIL),
        T.StructField("response", RESPONSE),
        T.StructField("timestamp", T.StringType()),
    ]
)

BATCH_RECORD = T.StructType(
    [
        T.StructField("emails", T.ArrayType(EMAIL)),
        T.StructField("response", RESPONSE),
        T.StructField("timestamp", T.StringType()),
    ]
)
