"""Asking a model about every chunk.

The model is a function the caller brings: ``make_completer()`` is called once per task and returns
``complete(prompt, content)``, which yields a mapping with ``content``, ``model``, ``usage_prompt_tokens``
and ``usage_completion_tokens`` (a missing or None entry counts as empty or 0).

Calls cost money and their answers differ from run to run: write the result (``session.pin`` or a table)
before anything reads it twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from postbag.schema import RESPONSE

ATTEMPTS = 3
SHORTEST_WAIT, LONGEST_WAIT = 1.0, 10.0

Completer = Callable[[str, str], Mapping]


def wait_before(attempt: int) -> float:
    """Seconds before the given attempt (2, 3, …): doubling, within bounds."""
    return min(max(2.0 ** (attempt - 2), SHORTEST_WAIT), LONGEST_WAIT)


def call(
    complete: Completer, prompt: str, content: str, attempts: int, sleep: Callable[[float], None]
) -> tuple[dict | None, int, str | None]:
    """Answer, attempts made and error of one call; an error never leaves this function."""
    error = None
    for attempt in range(1, attempts + 1):
        if attempt > 1:
            sleep(wait_before(attempt))
        try:
            said = complete(prompt, content)
            return (
                {
                    "content": said.get("content") or "",
                    "model": said.get("model"),
                    "usage_prompt_tokens": int(said.get("usage_prompt_tokens") or 0),
                    "usage_completion_tokens": int(said.get("usage_completion_tokens") or 0),
                },
                attempt,
                None,
            )
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
    return None, attempts, error


def infer(
    chunks: DataFrame,
    prompt: str,
    make_completer: Callable[[], Completer],
    attempts: int = ATTEMPTS,
    concurrency: int | None = None,
    profile: ResourceProfile | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Add ``response``, ``attempts`` and ``error`` to every chunk row; a NULL chunk makes no call.

    Every partition calls in turn, so the number of running tasks bounds the concurrent calls. A resource
    profile that gives each task more cores lowers that number and leaves partitions small, which is the way
    to go on a cluster; ``concurrency`` deals the rows out to that many partitions instead, and a lost task
    then repeats that share of all calls.
    """
    if concurrency:
        chunks = chunks.repartition(concurrency)
    added = [
        T.StructField("response", RESPONSE),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
    schema = T.StructType([*chunks.schema.fields, *added])

    arrow_types = to_arrow_schema(T.StructType(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete = make_completer()
        for batch in batches:
            results = [
                (None, 0, None) if chunk is None else call(complete, prompt, chunk, attempts, sleep)
                for chunk in batch.column("chunk").to_pylist()
            ]
            # Message metadata passes through untouched; only the new columns are built here.
            new = [
                pa.array([result[i] for result in results], field.type)
                for i, field in enumerate(arrow_types)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new], names=[*batch.schema.names, *arrow_types.names]
            )

    return chunks.mapInArrow(run, schema, profile=profile)


def answered(responses: DataFrame) -> DataFrame:
    return responses.filter("response IS NOT NULL")


def failed(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("error").isNotNull())
