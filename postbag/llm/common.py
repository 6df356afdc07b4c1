"""What the corpus operators share: tables, folds, and texts as flat byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.session import shared_path

#: The tables' columns; given, so that no job has to look at the files to find them.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

#: Bytes of text that one numpy step works on; temporary arrays are some fifty times as large.
STEP_BYTES = 1 << 20
#: The same, and rows at once, where little is to be held: workers are used again and keep the memory they once needed.
#: It adds up over the steps, beside a heap that Spark has filled.
SMALL_STEP_BYTES = 1 << 18
BATCH_ROWS = 1000
#: For tables that are pinned: Spark hands so many rows to Python at once.
BATCH = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(BATCH_ROWS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo ``modulus``; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of their MD5. NULL parts count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(1 << 52)


class Scratch:
    """Tables of one computation, in a folder of their own in the shared folder, to be dropped together."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path = spark, shared_path(spark, kind)

    def pin(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """To be called when nothing reads the tables any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and the borders of its rows in them (one more than rows; NULL is empty)."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    rows = len(column)
    _, borders, data = column.buffers()
    if rows == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(rows + 1, np.int64)
    borders = np.frombuffer(borders, np.int64, rows + 1, column.offset * 8)
    if column.null_count and (np.diff(borders)[np.asarray(column.is_null())] > 0).any():
        return utf8(column.fill_null(""))
    return np.frombuffer(data, np.uint8)[borders[0] : borders[-1]], borders - borders[0]


def steps(borders: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row comes alone."""
    low, rows = 0, len(borders) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(borders, borders[low] + most, "right")) - 1)
        yield low, min(high, rows)
        low = high


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of BATCH_ROWS rows, where Spark may hand over more."""
    for batch in batches:
        for low in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(low, BATCH_ROWS)


def row_sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between borders; empty rows give 0."""
    out = np.zeros((len(borders) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(borders) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, borders[full], axis=0, dtype=np.float64)
    return out
