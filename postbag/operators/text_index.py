"""Full-text search that reads only files that may hold the words.

Beside a message table lies an index: for every file a Bloom filter of the groups of three characters in its headers
and bodies. A file that holds a text holds all its groups, so one whose filter lacks a group is left out before any
body is read; it can't have been a hit. What is left is searched as ever. Files that the index doesn't know are read.

Filters are bitmaps cut into stretches, one row per file and stretch: a search reads the few stretches that its own
groups fall into. A task sets the bits of the texts it reads and passes on one bitmap for each file, so that what is
shuffled grows with the files, not with their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postbag.operators.filters import Criteria, search
from postbag.schema import MESSAGE
from postbag.session import path_exists

GROUP = 3
# Bits of a file's filter, and bits that a group sets. 200,000 groups set half of them: one file in 16 is read for
# nothing if the search has a single group, one in thousands if it has three.
BITS, HASHES = 1 << 20, 4
# Bits of a row's bitmap, as Spark's bitmap functions have them.
STRETCH = 32_768
# More files than this aren't named one by one: then the table is read as a whole.
MOST_FILES = 20_000

INDEX = "file string, stretch bigint, bitmap binary"
# Bits set by another hash than this one say nothing here: such an index isn't read, and is made anew.
HASH = "hash=2"


# Stands between texts; no text holds it.
BORDER = "\udfff"


def groups(texts: list[str]) -> np.ndarray:
    """A number for each group of consecutive characters of the texts, which are in lower case; it may come often."""
    joined = np.frombuffer(BORDER.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(joined) < GROUP:
        return np.zeros(0, np.uint64)
    found, inside = np.zeros(len(joined) - GROUP + 1, np.uint64), np.ones(len(joined) - GROUP + 1, bool)
    for i in range(GROUP):
        part = joined[i : len(joined) - GROUP + 1 + i]
        found = (found << np.uint64(21)) | part  # a character has 21 bits at most
        inside &= part != ord(BORDER)
    return found[inside]


def _places(grams: np.ndarray) -> Iterator[np.ndarray]:
    """The bits that groups set, one of each group at a time."""
    for i in range(HASHES):
        x = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        yield (x ^ (x >> np.uint64(31))) % np.uint64(BITS)


def _entries(index: str) -> str:
    """Where the rows of an index lie."""
    return f"{index.rstrip('/')}/{HASH}"


def searchable() -> Column:
    """What a full-text search looks at, as separate texts."""
    fields = F.concat(F.array("subject", "sender", "text", "html"), F.coalesce("recipients", F.array().cast("array<string>")))
    return F.filter(fields, lambda text: text.isNotNull())


def _name(file: Column) -> Column:
    """A file's name as Spark lists it; local ones have one or three slashes in front, depending on who says it."""
    return F.regexp_replace(file, "^file:/+", "file:///")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """INDEX of (file, bodies): a task reads one file after the other, and holds the bits of one."""
    of, held = None, np.zeros(BITS, bool)

    def rows() -> pa.RecordBatch:
        # The first bit of a byte is its lowest one, as Spark's bitmap functions have it.
        stretches = np.packbits(held, bitorder="little").reshape(-1, STRETCH // 8)
        some = np.flatnonzero(stretches.any(axis=1))
        return pa.RecordBatch.from_arrays(
            [pa.array([of] * len(some), pa.string()), pa.array(some), pa.array([stretches[i].tobytes() for i in some], pa.binary())],
            ["file", "stretch", "bitmap"],
        )

    for batch in batches:
        files = batch.column(0).to_pylist()
        changes = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)]
        for low, high in zip(changes, changes[1:]):
            if low == high:
                continue
            if of is not None and files[low] != of:
                yield rows()
                held[:] = False
            of = files[low]
            for at in range(low, high, 100):
                bodies = batch.column(1)[at : min(at + 100, high)]
                for places in _places(groups(bodies.flatten().to_pylist())):
                    held[places] = True
    if of is not None:
        yield rows()


def index_rows(messages: DataFrame) -> DataFrame:
    """The index of a message table that was read from files: file, stretch and bitmap. Merged before it is shuffled."""
    lowered = F.transform(searchable(), lambda text: F.lower(text))
    texts = messages.select(_name(F.col("_metadata.file_path")).alias("file"), lowered.alias("bodies"))
    return texts.mapInArrow(_bitmaps, INDEX).groupBy("file", "stretch").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def index_files(spark: SparkSession, path: str, index: str) -> None:
    """Index those files of a table that aren't indexed yet. To be called when files have been added."""
    messages = spark.read.schema(MESSAGE).parquet(path)
    if path_exists(spark, _entries(index)):
        known = spark.read.schema(INDEX).parquet(_entries(index)).select("file").distinct()
        files = _files(messages).join(known, "file", "left_anti")
        new = [unquote(r["file"]) for r in files.collect()]  # names of files added since
        if not new:
            return
        messages = spark.read.schema(MESSAGE).option("basePath", path).parquet(*new)
    index_rows(messages).write.mode("append").parquet(_entries(index))


def _files(messages: DataFrame) -> DataFrame:
    names = messages.sparkSession.createDataFrame([(name,) for name in messages.inputFiles()], "file string")
    return names.select(_name(F.col("file")).alias("file"))


def lacking(spark: SparkSession, index: str, query: str) -> DataFrame:
    """(file) of the indexed files that cannot hold the words. Words shorter than a group say nothing."""
    entries = spark.read.schema(INDEX).parquet(_entries(index))
    lowered = spark.createDataFrame([(query,)], "words string").select(F.lower("words")).first()[0]
    asked = sorted({divmod(int(place), STRETCH) for places in _places(groups([lowered])) for place in places})
    if not asked:
        return spark.createDataFrame([], "file string")
    wanted = spark.createDataFrame(asked, "stretch bigint, bit bigint")  # a few bits for each character
    at = entries.filter(F.col("stretch").isin(sorted({stretch for stretch, _ in asked}))).join(F.broadcast(wanted), "stretch")
    byte = F.conv(F.hex(F.substr("bitmap", F.expr("int(bit div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, F.expr("int(bit % 8)")) == 1
    held = at.filter(is_set).groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked))
    return entries.select("file").distinct().join(held, "file", "left_anti")


def candidate_files(spark: SparkSession, path: str, index: str, query: str | None) -> list[str] | None:
    """Paths of the files that may hold the words; None if all are to be read."""
    if not query or not path_exists(spark, _entries(index)):
        return None
    files = _files(spark.read.schema(MESSAGE).parquet(path))
    left = files.join(lacking(spark, index, query), "file", "left_anti").limit(MOST_FILES + 1).collect()
    return [unquote(r["file"]) for r in left] if len(left) <= MOST_FILES else None


def search_files(
    spark: SparkSession,
    path: str,
    index: str,
    criteria: Criteria,
    mailboxes: list[str] | None = None,
    folders: list[str] | None = None,
) -> DataFrame:
    """What ``filters.search`` finds in the message table at ``path``; only files that may have hits are read."""
    names = candidate_files(spark, path, index, criteria.query)
    reader = spark.read.schema(MESSAGE).option("basePath", path)
    if names is None:
        messages = reader.parquet(path)
    elif names:
        messages = reader.parquet(*names)
    else:
        messages = spark.createDataFrame([], MESSAGE)
    return search(messages, criteria, mailboxes, folders)
