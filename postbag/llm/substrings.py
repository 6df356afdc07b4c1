"""Passages that repeat across documents, to the word.

A passage repeats if an earlier document has its WORDS words in a row. Of the hashes of half as many neighbouring
words, the least among those that lie in a window of WORDS words is the window's anchor (winnowing): equal windows have
equal anchors, so a window can only repeat if its anchor is in two documents. Of windows with such anchors the hashes
of all words are compared: the first document that has a window keeps it. Windows that follow each other both here and
there make up one passage, which so has its exact ends.

``chunks`` cuts texts by content: a gear hash rolls over the bytes of a text; where it falls below a threshold at the
start of a word, and enough words have passed, a chunk ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postbag.llm.common import BATCH, SMALL_STEP_BYTES, pieces, steps, utf8
from postbag.llm.near_dups import SPACE, mix, powers, word_hashes_apart
from postbag.session import pin

#: A passage of so many words is to be found.
WORDS = 50
#: Words a chunk has at least; the share of word starts where one may end.
LEAST_WORDS, SHARE = 4, 0.25
#: Bytes that the gear hash looks back on: two bits of its 32 leave with each byte.
WINDOW = 16
GEAR = np.random.default_rng(31).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
ANCHORS = "doc_id bigint, text_hash bigint, at int, digest bigint"
WINDOWS = "doc bigint, at int, start int, end int, digest bigint"


def gear_hashes(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, of the last WINDOW bytes of its row."""
    at = np.arange(len(data)) + np.repeat(WINDOW * np.arange(1, len(borders)), np.diff(borders))
    rolled = np.zeros(len(data) + WINDOW * len(borders), np.uint32)
    rolled[at] = GEAR[data]
    back = 1
    while back < WINDOW:
        # The sum over the last 2 * back bytes from two sums over back bytes.
        rolled[back:] += rolled[:-back] << np.uint32(2 * back)
        back *= 2
    return rolled[at]


def chunks(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all chunks of all rows: row, number in the row, start, end (bytes in the row), words, digest."""
    hashes, of_row = word_hashes_apart(data, borders)
    word = np.append(~SPACE[data], False)
    first = word[:-1] & np.append(True, ~word[:-2])[: len(data)]
    row_start = borders[:-1][np.diff(borders) > 0]
    first[row_start] = word[row_start]
    starts = np.flatnonzero(first)
    last = ~word[1:] & word[:-1]
    ends_of_rows = borders[1:][np.diff(borders) > 0] - 1
    last[ends_of_rows] |= word[ends_of_rows]
    ends = np.flatnonzero(last) + 1
    rolled = gear_hashes(data, borders)
    may = np.zeros(len(starts), bool)
    inner = starts > 0
    may[inner] = rolled[starts[inner] - 1] < np.uint32(SHARE * 2**32)
    opens = np.zeros(len(starts) + 1, bool)
    opens[of_row[:-1]] = True
    cuts, since = [], 0
    candidates = np.flatnonzero(may | opens[:-1])
    for at, fresh in zip(candidates.tolist(), opens[candidates].tolist()):
        if fresh or at - since >= LEAST_WORDS:
            cuts.append(at)
            since = at
    low = np.array(cuts, np.int64)
    high = np.append(low[1:], len(starts))
    row = np.searchsorted(of_row, low, "right") - 1
    high = np.minimum(high, of_row[row + 1])
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers(_BASE, len(hashes))))
    digest = mix((sums[high] - sums[low]) * powers(_INVERSE, len(hashes) + 1)[low] + (high - low).astype(np.uint64))
    fresh = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    seq = np.arange(len(row)) - np.repeat(fresh, np.diff(np.append(fresh, len(row))))
    return row, seq, starts[low] - borders[row], ends[high - 1] - borders[row], high - low, digest


def word_spans(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    word = ~SPACE[data]
    fresh, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    full = np.diff(borders) > 0
    fresh[borders[:-1][full]] = True
    last[borders[1:][full] - 1] = True
    starts = np.flatnonzero(word & (fresh | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (last | ~np.append(word[1:], False))) + 1
    return starts, ends


def windows(data: np.ndarray, borders: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Of all windows of ``words`` words in a row: row, first word, its anchor's word, the anchor's digest, the digest."""
    hashes, of_row = word_hashes_apart(data, borders)
    n, part = len(hashes), max(1, words // 2)
    if n < words:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers(_BASE, n)))
    inverse = powers(_INVERSE, n)
    digests = lambda k: mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1] + np.uint64(k))
    own = digests(part)
    # The least of words - part + 1 digests, and the first place that has it; twice as many at each step.
    least, at, wide, most = own, np.arange(len(own)), 1, words - part + 1
    while wide < most:
        step = min(wide, most - wide)
        better = least[step:] < least[:-step]
        at = np.where(better, at[step:], at[:-step])
        least = np.where(better, least[step:], least[:-step])
        wide += step
    first = np.arange(n - words + 1)
    row = np.searchsorted(of_row, first, "right") - 1
    inside = np.flatnonzero(first + words <= of_row[row + 1])
    row, first = row[inside], first[inside]
    begins = np.asarray(of_row)[row]
    return row, first - begins, at[first] - begins, least[first], digests(words)[first]


def _anchor_rows(documents: DataFrame, words: int) -> DataFrame:
    """ANCHORS of every row. Texts of fewer words have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = utf8(batch.column(2))
            for low, high in steps(borders, SMALL_STEP_BYTES):
                row, _, at, digest, _ = windows(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low], words)
                # A window's anchor is mostly that of the one before.
                fresh = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1]))) if len(row) else row
                of = pa.array(row[fresh] + low)
                columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(at[fresh].astype(np.int32)), pa.array(digest[fresh].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ANCHORS.split(", ")])

    return documents.select(F.col("doc_id").cast("bigint"), text_hash().alias("text_hash"), "text").mapInArrow(find, ANCHORS)


def _window_rows(documents: DataFrame, words: int) -> DataFrame:
    """WINDOWS whose anchor is in ``anchors``, from doc, text, anchors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = utf8(batch.column(1))
            for low, high in steps(borders, SMALL_STEP_BYTES):
                own, ends_of = data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]
                row, first, at, _, digest = windows(own, ends_of, words)
                lists = batch.column(2)[low:high]
                owner = np.repeat(np.arange(high - low), lists.value_lengths().to_numpy())
                shared = (owner << 32) | lists.flatten().to_numpy().astype(np.int64)
                kept = np.flatnonzero(np.isin((row << 32) | at, shared))
                row, first, digest = row[kept], first[kept], digest[kept]
                starts, ends = word_spans(own, ends_of)
                word = np.searchsorted(starts, ends_of[row]) + first
                of = pa.array(row + low)
                spans = (first, starts[word] - ends_of[row], ends[word + words - 1] - ends_of[row])
                columns = [batch.column(0).take(of), *[pa.array(x.astype(np.int32)) for x in spans], pa.array(digest.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WINDOWS.split(", ")])

    return documents.mapInArrow(find, WINDOWS)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeats(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, start, end (UTF-8 bytes), words, first_doc_id of the passages that an earlier document has.

    Documents come in the order of their ids, those without one first, equal ids by a hash of the text; rows equal
    in both are one document. Repeats within a document don't count. Every passage of ``words`` words or more is found,
    from its first word to its last; one that stands in parts in several earlier documents is several passages, each
    with the first document that has it.
    """
    document = F.struct("doc_id", "text_hash")
    anchors = _anchor_rows(documents, words)
    # Digests are merged before they move: a passage that every document has is one row per task.
    shared = anchors.groupBy("digest").agg(F.min(document).alias("first_doc"), F.max(document).alias("last_doc"))
    shared = shared.filter(~F.col("first_doc").eqNullSafe(F.col("last_doc"))).select("digest")
    # Written, so that rows of a digest that many documents have can be split over tasks when joined.
    shared = pin(shared, "anchors", **BATCH)
    places = anchors.join(shared, "digest").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("anchors"))
    # Windows bear a number that orders documents, in place of the id and a hash, which would not compress.
    places = pin(places.orderBy("doc_id", "text_hash").withColumn("doc", F.monotonically_increasing_id()), "places", **BATCH)
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key")
    listed = places.select(id_key, F.col("text_hash").alias("hash_key"), "doc", "anchors")
    whole = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash().alias("text_hash"), "text")
    whole = whole.withColumn("id_key", id_key).withColumn("hash_key", F.col("text_hash"))
    whole = whole.join(listed.hint("shuffle_hash"), ["id_key", "hash_key"]).select("doc", "text", "anchors")
    rows = pin(_window_rows(whole, words), "windows", **BATCH)
    kept = rows.groupBy("digest").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("last_doc"))
    kept = pin(kept.filter("first.doc <> last_doc").select("digest", "first"), "kept-windows")
    found = rows.join(kept, "digest").filter("doc <> first.doc")
    found = found.select("doc", "at", "start", "end", F.col("first.doc").alias("first_doc"), (F.col("at") - F.col("first.at")).alias("shift"))
    # Written, so that the join's shuffled rows and those of the window below are not there at once.
    found = pin(found, "found-windows")
    # Windows one after the other have the same difference of place and rank; rows equal in all are one.
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("at"))
    runs = found.withColumn("run", F.col("at") - rank).groupBy("doc", "run", "first_doc", "shift")
    passages = runs.agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("at") - F.min("at") + words).cast("long").alias("words"))
    passages = passages.join(places.select("doc", "doc_id", "text_hash"), "doc")
    passages = passages.join(places.select(F.col("doc").alias("first_doc"), F.col("doc_id").alias("first_doc_id")), "first_doc")
    return passages.select("doc_id", "text_hash", "start", "end", "words", "first_doc_id")


def without_repeats(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text`` (and ``n_chars``, if there, counted anew).

    All rows stay, NULL texts too; a text that is one repeat is empty afterwards. What is left on both sides of a cut
    is joined by a line feed.
    """
    spans = repeats(documents, words).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = spans.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), F.col("text_hash").alias("hash_key"), "spans")
    kept = [F.col(f"`{c}`") for c in documents.columns]
    whole = documents.select(F.struct(*kept).alias("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), text_hash().alias("hash_key"))
    joined = whole.join(spans.hint("shuffle_hash"), ["id_key", "hash_key"], "left").select("doc.*", F.col("spans").alias("__spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = batch.schema.get_field_index("text")
            spans, texts = batch.column(batch.num_columns - 1), batch.column(at).to_pylist()
            for row in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                texts[row] = without(texts[row].encode(), [(s["start"], s["end"]) for s in spans[row].as_py()]).decode()
            batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                changed = [len(t) if v else n for n, v, t in zip(batch.column(at).to_pylist(), spans.is_valid().to_pylist(), texts)]
                batch = batch.set_column(at, "n_chars", pa.array(changed, batch.schema.field(at).type))
            yield batch.select(batch.schema.names[:-1])

    return joined.mapInArrow(cut, documents.schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text less the spans (sorted, maybe overlapping)."""
    kept, at = [], 0
    for start, end in spans:
        if start > at:
            kept.append(text[at:start].strip())
        at = max(at, end)
    kept.append(text[at:].strip())
    return b"\n".join(k for k in kept if k)


def repeat_digests(documents: DataFrame) -> DataFrame:
    """Query 1: every repeated passage, its document and the one that keeps it."""
    return repeats(documents).select("doc_id", "start", "end", "words", "first_doc_id")
