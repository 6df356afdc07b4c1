"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

A piece matters to the packing only by its length, and there are no more lengths than a sequence has places. So the
pieces are counted by length, best-fit decreasing runs over the counts (a segment tree finds the tightest open
remaining capacity in logarithmic time), and what it decides is a table of rank intervals: pieces of length l with
ranks from a to b go to sequences s, s + 1, ... at offset o. Every piece then finds its place from its rank among
the pieces of its length, which is a prefix sum of counts per task. The result is that of best-fit decreasing over
all pieces, at any size; what the driver holds is bounded by the length of a sequence.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postbag.session import pin

LENGTH = 1024
END = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task string, rank bigint"
Encode = Callable[[str], np.ndarray]


@cache
def public_encoder(path: str | None = None) -> Encode:
    """Encodes a text as ``tokenizers`` does with ``byte_bpe_50k.json`` and ``add_special_tokens=False``.

    The ranks file holds the same vocabulary and gives the same ids four times as fast. It knows no special tokens, and
    its pattern backtracks, to a limit, over very long runs of white space: texts with either go to ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [token.content for token in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in special):
            try:
                return own.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def piece_lengths(tokens: int, most: int = LENGTH) -> list[int]:
    """Only a document longer than a sequence is cut; the first piece is then what is left over, if anything is."""
    if tokens <= most:
        return [tokens]
    return [tokens % most] * bool(tokens % most) + [most] * (tokens // most)


def pieces(documents: DataFrame, make_encoder: Callable[[], Encode] = public_encoder, most: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task.

    A NULL or empty text is the end token alone. Very long texts are tokenised whole, and alone.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = make_encoder(), uuid.uuid4().hex, defaultdict(int)
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                own, start = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4"), 0
                for piece, length in enumerate(piece_lengths(len(own), most)):
                    crc = zlib.crc32(own[start : start + length].tobytes())
                    for name, value in zip(NAMES, (doc_id.as_py(), piece, start, length, crc, task, seen[length]), strict=True):
                        out[name].append(value)
                    seen[length] += 1
                    start += length
            yield pa.RecordBatch.from_pydict({name: out[name] for name in NAMES}, PIECES_ARROW)

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tokenised, PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]
PIECES_ARROW = pa.schema([(n, {"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.int64())) for n, c in zip(NAMES, PIECES.split(", "), strict=True)])


class TightestFit:
    """Groups of equal open bins by remaining capacity; a segment tree says which capacities have any."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _count(self, capacity: int, change: int) -> None:
        at = self.leaves + capacity
        while at:
            self.open[at] += change
            at //= 2

    def add(self, capacity: int, first: int, bins: int) -> None:
        if capacity > 0 and bins > 0:
            self.groups[capacity].append((first, bins))
            self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Remove and return a group (capacity, first bin, bins) of the least capacity that is ``need`` or more."""
        at = self.leaves + need
        if not self.open[at]:
            while at > 1 and not (at % 2 == 0 and self.open[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._count(capacity, -1)
        return capacity, *self.groups[capacity].pop()


def best_fit(counts: dict[int, int], most: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` of pieces by length.

    Intervals (length, first rank, bins, first sequence, offset): the pieces with ranks from the first on go to
    consecutive sequences, at that offset. A piece goes to the open sequence with the least room that holds it, and
    so the next of the same length goes to the same one while it fits.
    """
    tree, intervals, sequences = TightestFit(most), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            group = tree.take(length)
            if group is None:
                fit = most // length
                bins = max(1, left // fit)
                capacity, first = most, sequences
                sequences += bins
            else:
                capacity, first, bins = group
                fit = capacity // length
            whole = min(bins, left // fit)
            for k in range(fit if whole else 0):
                intervals.append((length, rank, whole, first, most - capacity + k * length))
                rank += whole
            left -= whole * fit
            tree.add(capacity - fit * length, first, whole)
            if whole < bins:
                # What is left doesn't fill the next bin of the group.
                for k in range(left):
                    intervals.append((length, rank, 1, first + whole, most - capacity + k * length))
                    rank += 1
                tree.add(capacity - left * length, first + whole, 1)
                tree.add(capacity, first + whole + 1, bins - whole - 1)
                left = 0
    return intervals


def packed(documents: DataFrame, make_encoder: Callable[[], Encode] = public_encoder, most: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Repeated rows and NULL ids are documents of their own. Empty input gives no rows.
    """
    cut = pin(pieces(documents, make_encoder, most, end), "pieces")
    held = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``most`` rows
    intervals = best_fit(counts, most)
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for interval in intervals:
        by_length[interval[0]].append(interval)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "length"]).select(*NAMES[:5], (F.col("base") + F.col("rank")).alias("rank"))
    first_ranks = {length: [x[1] for x in xs] for length, xs in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True):
                _, start, _, first, at = by_length[length][bisect_right(first_ranks[length], rank) - 1]
                sequence.append(first + rank - start)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*NAMES[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
