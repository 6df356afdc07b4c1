"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

A document is a weighted set of shingles of five words. Every shingle throws darts, by hash alone: a Poisson process
over its weight and a rank. A document catches the darts that fall below its shingles' weights, in the order of
their ranks; each dart has a coordinate, and the first dart caught at a coordinate is the signature there. Two
documents agree at a coordinate with the probability of their weighted Jaccard similarity. About k log k darts are
looked at for k coordinates, however many shingles there are.

Texts that agree in all coordinates of a band share a bucket. Within a bucket texts are first compared with one leader.
Buckets that still hold several classes are then looked at in rounds: those of up to 128 texts in full, larger ones by
comparing all with leaders: with the texts outside the bucket's largest class, which ends the bucket, as no pair of
different classes is without one; while those are too many, with 64 times as many as in the round before. A comparison
is exact, on the shingle sets. Links become classes by spreading the least id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.llm.common import BATCH, SMALL_STEP_BYTES, Scratch, steps, utf8
from postbag.session import pin

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 4
COORDINATES = BANDS * BAND_ROWS
GROWTH = 64
#: So many texts outside the largest class of a bucket are leaders all at once, from the first round on.
OUTSIDE = 1024
#: Bands that two texts are to share for a comparison after the first round; of 24, at 0.8, fewer in 6 of 100,000 cases.
SHARED_BANDS = 2
#: Bytes of leaders that are broadcast at a time.
LOAD_BYTES = 16 << 20
#: Rows of ids and labels, some 60 bytes each, that are broadcast; more are joined by shuffling.
BROADCAST_IDS = 400_000
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64 bits that depend evenly on the 64 bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the bytes, and where each begins."""
    word = np.concatenate(([False], ~SPACE[data], [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * powers(_BASE, len(data))))
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]), starts


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One hash per run of ``width`` words; a shorter text is one shingle, a text without words none."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k]
    return mix(out + np.uint64(width))


def shingle_sets_of(words: np.ndarray, borders: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of word hashes: all their distinct shingles, the shingles' weights, and the borders of the rows in them.

    A weight is how often a shingle occurs if ``counted``, else 1.
    """
    n = np.diff(borders)
    rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(words) >= SHINGLE:
        row = np.repeat(np.arange(len(n)), n)[: len(words) - SHINGLE + 1]
        inside = np.arange(len(row)) + SHINGLE <= borders[row + 1]
        rows.append(row[inside])
        parts.append(shingle_hashes(words)[inside])
    for short in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        rows.append(np.array([short]))
        parts.append(shingle_hashes(words[borders[short] : borders[short + 1]]))
    row, shingles = np.concatenate(rows), np.concatenate(parts)
    # Apart by row: equal only for equal shingles of one row.
    _, first, counts = np.unique(mix(shingles ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    order = np.argsort(row[first], kind="stable")
    first, counts = first[order], counts[order]
    weights = counts.astype(float) if counted else np.ones(len(first))
    return shingles[first], weights, np.searchsorted(row[first], np.arange(len(n) + 1))


def signatures_of(kinds: np.ndarray, weights: np.ndarray, borders: np.ndarray, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Row by coordinate: the dart that is first there; and the total weight of each row. A row without weight has zeros."""
    rows = len(borders) - 1
    row = np.repeat(np.arange(rows), np.diff(borders))
    total = np.bincount(row, weights, rows)
    out = np.zeros(rows * k, np.uint64)
    open_, darts = total > 0, k * math.log(k) + 2 * k
    while open_.any():
        some = open_[row]
        found, darts_there = _caught(kinds[some], weights[some], row[some], darts / np.maximum(total, 1e-300), k)
        full = np.bincount(found // k, minlength=rows) == k
        done = (full & open_)[found // k]
        out[found[done]] = darts_there[done]
        open_ &= ~full
        darts *= 2
    return out.reshape(rows, k), total


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _caught(kinds: np.ndarray, weights: np.ndarray, row: np.ndarray, most_rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row times k plus coordinate) where darts were caught, in order, and the first dart at each."""
    ids, ranks, rows = [], [], []
    low, width, level = 0.0, 1.0, 0
    while (inside := weights > low).any():
        # Darts at weights from low to low + width come at this rate, in the order of their ranks.
        element, weight, own = mix(kinds[inside] + np.uint64(level)), weights[inside], row[inside]
        rank, throw = np.zeros(len(element)), 0
        while len(element):
            throw += 1
            dart = mix(element + np.uint64(throw * _BASE & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_unit(mix(dart + np.uint64(1)))) / width
            near = rank <= most_rank[own]
            element, weight, rank, dart, own = element[near], weight[near], rank[near], dart[near], own[near]
            hit = low + width * _unit(mix(dart + np.uint64(2))) < weight
            ids.append(dart[hit])
            ranks.append(rank[hit])
            rows.append(own[hit])
        level += 1
        low, width = low + width, max(1.0, low + width)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ids, ranks, rows = np.concatenate(ids), np.concatenate(ranks), np.concatenate(rows)
    order = np.argsort(ranks, kind="stable")
    ids = ids[order]
    places, first = np.unique(rows[order] * k + (ids % np.uint64(k)).astype(np.int64), return_index=True)
    return places, ids[first]


def band_keys(first_darts: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """Row by band: a hash of the darts in the band, and of the band."""
    out = np.zeros((len(first_darts), first_darts.shape[1] // rows), np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(_BASE) + first_darts[:, k::rows])
    return mix(out + np.arange(out.shape[1], dtype=np.uint64))


def _sets(column: pa.Array, counted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingle sets of the rows, some rows at a time."""
    data, borders = utf8(column)
    for low, high in steps(borders, SMALL_STEP_BYTES):
        yield shingle_sets_of(*word_hashes_apart(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low]), counted)


def word_hashes_apart(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several rows, none of which runs into the next, and the borders of the rows in them."""
    at = np.arange(len(data)) + np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    apart = np.full(len(data) + len(borders) - 1, 32, np.uint8)
    apart[at] = data
    hashes, starts = word_hashes(apart)
    return hashes, np.searchsorted(starts, borders + np.arange(len(borders)))


def signatures(documents: DataFrame, counted: bool = True) -> DataFrame:
    """(doc_id, text_id, n, bands) of every row: MD5 of the text, size of its shingle set, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for found in _sets(batch.column(2), counted):
                darts, total = signatures_of(*found)
                # Sets without shingles have no bands.
                bands = band_keys(darts)[total > 0].astype(np.int64).ravel()
                borders = np.append(0, np.cumsum(np.where(total > 0, BANDS, 0)))
                high = low + len(total)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], batch.column(1)[low:high], pa.array(total.astype(np.int32)), pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(bands))],
                    ["doc_id", "text_id", "n", "bands"],
                )
                low = high

    return with_text_id(documents).mapInArrow(sign, "doc_id bigint, text_id binary, n int, bands array<bigint>")


def id_key(name: str) -> Column:
    """A document's id as text; NULL is the empty text, so that it joins."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_text_id(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("bigint"), F.unhex(F.md5(text.cast("binary"))).alias("text_id"), text.alias("text"))


def shingle_sets(texts: DataFrame, counted: bool = True) -> DataFrame:
    """(text_id, shingles); the i-th occurrence of a shingle is an element of its own if ``counted``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for kinds, weights, borders in _sets(batch.column(1), counted):
                counts = weights.astype(np.int64)
                ends = np.append(0, np.cumsum(counts))
                nth = np.arange(ends[-1]) - np.repeat(ends[:-1], counts)
                flat = np.repeat(kinds, counts) + nth.astype(np.uint64)
                high = low + len(borders) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.ListArray.from_arrays(pa.array(ends[borders], pa.int32()), pa.array(flat.astype(np.int64)))], ["text_id", "shingles"])
                low = high

    return texts.select("text_id", "text").mapInArrow(sets, "text_id binary, shingles array<bigint>")


def joinable(table: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has few enough rows, as counted."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def least_labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(text_id, class) for all ends of ``links`` (a, b): the least id of the connected component.

    Each pass takes the least label among the neighbours' and then that label's own label, so long chains shrink
    geometrically. Everything stays in written tables; a pass over few enough labels shuffles the links alone.
    """
    both = scratch.pin(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.pin(both.groupBy(F.col("a").alias("text_id")).agg(F.least(F.min("b"), F.col("text_id")).alias("class")))
    while True:
        known = joinable(labels)
        near = both.join(known.withColumnRenamed("text_id", "b"), "b").groupBy(F.col("a").alias("text_id")).agg(F.min("class").alias("near"))
        step = near.join(known, "text_id").select("text_id", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        jump = known.select(F.col("text_id").alias("class"), F.col("class").alias("further"))
        found = scratch.pin(step.join(jump, "class", "left").select("text_id", "old", F.least("class", "further").alias("class")))
        labels = found.select("text_id", "class")
        if found.filter("old <> class").isEmpty():
            return labels


def joined_classes(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` after the classes at the ends of further links have become one; only those classes are looked at."""
    known = joinable(labels)
    of = lambda end: known.select(F.col("text_id").alias(end), F.col("class").alias(f"class_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).filter("a <> b").distinct()
    # What has no label yet is a class of its own.
    alone = links.select(F.explode(F.array("a", "b")).alias("text_id")).distinct().join(known, "text_id", "left_anti")
    every = labels.union(alone.select("text_id", F.col("text_id").alias("class")))
    merged = joinable(least_labels(scratch.pin(ends), scratch)).select(F.col("text_id").alias("class"), F.col("class").alias("joined"))
    return scratch.pin(every.join(merged, "class", "left").select("text_id", F.coalesce("joined", "class").alias("class")))


def alike(shingles: Column, others: Column, similarity: float) -> Column:
    """Whether two sets of shingles have the Jaccard similarity.

    Common elements are named once: an expression with lambdas would be interpreted, with boxed elements.
    """
    least = similarity - 1e-9
    return F.size(F.array_intersect(shingles, others)) * (1 + least) >= (F.size(shingles) + F.size(others)) * least


def classes_of(signed: DataFrame, documents: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, counted: bool = True) -> DataFrame:
    """(text_id, class) of the texts that have a near-duplicate; ``signed`` holds one row per different text."""
    members = signed.select("text_id", "n", "least_id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    # Buckets of several texts, and all their members: what every round starts from.
    order = F.xxhash64("text_id")
    members = scratch.pin(members.join(shared, "bucket").select("bucket", "m", "text_id", "n", "least_id", order.alias("order")))
    # A text has one set, from one of the documents that have it: copies don't meet in one place.
    wanted = members.select("text_id", id_key("least_id").alias("id_key")).distinct()
    texts = with_text_id(documents).withColumn("id_key", id_key("doc_id")).join(wanted.hint("shuffle_hash"), ["text_id", "id_key"], "left_semi")
    sets = scratch.pin(shingle_sets(texts.groupBy("text_id", "id_key").agg(F.first("text").alias("text")), counted))
    labels, leaders = None, 1
    while True:
        if labels is None:
            first = members.groupBy("bucket").agg(F.min(F.struct("order", "text_id", "n")).alias("l"))
            first = first.select("bucket", F.col("l.text_id").alias("text_id_a"), F.col("l.n").alias("n_a"))
            pairs = members.join(first, "bucket").filter((F.col("text_id_a") != F.col("text_id")) & near_in_size("n", "n_a", similarity))
            pairs = pairs.select(F.least("text_id_a", "text_id").alias("a"), F.greatest("text_id_a", "text_id").alias("b")).distinct()
            one = sets.select(F.col("text_id").alias("a"), F.col("shingles").alias("shingles_a"))
            two = sets.select(F.col("text_id").alias("b"), "shingles")
            found = scratch.pin(pairs.join(one, "a").join(two, "b").filter(alike(F.col("shingles"), F.col("shingles_a"), similarity)).select("a", "b"))
            labels = least_labels(found, scratch)
            leaders *= GROWTH
            continue
        here = members.join(joinable(labels), "text_id", "left").withColumn("class", F.coalesce("class", "text_id"))
        # Buckets of two have been looked at in full.
        each = here.filter("m > 2").groupBy("bucket", "class").agg(F.count("*").alias("c"))
        several = each.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "class")).alias("largest"))
        outside = F.col("all") - F.col("largest.c")
        several = scratch.pin(several.select("bucket", F.col("largest.class").alias("largest"), outside.alias("outside")).filter("outside > 0"))
        here = scratch.pin(here.join(joinable(several), "bucket"))
        if here.isEmpty():
            return labels
        details, parts = signed.select("text_id", "bands").join(sets, "text_id"), []
        if leaders == GROWTH:
            parts.append(links_in_small(here.filter(F.col("m") <= 2 * leaders).join(details, "text_id"), similarity))
            here = here.filter(F.col("m") > 2 * leaders)
        if not here.isEmpty():
            parts.append(links_with_leaders(here.join(details, "text_id"), leaders, similarity, scratch))
        found = reduce(DataFrame.union, parts)
        found = scratch.pin(found.distinct())
        if not found.isEmpty():
            labels = joined_classes(labels, found, scratch)
        # In all other buckets every pair of different classes has been compared.
        rest = several.filter(F.col("outside") > outside_at_once(leaders)).select("bucket")
        if rest.isEmpty():
            return labels
        members = members.join(joinable(rest), "bucket", "left_semi")
        leaders *= GROWTH


def near_in_size(n: str, other: str, similarity: float) -> Column:
    return F.least(n, other) >= F.greatest(n, other) * (similarity - 1e-9)


def comparable(x: Column, y: Column, bucket: Column, similarity: float) -> Column:
    """Whether two members of a bucket are to be compared in it: of different classes, near enough in size, and meeting
    in one of the buckets they share only."""
    common = F.array_intersect(x["bands"], y["bands"])
    sizes = F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * (similarity - 1e-9)
    return (x["class"] != y["class"]) & sizes & (F.size(common) >= SHARED_BANDS) & (F.get(common, F.lit(0)) == bucket)


MEMBER = ("text_id", "n", "class", "bands", "shingles")


def links_in_small(whole: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of buckets of bounded size: the members are gathered, and each pair is compared once, where they are."""
    gathered = whole.groupBy("bucket").agg(F.collect_list(F.struct(*MEMBER)).alias("members"))

    def partners(x: Column, at: Column) -> Column:
        later = F.slice(F.col("members"), at + 2, F.size("members"))
        linked = F.filter(later, lambda y: comparable(x, y, F.col("bucket"), similarity) & alike(x["shingles"], y["shingles"], similarity))
        return F.transform(linked, lambda y: F.struct(F.least(x["text_id"], y["text_id"]).alias("a"), F.greatest(x["text_id"], y["text_id"]).alias("b")))

    return gathered.select(F.explode(F.flatten(F.transform("members", partners))).alias("link")).select("link.*")


def outside_at_once(leaders: int) -> int:
    return max(OUTSIDE, 2 * leaders)


def links_with_leaders(whole: DataFrame, leaders: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) of large buckets: each member against the leaders, once if both are leaders.

    Leaders are the members outside the largest class; of a bucket with too many of these, about 2 * ``leaders``
    members by a hash of the text. They go to where the members are, in loads that fit a broadcast: however many
    members a bucket has, they are spread as the table is, and nothing is dealt out by bucket.
    """
    share = (F.col("order").cast("double") + 2.0**63) / 2.0**64
    leads = F.when(F.col("outside") <= outside_at_once(leaders), F.col("class") != F.col("largest")).otherwise(share * F.col("m") < 2 * leaders)
    whole = scratch.pin(whole.select("bucket", "order", *MEMBER, leads.alias("leads")))
    led = scratch.pin(whole.filter("leads").select("bucket", F.struct(*MEMBER).alias("leader"), F.col("order").alias("leader_order")))
    size = led.agg(F.sum(F.size("leader.bands") * 8 + F.size("leader.shingles") * 8 + 100)).first()[0] or 0
    loads = max(1, math.ceil(size / LOAD_BYTES))
    member, found = F.struct(*MEMBER), None
    for load in range(loads):
        part = led.filter(F.pmod(F.xxhash64("leader_order"), F.lit(loads)) == load) if loads > 1 else led
        met = whole.join(F.broadcast(part.select("bucket", "leader", "leader_order")), "bucket")
        x, y = F.col("leader"), member
        once = ~F.col("leads") | (F.struct(F.col("leader_order").alias("order"), "leader.text_id") < F.struct("order", "text_id"))
        linked = met.filter(once & comparable(x, y, F.col("bucket"), similarity) & alike(x["shingles"], F.col("shingles"), similarity))
        linked = linked.select(F.least(x["text_id"], F.col("text_id")).alias("a"), F.greatest(x["text_id"], F.col("text_id")).alias("b"))
        linked = scratch.pin(linked.distinct()) if loads > 1 else linked
        found = linked if found is None else found.union(linked)
    return found


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, counted: bool = True) -> DataFrame:
    """One row per document: doc_id, text_id, class_id, class_size, kept.

    The similarity is the weighted one of Jaccard: a shingle weighs as often as it occurs; with ``counted`` off, 1.
    A class holds all documents that are linked by similarities of ``similarity`` or more, directly or through others;
    equal texts are always in one class, NULL and empty texts too. class_id is its least doc_id (NULL, if none has
    one). ``kept`` marks the documents with the least text_id among those with that doc_id.
    """
    rows = pin(signatures(documents, counted), "signatures", **BATCH)
    scratch = Scratch(documents.sparkSession, "near-dups")
    texts = scratch.pin(rows.groupBy("text_id").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    labels = classes_of(texts, documents, scratch, similarity, counted)
    classed = texts.select("text_id", "least_id", "copies").join(labels, "text_id", "left").withColumn("class", F.coalesce("class", "text_id"))
    first = F.struct(F.col("least_id").isNull(), "least_id", "text_id")
    groups = classed.groupBy("class").agg(F.min(first).alias("first"), F.sum("copies").alias("class_size"))
    by_text = pin(classed.join(groups, "class").select("text_id", F.col("first.least_id").alias("class_id"), F.col("first.text_id").alias("kept_text"), "class_size"), "text-classes")
    scratch.drop()
    kept = (F.col("text_id") == F.col("kept_text")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.join(by_text, "text_id").select("doc_id", "text_id", "class_id", "class_size", kept.alias("kept"))


def near_duplicate_digests(documents: DataFrame) -> DataFrame:
    """Query 10: the class of every document."""
    return near_duplicates(documents).select("doc_id", "class_id", "class_size", "kept")


def keep_one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``documents`` with one row of each class: that with the least doc_id. Of rows equal in doc_id and text one stays."""
    kept = near_duplicates(documents, similarity).filter("kept").select(id_key("doc_id").alias("kept_id"), "text_id").distinct()
    text_id = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), id_key("doc_id").alias("kept_id"), text_id.alias("text_id"))
    found = whole.join(kept.hint("shuffle_hash"), ["kept_id", "text_id"], "left_semi")
    return found.groupBy("kept_id", "text_id").agg(F.first("doc").alias("doc")).select("doc.*")
