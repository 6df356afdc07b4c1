"""Prediction by partial matching over bytes, with frozen statistics.

A model is a trie of byte contexts up to a length ``order``, with counts of the bytes that followed: how often in the
longest contexts, and in the shorter ones in how many contexts one byte longer (update exclusion). A byte is coded
in the longest context that is known; if it was never seen there, an escape leads to the next shorter one, where the
bytes of the longer context are excluded. In a context with n counted bytes, d of them distinct, a byte counted c
times has probability (c - D) / n and the escape d D / n, where D is the discount. After the empty context come all bytes not seen at all,
evenly. What a byte costs depends on it and the ``order`` bytes before it alone, so costs are tabulated for the
grams of order + 1 bytes that the trie holds, and all others are worked out in bulk.

Counting is a Spark aggregation. In a trie that tasks hold (``Model``) a gram stays if it has at least the share
``least_share`` of all counts: such a trie has at most 1 / least_share grams of each length. ``costs`` keeps every gram:
the grams lie in a table dealt by the last bytes of their contexts, where all longer contexts are together, and each
task works out what the grams asked of it cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.session import pin

#: What every distinct byte of a context leaves to the escape.
DISCOUNT = 0.3
#: Distinct grams that a counting task holds before it passes their counts on.
HELD_GRAMS = 1_000_000
#: Of HELD_GRAMS, a task that prices grams holds one part in so many at a time: a trie has many more columns than counts have.
PRICED_SHARE = 4
#: Bytes of grams short enough for every task to hold all of them.
SHORT = 3


def padded(data: np.ndarray, borders: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram (order + 1 bytes, the last one lowest) that ends at each byte; rows begin after zero bytes."""
    lengths = np.diff(borders)
    at = np.arange(len(data)) + np.repeat(order * np.arange(1, len(lengths) + 1), lengths)
    wide = np.zeros(len(data) + order * (len(lengths) + 1), np.uint64)
    wide[at] = data
    grams = np.zeros(len(wide) - order, np.uint64)
    for back in range(order, -1, -1):
        grams = (grams << np.uint64(8)) | wide[order - back : len(wide) - back]
    return grams[at - order]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = counts[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


class GramCounter:
    """Counts grams over many calls; gives its counts away when it holds too many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, grams: np.ndarray) -> None:
        keys, counts = np.unique(grams, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.held += len(keys)
        if self.held > HELD_GRAMS:
            self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            # What is joined goes before it is sorted: workers keep what they once held.
            keys = [k for k, _ in self.parts]
            counts = [c for _, c in self.parts]
            self.parts = []
            self.parts = [merged(joined(keys), joined(counts))]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > HELD_GRAMS

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        return out


def trie_counts(grams: DataFrame, order: int, least_share: float, by: list[str]) -> DataFrame:
    """(by, length, gram, n) of all grams of 1 to order + 1 bytes that reach the least share of their model's counts.

    ``grams``: by, gram, n, maybe several rows for a gram; n sums to the length of the text. The counts of the
    longest grams are those; a shorter gram counts by the bytes that were found before it (update exclusion).
    """
    level = pin(grams.groupBy(*by, "gram").agg(F.sum("n").alias("n"), F.sum("n").alias("kinds")), "grams")
    totals = level.groupBy(*by).agg(F.sum("n").alias("total"))
    levels = []
    for length in range(order + 1, 0, -1):
        if length <= order:
            shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * length) - 1)).alias("gram")
            level = pin(level.groupBy(*by, shorter).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "grams")
        levels.append(level.select(*by, F.lit(length).alias("length"), "gram", "n", "kinds"))
    every = reduce(DataFrame.unionByName, levels)
    kept = every.join(totals, by) if by else every.crossJoin(F.broadcast(totals))  # a single row
    return kept.filter(F.col("n") >= F.col("total") * least_share).select(*by, "length", "gram", F.col("kinds").alias("n"))


class Trie:
    """Context statistics of one model, from counts by gram length (1 to order + 1); the first lengths may be those of ``short``."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], short: Trie | None = None):
        self.levels = list(short.levels) if short else []
        above = self.levels[-1][:2] if self.levels else None
        for length, (keys, counts) in enumerate(levels, len(self.levels) + 1):
            sort = np.argsort(keys)
            keys, counts = keys[sort].astype(np.uint64), counts[sort].astype(np.float64)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            ends = np.append(first[1:], len(keys))
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            shadow = np.zeros(len(contexts))
            if above is not None and len(first):
                # Counts, one context shorter, of the bytes seen in this context: excluded there after an escape.
                at = np.searchsorted(above[0], keys & np.uint64((1 << 8 * (length - 1)) - 1))
                shadow = np.add.reduceat(above[1][at], first)
            self.levels.append((keys, counts, contexts, total, (ends - first).astype(np.float64), shadow))
            above = (keys, counts)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram, whatever it is."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        hidden, hidden_kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for length in range(len(self.levels), 0, -1):
            keys, counts, contexts, total, kinds, shadow = self.levels[length - 1]
            if not len(contexts) or not len(open_):
                continue
            own = grams[open_] & np.uint64((1 << 8 * length) - 1)
            at = np.minimum(np.searchsorted(contexts, own >> np.uint64(8)), len(contexts) - 1)
            known = contexts[at] == own >> np.uint64(8)
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            n = total[at] - hidden[open_]
            d = kinds[at] - hidden_kinds[open_]
            hit = known & (keys[place] == own)
            out[open_[hit]] -= np.log2((counts[place[hit]] - DISCOUNT) / n[hit])
            miss = known & ~hit
            escape = miss & (d > 0)
            out[open_[escape]] -= np.log2(d[escape] * DISCOUNT / n[escape])
            hidden[open_[miss]], hidden_kinds[open_[miss]] = shadow[at[miss]], kinds[at[miss]]
            open_ = open_[~hit]
        seen = len(self.levels[0][0]) if self.levels else 0
        out[open_] += np.log2(256 - seen)
        return out


class GramTable:
    """The place of each of some distinct grams; a table of places with open addresses, at most half full."""

    def __init__(self, grams: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(grams)).bit_length()))
        self.keys = np.append(grams, np.uint64(0xFFFFFFFFFFFFFFFF))  # the last one stands for free slots
        self.rows = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, slot = np.arange(len(grams)), self._slot(grams)
        while len(left):
            free = self.rows[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            self.rows[taken] = left[free][first]
            wait = self.rows[slot] != left
            left, slot = left[wait], (slot[wait] + 1) % len(self.rows)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places of ``grams``, or -1."""
        slot = self._slot(grams)
        rows = self.rows[slot]
        look = np.flatnonzero((self.keys[rows] != grams) & (rows >= 0))
        slot = slot[look]
        rows[look] = -1
        while len(look):
            slot = (slot + 1) % len(self.rows)
            own = self.rows[slot]
            same = self.keys[own] == grams[look]
            rows[look[same]] = own[same]
            on = ~same & (own >= 0)
            look, slot = look[on], slot[on]
        return rows


class Model:
    """Several tries that code the same text, with a table of the grams they hold."""

    def __init__(self, counts: list[list[tuple[np.ndarray, np.ndarray]]], order: int):
        self.order = order
        self.tries = [Trie(levels) for levels in counts]
        grams = [t.levels[order][0] for t in self.tries if len(t.levels) > order]
        grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.table = GramTable(grams)
        self.cost = np.stack([t.bits(grams) for t in self.tries], axis=1) if self.tries else np.zeros((0, 0))
        self.cost = np.vstack([self.cost, np.zeros((1, len(self.tries)))])  # the last row is for grams not held

    def bits(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Code length of each row under each trie."""
        grams = padded(data, borders, self.order)
        rows = self.table.find(grams)
        costs = self.cost[rows]
        odd = np.flatnonzero(rows < 0)
        if len(odd):
            kinds, which = np.unique(grams[odd], return_inverse=True)
            costs[odd] = np.stack([t.bits(kinds) for t in self.tries], axis=1)[which]
        out = np.zeros((len(borders) - 1, len(self.tries)))
        full = np.flatnonzero(np.diff(borders) > 0)
        if len(full):
            out[full] = np.add.reduceat(costs, borders[full], axis=0)
        return out


def short_levels(counts: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts by gram length up to SHORT, or ``order`` if that is less, from (gram, n) of all longest grams.

    At most 256 ** SHORT grams, of any corpus.
    """
    short = min(SHORT, order)
    if not short:
        return []
    longer, own = (F.lit((1 << 8 * k) - 1) for k in (short + 1, short))
    kinds = counts.select(F.col("gram").bitwiseAND(longer).alias("gram")).distinct()
    table = kinds.groupBy(F.col("gram").bitwiseAND(own).alias("gram")).count().toArrow()
    levels = [(table["gram"].to_numpy().astype(np.uint64), table["count"].to_numpy())]
    for length in range(short - 1, 0, -1):
        levels.insert(0, _shorter(levels[0][0], length))
    return levels


def _shorter(grams: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``length`` bytes, and how many of the distinct ``grams`` end in each."""
    return np.unique(grams & np.uint64((1 << 8 * length) - 1), return_counts=True)


def costs(counts: DataFrame, asked: DataFrame, levels: list[tuple[np.ndarray, np.ndarray]], order: int) -> DataFrame:
    """gram, bits of every row of ``asked`` (gram) by all grams of ``counts`` (gram, n; distinct grams of order + 1 bytes).

    Grams whose contexts end in the same bytes are dealt to the same task, which then has the whole of their longer
    contexts; there are at most 256 ** (order + 1 - SHORT) of them. The ``levels`` of shorter grams come from ``short_levels``.
    """
    short = min(SHORT, order)
    shared = counts.sparkSession.sparkContext.broadcast(levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = Trie(shared.value)

        def priced(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            known = n > 0
            longer = [(grams[known], n[known])]
            for length in range(order, short, -1):
                longer.insert(0, _shorter(longer[0][0], length))
            wanted = grams[~known]
            return pa.RecordBatch.from_arrays([pa.array(wanted.astype(np.int64)), pa.array(Trie(longer, below).bits(wanted))], ["gram", "bits"])

        least = HELD_GRAMS // PRICED_SHARE
        parts, held, most = [], 0, least
        for batch in batches:
            parts.append((batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held > most:
                grams, n = (np.concatenate(x) for x in zip(*parts))
                # The last context may go on in the next batch.
                ends = (grams >> np.uint64(8)) & np.uint64((1 << 8 * short) - 1)
                whole = int(np.flatnonzero(ends != ends[-1])[-1]) + 1 if (ends != ends[-1]).any() else 0
                if whole:
                    yield priced(grams[:whole], n[:whole])
                parts, held = [(grams[whole:].copy(), n[whole:].copy())], len(grams) - whole
                # A context of many grams is not joined again with every batch.
                most = max(least, 2 * held)
        if held:
            yield priced(*(np.concatenate(x) for x in zip(*parts)))

    rows = counts.select("gram", "n").unionByName(asked.select("gram", F.lit(0).cast("bigint").alias("n")))
    rows = rows.withColumn("ends", F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * short) - 1)))
    dealt = rows.repartition("ends").sortWithinPartitions("ends").select("gram", "n")
    return dealt.mapInArrow(work, "gram bigint, bits double")


def levels_of(table: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts by gram length from rows (length, gram, n)."""
    length, gram, n = (table[c].to_numpy() for c in ("length", "gram", "n"))
    return [(gram[length == k].astype(np.uint64), n[length == k]) for k in range(1, order + 2)]


def counted(batches: Iterator[tuple[str | None, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches (name, gram, n) of gram counts from (name, grams)."""
    counters: dict[str | None, GramCounter] = {}

    def out(name: str | None, counter: GramCounter) -> pa.RecordBatch:
        keys, counts = counter.drain()
        return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names)

    for name, grams in batches:
        counter = counters.setdefault(name, GramCounter())
        counter.add(grams)
        if counter.full():
            yield out(name, counter)
    for name, counter in counters.items():
        yield out(name, counter)
