"""Source divergence audit: how differently the sources of a language use its words.

A language keeps the terms that enough of its documents have. The kept terms, sorted, become minimal acyclic
transducers (``transducer``), one for each range of terms, built where the range lies. Then all texts are streamed
through the transducers of their language: a term that is kept comes out as its ordinal, its place among the kept terms
by their bytes, and ordinals are what is counted, shuffled and, where values tie, compared. Transducers are sent to the
tasks as long as they fit a fixed number of bytes; if there are more, the texts are streamed once for each such load.

What two counts of a term differ by is computed for blocks of ordinals: a task holds the counts of one block in all
sources of a language, of which every source has one, if only 0. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postbag.llm.common import steps, utf8
from postbag.llm.transducer import Transducer, build
from postbag.session import pin

#: Documents of a language that a kept term is in; parts that shares are counted in; ranks of terms.
LEAST_DOCUMENTS, PARTS, RANKS = 3, 1_000_000_000, 200
#: Terms of one transducer; bytes of transducers that are sent to the tasks together; ordinals of a block.
RANGE_TERMS, LOAD_BYTES, BLOCK = 100_000, 64 << 20, 4096
#: Distinct keys that a task counts before it passes them on.
TALLIED = 1 << 21

#: Bytes of terms: letters, in lower case, and all of characters beyond ASCII; others part them.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def terms_of(data: np.ndarray, borders: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of rows of text, and the row of each."""
    rows = len(borders) - 1
    apart = np.full(len(data) + rows + 1, 32, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(borders))] = LETTERS[data]
    letter = apart != 32
    starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0], edges[1::2], edges[2::2] = 0, starts, ends
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(apart)])
    terms = both.take(pa.array(np.arange(1, 2 * len(starts), 2))).cast(pa.binary())
    return terms, np.searchsorted(borders + np.arange(1, rows + 2), starts, "right") - 1


def _coded_terms(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """Steps of rows (from, to) with their distinct terms, the number of the term at each place, and its row."""
    data, borders = utf8(batch.column(text))
    for low, high in steps(borders):
        terms, row = terms_of(data[borders[low] : borders[high]], borders[low : high + 1] - borders[low])
        coded = terms.dictionary_encode()
        yield low, high, coded.dictionary, coded.indices.to_numpy().astype(np.int64), row


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term and in how many documents it is; merged over a task's rows as far as they fit."""
    kept: list[pa.Table] = []

    def merged(most: int) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(kept).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])
        kept[:] = [table] if len(table) <= most else []
        if not kept:
            yield from table.to_batches(max_chunksize=1 << 16)

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of_row = langs.indices.to_numpy().astype(np.int64)
        for low, high, terms, codes, row in _coded_terms(batch, 1):
            once = np.unique(codes * (high - low) + row)
            code, row = once // (high - low), once % (high - low)
            pairs, n = np.unique(of_row[low + row] * max(len(terms), 1) + code, return_counts=True)
            lang = langs.dictionary.take(pa.array(pairs // max(len(terms), 1)))
            kept.append(pa.table({"lang": lang, "term": terms.take(pa.array(pairs % max(len(terms), 1))), "n": n}))
            if sum(map(len, kept)) > TALLIED // 4:
                yield from merged(TALLIED // 8)
    if kept:
        yield from merged(0)


def vocabulary(texts: DataFrame, least: int = LEAST_DOCUMENTS, range_terms: int = RANGE_TERMS) -> DataFrame:
    """A written table (lang, slot, term) of the kept terms; slots are ranges of (lang, term)."""
    counts = texts.select("lang", "text").mapInArrow(_document_counts, "lang string, term binary, n bigint")
    kept = pin(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"), "kept-terms")
    ranges = max(1, -(-kept.count() // range_terms))
    ranged = kept.repartitionByRange(ranges, "lang", "term") if ranges > 1 else kept
    slot = F.spark_partition_id() if ranges > 1 else F.lit(0)
    return pin(ranged.select("lang", slot.alias("slot"), "term"), "vocabulary")


def transducers(terms: DataFrame) -> DataFrame:
    """A written table of the transducer of each range: lang, slot, how many terms, size in bytes, and its arrays."""

    def made(table: pa.Table) -> pa.Table:
        column = table["term"].combine_chunks()
        column = column.take(pc.array_sort_indices(column)).cast(pa.large_binary())
        borders = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8)[borders[0] : borders[-1]]
        machine = build(data, borders - borders[0])
        arrays = [a.astype(t).tobytes() for a, t in ((machine.keys, np.int64), (machine.targets, np.int32), (machine.adds, np.int32), (machine.final, np.bool_))]
        size = sum(map(len, arrays))
        row = [table["lang"][0].as_py(), table["slot"][0].as_py(), len(column), size, *arrays]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, MACHINE)], schema=MACHINE)

    grouped = terms.groupBy("lang", "slot").applyInArrow(made, "lang string, slot int, terms bigint, bytes bigint, keys binary, targets binary, adds binary, final binary")
    return pin(grouped, "transducers")


MACHINE = pa.schema(
    [("lang", pa.string()), ("slot", pa.int32()), ("terms", pa.int64()), ("bytes", pa.int64()), *[(a, pa.binary()) for a in ("keys", "targets", "adds", "final")]]
)


def _loads(machines: DataFrame, most: int) -> tuple[dict[tuple[str, int], int], list[list[tuple[str, int]]]]:
    """The ordinal that each range begins with, and which ranges are sent to the tasks together."""
    sizes = machines.select("lang", "slot", "terms", "bytes").orderBy("lang", "slot").collect()  # one row a range
    firsts, so_far, loads, load = {}, {}, [], most + 1
    for r in sizes:
        firsts[r["lang"], r["slot"]] = so_far.get(r["lang"], 0)
        so_far[r["lang"]] = so_far.get(r["lang"], 0) + r["terms"]
        if load + r["bytes"] > most:
            loads.append([])
            load = 0
        loads[-1].append((r["lang"], r["slot"]))
        load += r["bytes"]
    return firsts, loads


class _Tally:
    """Counts by (group, ordinal), merged now and then."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Whether there are too many to keep."""
        self.keys.append(keys)
        self.counts.append(counts)
        if sum(map(len, self.keys)) <= TALLIED:
            return False
        self._merge()
        return len(self.keys[0]) > TALLIED // 2

    def _merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at.ravel(), np.concatenate(self.counts))
        self.keys, self.counts = [keys], [counts]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            self._merge()
            names = list(self.groups)
            keys, counts = self.keys[0], self.counts[0]
            group = pa.array(keys >> 40)
            for low in range(0, len(keys), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[i] for g in names], pa.string()).take(group[part]) for i in (0, 1)] + [pa.array(keys[part] & ((1 << 40) - 1)), pa.array(counts[part])],
                    ["lang", "source", "ordinal", "n"],
                )
        self.keys, self.counts = [], []


def _recount(machines) -> Batches:
    """lang, source, ordinal and how often the term occurs, for terms in the ``machines``, a broadcast list by language."""

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally = machines.value, _Tally()
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            group = np.array([tally.groups.setdefault(g, len(tally.groups)) for g in zip(langs, sources)], np.int64)
            for low, high, terms, codes, row in _coded_terms(batch, 2):
                words = terms.cast(pa.large_binary())
                borders = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8) if len(words) else np.zeros(1, np.int64)
                data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
                own = langs[low:high]
                for lang in set(own):
                    of_lang = np.array([name == lang for name in own])[row]
                    seen = np.unique(codes[of_lang])
                    # The distinct terms of the step, side by side, through one machine after the other.
                    lengths = borders[seen + 1] - borders[seen]
                    ends = np.append(0, np.cumsum(lengths))
                    packed = data[np.arange(ends[-1]) + np.repeat(borders[seen] - ends[:-1], lengths)]
                    place = np.full(len(words), -1, np.int64)
                    for first, machine in known.get(lang, []):
                        found = machine.ordinals(packed, ends)
                        place[seen[found >= 0]] = found[found >= 0] + first
                    ordinal = place[codes[of_lang]]
                    keys, n = np.unique((group[low + row[of_lang]] << 40 | ordinal)[ordinal >= 0], return_counts=True)
                    if tally.add(keys, n):
                        yield from tally.flush()
        yield from tally.flush()

    return recount


def term_counts(texts: DataFrame, machines: DataFrame, load_bytes: int = LOAD_BYTES) -> tuple[DataFrame, dict[tuple[str, int], int]]:
    """A written table (lang, source, ordinal, n) of the kept terms that occur; and the first ordinal of each range."""
    firsts, loads = _loads(machines, load_bytes)
    counts = None
    for load in loads:
        # As many bytes as a load may have, or one range.
        chosen = machines.filter(F.struct("lang", "slot").isin([F.struct(F.lit(lang), F.lit(slot)) for lang, slot in load])) if len(loads) > 1 else machines
        by_lang: dict[str, list] = {}
        for r in sorted(chosen.collect(), key=lambda r: r["slot"]):
            arrays = [np.frombuffer(r[name], kind) for name, kind in (("keys", np.int64), ("targets", np.int32), ("adds", np.int32), ("final", np.bool_))]
            by_lang.setdefault(r["lang"], []).append((firsts[r["lang"], r["slot"]], Transducer(*arrays)))
        shared = texts.sparkSession.sparkContext.broadcast(by_lang)
        found = texts.select("lang", "source", "text").mapInArrow(_recount(shared), "lang string, source string, ordinal bigint, n bigint")
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        return texts.sparkSession.createDataFrame([], "lang string, source string, ordinal bigint, n bigint"), firsts
    return pin(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "term-counts"), firsts


def _shares(counts: np.ndarray, total: int, kept: int, parts: int) -> np.ndarray:
    most = int(counts.max(initial=0)) + 1
    if most * parts < 2**63:
        return 1 + parts * (counts + 1) // (total + kept)
    return np.array([1 + parts * (int(c) + 1) // (total + kept) for c in counts], np.int64)


def _compared(ranks: int, parts: int) -> Batches:
    """For a block of ordinals: sums of f for each pair of sources, in two halves, and each source's highest f."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, kept, total = (batch.column(i)[row].as_py() for i in (0, 1, 2))
                sources, cells = batch.column(3)[row].values, batch.column(4)[row].values
                names, totals = sources.field(0), sources.field(1).to_numpy()
                ordinals, column = np.unique(cells.field(0).to_numpy(), return_inverse=True)
                line = pc.index_in(cells.field(1), value_set=names).to_numpy()
                counts = np.zeros((len(names), len(ordinals)), np.int64)
                counts[line, column.ravel()] = cells.field(2).to_numpy()
                p = np.stack([_shares(c, int(n), kept, parts) for c, n in zip(counts, totals)])
                q = _shares(counts.sum(0), total, kept, parts)
                for own in range(len(names)):
                    d = p[own] - p  # the other source's share is below the line
                    f = d * d // p
                    others = np.flatnonzero(np.arange(len(names)) != own)
                    yield _out(lang, names[own].as_py(), names.take(pa.array(others)), None, f[others] >> 32, f[others] & 0xFFFFFFFF)
                    d = p[own] - q
                    f = np.where((counts[own] > 0) & (d > 0), d * d // q, -1)
                    best = np.lexsort((ordinals, -f))[:ranks]
                    best = best[f[best] >= 0]
                    yield _out(lang, names[own].as_py(), None, ordinals[best], f[best, None] >> 32, f[best, None] & 0xFFFFFFFF)

    return compared


def _out(lang: str, source: str, items: pa.Array | None, ordinals: np.ndarray | None, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    n = len(high)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * n, pa.string()),
            pa.array([source] * n, pa.string()),
            pa.nulls(n, pa.string()) if items is None else items,
            pa.nulls(n, pa.int64()) if ordinals is None else pa.array(ordinals, pa.int64()),
            pa.array(high.sum(1)),
            pa.array(low.sum(1)),
        ],
        ["lang", "source", "item", "ordinal", "high", "low"],
    )


def _ranked(rows: DataFrame, tie: str, ranks: int | None = None) -> DataFrame:
    """With ``rank``, from 1 in each source of a language; a limit is applied in each task first."""
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), tie))
    ranked = rows.withColumn("rank", place)
    return ranked if ranks is None else ranked.filter(F.col("rank") <= ranks)


def divergences(
    documents: DataFrame,
    least: int = LEAST_DOCUMENTS,
    ranks: int = RANKS,
    parts: int = PARTS,
    range_terms: int = RANGE_TERMS,
    load_bytes: int = LOAD_BYTES,
    block: int = BLOCK,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and by which terms.

    NULL text, lang and source count as empty; texts without terms make their source one without counts. Repeated
    documents count as often as they come, doc_id and further columns play no part. Empty input gives no rows. A
    language without kept terms has pairs of value 0; one with a single source has no pairs.
    """
    texts = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = pin(texts.select("lang", "source").distinct(), "groups")
    terms = vocabulary(texts, least, range_terms)
    machines = transducers(terms)
    counts, firsts = term_counts(texts, machines, load_bytes)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("total"), F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"))
    kept = machines.groupBy("lang").agg(F.sum("terms").alias("kept"))
    of_lang = of_lang.join(kept, "lang").select("lang", "kept", "total", "sources")
    cell = F.struct("ordinal", "source", "n")
    blocks = counts.groupBy("lang", F.expr(f"ordinal div {block}").alias("block")).agg(F.collect_list(cell).alias("cells"))
    found = blocks.join(of_lang, "lang").select("lang", "kept", "total", "sources", "cells")
    found = pin(found.mapInArrow(_compared(ranks, parts), "lang string, source string, item string, ordinal bigint, high bigint, low bigint"), "divergences")

    whole: Callable[[str], Column] = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    value = (whole("high") * F.lit(1 << 32).cast("decimal(10,0)") + whole("low")).cast("bigint")
    sums = found.filter("item IS NOT NULL").groupBy("lang", "source", "item").agg(value.alias("value"))
    # The result itself: each source of a language with each other one.
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    pairs = _ranked(pairs, "item").select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    best = found.filter("ordinal IS NOT NULL").select("lang", "source", "ordinal", (F.col("high") * (1 << 32) + F.col("low")).alias("value"))
    best = _ranked(best, "ordinal", ranks)
    bases = documents.sparkSession.createDataFrame([(*k, v) for k, v in firsts.items()], "lang string, slot int, first bigint")
    inside = F.row_number().over(Window.partitionBy("lang", "slot").orderBy("term")) - 1
    named = terms.withColumn("inside", inside).join(F.broadcast(bases), ["lang", "slot"])  # one row a range
    named = named.select("lang", (F.col("first") + F.col("inside")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    best = best.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)


def divergence_digests(documents: DataFrame) -> DataFrame:
    """Query 13: divergences of all sources."""
    return divergences(documents)


_LETTERS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same in DuckDB: all counts written out, zeros too.
DIVERGENCE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS terms FROM documents
),
tokens AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
seen AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counts AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM groups JOIN kept USING (lang) LEFT JOIN seen USING (lang, source, term)),
shares AS (
  SELECT *, 1 + {PARTS}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p FROM counts JOIN sizes USING (lang)
),
whole AS (
  SELECT lang, term, 1 + {PARTS}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(v) AS v FROM shares GROUP BY lang, term)
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
),
best AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best)
QUALIFY part = 'pair' OR rank <= {RANKS}
"""
