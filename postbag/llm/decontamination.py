"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, a window into the set of its shingles (a few consecutive
words each). A document holds a window if, in a stretch of as many words as the window has, it has at least a share of
the window's shingles; with a share of 1 the stretch has to be the window, word for word. Shingles are put in the order
of their rarity in the documents. A stretch with ``c`` of ``m`` shingles has one of the ``m - c + 1`` rarest, so these
prefixes alone are joined with the documents: at a share of 1 that is the rarest shingle of each window. A place where
a prefix shingle stands gives the stretch it would belong to by its place in the window; stretches that reach over an
end of the document are dropped before any words are read, and the words of the rest are compared.

Texts are normalised and written once. The shingles of all items are looked up in one pass over the written words;
what is found (place and hash) is written, and rarity, prefixes and candidates come from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.functions.text import let
from postbag.session import pin

#: Words of a window and of a shingle; share of a window's shingles that a stretch must have.
WINDOW, SHINGLE, CONTAINMENT = 10, 4, 1.0
#: Everything but words, of lower-cased text: runs of ASCII other than digits and letters.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What is joined of the items is broadcast if it has at most so many rows and bytes, as measured; else both sides are
#: shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The words of a text, A to Z in lower case, with one blank between them; NULL has none."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NO_WORD, " "))
    # lower() would also change other letters; where there are none it is several times as fast.
    return let(spaced, lambda s: F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, CAPITALS, SMALL)))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash of each ``size`` consecutive words; none if there are fewer.

    Hashes of two overlapping or adjoining shorter shingles are hashed together, so that a few walks do for any size.
    """
    hashes, have = F.transform(words, lambda w: F.xxhash64(w)), 1
    while have < size:
        step = min(have, size - have)
        hashes, have = let(hashes, _doubled(step)), have + step
    return hashes


def _doubled(step: int) -> Callable[[Column], Column]:
    def joined(shorter: Column) -> Column:
        left = F.greatest(F.size(shorter) - step, F.lit(0))
        return F.zip_with(F.slice(shorter, F.lit(1), left), F.slice(shorter, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b))

    return joined


def hashes_of_size(words: Column, size: Column, sizes: list[int]) -> Column:
    return F.coalesce(*[F.when(size == k, shingle_hashes(words, k)) for k in sizes])


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, words, size, window) of every distinct window of every item; ``size`` is the words of its shingles,
    ``window`` a digest that equal windows have in common."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(normalised(F.col("text"))).alias("all"))
    words = words.filter(F.size("all") > 0)
    cut = F.expr(f"transform(sequence(1, greatest(1, size(all) - {window - 1})), i -> slice(all, i, {window}))")
    cut = words.select("item", F.explode(F.array_distinct(cut)).alias("words"))
    key = F.sha2(F.array_join("words", " ").cast("binary"), 256)
    return cut.select("item", "words", F.least(F.size("words"), F.lit(shingle)).alias("size"), key.alias("window"))


def _joinable(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df.hint("merge")


def candidates(rows: DataFrame, windows: DataFrame, sizes: list[int], small: bool, containment: float) -> DataFrame:
    """(row, window, starts): where documents may hold a window, by the rarest shingles of each window."""
    shingles = windows.select(
        "window", "size", F.size("words").alias("len"), F.posexplode(hashes_of_size(F.col("words"), F.col("size"), sizes)).alias("at", "hash")
    )
    # Places of all items' shingles in all documents. The words stay behind: a row is a number and a hash.
    own = [
        rows.select("row", "n_words", F.posexplode(shingle_hashes(words_of(F.col("norm")), k)).alias("pos", "hash")).withColumn("size", F.lit(k))
        for k in sizes
    ]
    places = own[0]
    for more in own[1:]:
        places = places.unionByName(more)
    places = pin(places.join(_joinable(shingles.select("size", "hash").distinct(), small), ["size", "hash"]), "shingle-places")
    # Rarity: how often a shingle occurs in the documents. A window with one that never does can be held in part only.
    counts = places.groupBy("size", "hash").agg(F.count("*").alias("seen"))
    rare = shingles.join(_joinable(counts, small), ["size", "hash"], "left").select("window", "size", "len", "at", "hash", F.coalesce("seen", F.lit(0)).alias("seen"))
    in_order = F.array_sort(F.collect_list(F.struct("seen", "hash", "at")))
    ordered = rare.groupBy("window", "size", "len").agg(in_order.alias("found"))
    ordered = ordered.withColumn("kinds", F.expr("array_distinct(transform(found, s -> s.hash))"))
    need = F.ceil(F.size("kinds") * F.lit(containment))
    prefix = F.slice("kinds", F.lit(1), (F.size("kinds") - need + 1).cast("int"))
    lead = F.explode(F.filter("found", lambda s: F.array_contains(F.col("prefix"), s["hash"])))
    prefixes = ordered.withColumn("prefix", prefix).select("window", "size", "len", lead.alias("s")).filter("s.seen > 0")
    prefixes = prefixes.select("window", "size", "len", F.col("s.at").alias("at"), F.col("s.hash").alias("hash"))

    joined = places.join(_joinable(prefixes, small), ["size", "hash"])
    if containment >= 1:
        # All words stand where the window has them, so one place tells where the stretch begins.
        starts = joined.withColumn("start", F.col("pos") - F.col("at"))
    else:
        lowest = F.greatest(F.lit(0), F.col("pos") + F.col("size") - F.col("len"))
        highest = F.least(F.col("pos"), F.col("n_words") - F.col("len"))
        joined = joined.withColumns({"lowest": lowest, "highest": highest}).filter("lowest <= highest")
        starts = joined.withColumn("start", F.explode(F.sequence("lowest", "highest")))
    starts = starts.filter("start >= 0 AND start + len <= n_words")
    # A document's places are at most as many as its words for each window.
    return starts.groupBy("row", "window").agg(F.collect_set("start").alias("starts"))


def found_windows(
    rows: DataFrame, windows: DataFrame, sizes: list[int], small: bool, containment: float = CONTAINMENT
) -> DataFrame:
    """(row, window, start, len): the stretches of documents that hold a window, each once.

    ``rows`` is a written table (row, n_words, norm), ``windows`` one of (window, words, size), in which a window is
    there once; ``sizes`` are the sizes of shingles that occur, ``small`` says that windows may be broadcast.
    """
    asked = candidates(rows, windows, sizes, small, containment).join(_joinable(windows, small), "window")
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("window", "words", "size", "starts")).alias("asked"))

    def held(words: Column) -> Column:
        def at(w: Column, start: Column) -> Column:
            stretch = F.slice(words, start + 1, F.size(w["words"]))
            if containment >= 1:
                return stretch == w["words"]
            wanted = F.array_distinct(hashes_of_size(w["words"], w["size"], sizes))
            enough = lambda m: F.size(F.array_intersect(m, hashes_of_size(stretch, w["size"], sizes))) >= F.ceil(F.size(m) * F.lit(containment))
            return let(wanted, enough)

        def of(w: Column) -> Column:
            found = F.filter(w["starts"], lambda s: at(w, s))
            return F.transform(found, lambda s: F.struct(w["window"].alias("window"), s.alias("start"), F.size(w["words"]).alias("len")))

        return F.flatten(F.transform(F.col("asked"), of))

    # Both grow with the documents: they meet by shuffling at every size.
    checked = rows.select("row", "norm").join(asked.hint("shuffle_hash"), "row")
    return checked.select("row", F.explode(let(words_of(F.col("norm")), held)).alias("s")).select("row", "s.*")


def covered(spans: Column) -> Column:
    """How many places an array of (start, end), sorted, covers."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    add = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")
    )
    return F.aggregate(spans, zero, add, lambda a: a["n"])


def contamination(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start and end, in words) and items of every document.

    ``n_hit`` words lie in a stretch that holds a window of an item; ``items`` are the ids, as sorted strings, of items
    with such a window. Items of fewer words than ``window`` are one window. NULL, empty and wordless texts have no
    words; such items have no window. Repeated documents come as often as they are given. Several items may have one
    id, which then counts once; a NULL id is the empty string. Further columns of either table play no part.
    """
    norm = documents.select("doc_id", normalised(F.col("text")).alias("norm"))
    n_words = F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "))) + 1)
    rows = pin(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), "norm"), "words")
    of_items = pin(item_windows(items, window, shingle), "item-windows")
    seen = of_items.agg(F.collect_set("size").alias("sizes"), F.count("*").alias("n"), F.sum(F.length(F.array_join("words", " ")) + F.length("item") + 120).alias("bytes")).first()
    # A window has fewer shingles than words, and what is joined of them is smaller than the windows themselves.
    small = seen["n"] * window <= BROADCAST_ROWS and (seen["bytes"] or 0) <= BROADCAST_BYTES
    shown = ["doc_id", F.col("n_words").cast("bigint").alias("n_words")]
    spans = "array<struct<start: int, end: int>>"
    if not seen["n"]:
        none = {"n_hit": F.lit(0).cast("bigint"), "spans": F.array().cast(spans), "items": F.array().cast("array<string>")}
        return rows.select(*shown, *[c.alias(name) for name, c in none.items()])
    # A window that several items have is looked for once.
    windows = of_items.groupBy("window").agg(F.first("words").alias("words"), F.first("size").alias("size"))
    found = pin(found_windows(rows, windows, sorted(seen["sizes"]), small, containment), "found-windows")
    named = found.select("row", "window").distinct().join(_joinable(of_items.select("window", "item"), small), "window")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = found.select("row", F.struct("start", (F.col("start") + F.col("len")).alias("end")).alias("span"))
    hit = hit.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    out = rows.select("row", *shown).join(hit, "row", "left").join(named, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast(spans)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contamination_digests(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Query 11: how much of each document lies in windows of ten words that a benchmark item has too."""
    found = contamination(documents, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same in DuckDB: all windows of all documents joined with those of the items.
CONTAMINATION_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS n, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - {WINDOW - 1}) + 1)) AS i FROM items WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
own AS (
  SELECT row, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)
),
hits AS (SELECT row, own.n, i, item FROM own JOIN windows USING (win, n)),
places AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS place FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (row) LEFT JOIN named USING (row)
"""
