"""Document fingerprints by I-Match.

Terms whose document frequency lies within a band (neither everywhere nor only here) make up the lexicon. A
document's terms in the lexicon, sorted, give one hash; its terms in each of several random parts of the lexicon
give one hash more. Parts of several sizes are drawn, so that for documents of any length there are parts that hold
only few of their terms and so outlive an edit. How many of the hashes two documents have in common is their likeness.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postbag.operators.packing import range_of
from postbag.session import pin

#: Least and most document frequency of a lexicon term, as shares of all documents; and the least in documents.
LEAST_SHARE, MOST_SHARE, LEAST = 0.001, 0.1, 2
#: Random parts of the lexicon: so many for each share of its terms.
SHARES, OF_EACH = (8, 16, 32, 64, 128, 256), 8
#: The number of the whole lexicon among its parts.
WHOLE = -1
TERM = r"[\p{L}\p{N}]+"
#: Lexicon terms that are broadcast, some 100 bytes each; a larger lexicon is joined by shuffling.
BROADCAST_TERMS = 500_000
#: Documents of a block in the order of ids; most blocks, beyond which they get larger: a key of each is sent to all
#: tasks, and what a task does with a block may spill.
BLOCK_ROWS, MOST_BLOCKS = 1024, 10_000


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def lexicon(documents: DataFrame, n: int) -> DataFrame:
    """(term, parts): the terms in the band, and the parts of the lexicon they are in; WHOLE is the whole lexicon."""
    counts = documents.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").count()
    band = counts.filter((F.col("count") >= max(LEAST, LEAST_SHARE * n)) & (F.col("count") <= max(LEAST, MOST_SHARE * n)))
    inside = [
        F.when(F.conv(F.substring(F.md5(F.concat("term", F.lit(f"#{i}")).cast("binary")), 1, 8), 16, 10).cast("bigint") < (1 << 32) // share, i)
        for i, share in enumerate(s for s in SHARES for _ in range(OF_EACH))
    ]
    return band.select("term", F.array_compact(F.array(F.lit(WHOLE), *inside)).alias("parts"))


def fingerprint(hashes: Column, text_key: Column) -> Column:
    """The hash of all terms and of those in each part, parted by ``-``, from a map of the hashes by part.

    Parts without terms are empty. A text without lexicon terms has the hash of the text alone.
    """
    every = F.sequence(F.lit(WHOLE), F.lit(len(SHARES) * OF_EACH - 1))
    listed = F.transform(every, lambda i: F.coalesce(F.try_element_at(hashes, i), F.lit("")))
    return F.when(F.size(hashes) > 0, F.array_join(listed, "-")).otherwise(text_key)


def likeness(one: Column, two: Column) -> Column:
    """1 for equal fingerprints, else the share of equal hashes among the parts that have a term in either."""
    pairs = F.arrays_zip(F.split(one, "-").alias("a"), F.split(two, "-").alias("b"))
    value = lambda x: F.coalesce(x, F.lit(""))
    some = F.size(F.filter(pairs, lambda p: (value(p["a"]) != "") | (value(p["b"]) != "")))
    same = F.size(F.filter(pairs, lambda p: (value(p["a"]) != "") & (value(p["a"]) == value(p["b"]))))
    return F.when(one == two, 1.0).otherwise(same.cast("double") / some)


def _fingerprints(rows: DataFrame, keys: list[str], carried: list[str], texts: dict[str, str], words: DataFrame) -> DataFrame:
    """A fingerprint for each text column of ``rows``, beside ``keys``, which tell rows apart, and ``carried`` columns.

    Terms are looked up and grouped by key and part. If the rows are partitioned by a key, nothing is shuffled for that.
    """

    def of(which: int, column: str) -> Column:
        return F.transform(terms(F.col(column)), lambda term: F.struct(F.lit(which).alias("which"), term.alias("term")))

    each = [of(which, column) for which, column in enumerate(texts)]
    # One pair more for each row: rows without terms stay, and what is carried is there once.
    pairs = F.concat(F.array(F.struct(F.lit(-1).alias("which"), F.lit("").alias("term"))), *each)
    md5s = [F.substring(F.md5(F.col(column).cast("binary")), 1, 12).alias(f"{name}_key") for column, name in texts.items()]
    carried = [*carried, *[f"{name}_key" for name in texts.values()]]
    exploded = rows.select("*", *md5s).select(*keys, *carried, F.explode(pairs).alias("pair"))
    exploded = exploded.select(*keys, *[F.when(F.col("pair.which") < 0, F.col(c)).alias(c) for c in carried], "pair.*")
    hit = exploded.join(words, "term", "left").filter("which < 0 OR parts IS NOT NULL")
    # A row per term and part: a document's terms are grouped by part, not looked through for each part.
    by_part = hit.select(*keys, *carried, "which", "term", F.explode_outer("parts").alias("part")).groupBy(*keys, "which", "part")
    once = [F.first(c, ignorenulls=True).alias(c) for c in carried]
    joined = F.array_join(F.sort_array(F.collect_list("term")), " ")
    hashed = by_part.agg(F.substring(F.md5(joined.cast("binary")), 1, 8).alias("hash"), *once)
    found = hashed.groupBy(*keys).agg(
        *[F.map_from_entries(F.collect_list(F.when(F.col("which") == which, F.struct("part", "hash")))).alias(f"{name}_hashes") for which, name in enumerate(texts.values())],
        *once,
    )
    shown = [c for c in carried if not c.endswith("_key")]
    return found.select(*keys, *shown, *[fingerprint(F.col(f"{name}_hashes"), F.col(f"{name}_key")).alias(name) for name in texts.values()])


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint) of every row; NULL texts count as empty."""
    n = documents.count()
    # Equal rows are told apart by a number.
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _fingerprints(rows, ["row"], ["doc_id", "text"], {"text": "fingerprint"}, _for_join(lexicon(documents, n))).drop("row")


def _for_join(words: DataFrame) -> DataFrame:
    words = pin(words, "lexicon")
    return F.broadcast(words) if words.count() <= BROADCAST_TERMS else words


#: Documents follow each other by falling id, NULL ids last, equal ones by the MD5 of the text.
PLACE = {"without": "doc_id IS NULL", "falling": "~doc_id", "text_md5": "md5(CAST(text AS BINARY))"}
KEY = "struct<without: boolean, falling: bigint, text_md5: string>"


def _place() -> list[Column]:
    return [F.expr(rule).alias(name) for name, rule in PLACE.items()]


def _blocks(rows: DataFrame) -> tuple[int, list[dict]]:
    """How many rows there are, and the first key of each block in their order. Keys alone are written and sorted."""
    keys = pin(rows.select(*_place()), "fingerprint-keys")
    n = keys.count()
    blocks = max(1, min(MOST_BLOCKS, math.ceil(n / BLOCK_ROWS)))
    ranged = keys.repartitionByRange(blocks, *PLACE) if blocks > 1 else keys.coalesce(1)
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(*PLACE)).alias("first"))
    # One row for each block, of which there are MOST_BLOCKS at most.
    return n, [{"key": r["key"]} for r in firsts.orderBy("first").select(F.to_json("first", {"ignoreNullFields": "false"}).alias("key")).collect()]


def fingerprint_digests(documents: DataFrame) -> DataFrame:
    """Query 9: fingerprints of every text and of its edited text, and how like they and the next document's are.

    Documents follow each other by descending id, equal ids by the MD5 of the text, NULL ids last; after the last
    comes the first. They are cut into blocks in that order, however many have one id or none (only equal rows can't be
    parted). A text moves once, to its block: there its successor is, its terms are looked up in the lexicon, and its
    hashes are made.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, bounds = _blocks(rows)
    if not n:
        return documents.sparkSession.createDataFrame([], DIGESTS)
    words = _for_join(lexicon(documents, n))
    key_type = T._parse_datatype_string(KEY)
    before = [{"before": (k - 1) % len(bounds), "key": bound["key"]} for k, bound in enumerate(bounds)]
    keys = documents.sparkSession.createDataFrame([(b["before"], b["key"]) for b in before], "before int, key string")
    keys = keys.select("before", F.from_json("key", key_type).alias("key")).select("before", "key.*")
    placed = rows.select("*", *_place())
    same = [placed[name].eqNullSafe(keys[name]) for name in PLACE]
    firsts = placed.join(F.broadcast(keys), same).dropDuplicates(["before"])
    # A block has the first document of the next one as a guest, behind its own.
    guests = firsts.select("doc_id", "text", F.col("before").alias("block"), F.lit(True).alias("guest"))
    block = range_of(F.struct(*_place()), bounds, key_type)
    own = rows.select("doc_id", "text", block.cast("int").alias("block"), F.lit(False).alias("guest"))
    dealt = own.unionByName(guests).repartitionById(len(bounds), "block")
    by_place = Window.partitionBy("block").orderBy("guest", *_place())
    following = F.coalesce(F.lead("text").over(by_place), F.lit(""))
    joined = dealt.select("block", "guest", "doc_id", "text", F.row_number().over(by_place).alias("pos"), following.alias("next_text"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    pairs = joined.select("block", "pos", "guest", "doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"))
    pairs = pairs.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    carried = ["guest", "doc_id", "n_chars", "edited_sha256"]
    printed = _fingerprints(pairs, ["block", "pos"], carried, {"text": "fingerprint", "edited": "edited_fingerprint"}, words)
    after = F.lead("fingerprint").over(Window.partitionBy("block").orderBy("pos"))
    printed = printed.select("*", after.alias("next_fingerprint")).filter("NOT guest")
    near = [likeness(F.col("fingerprint"), F.col(other)).alias(name) for other, name in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return printed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


DIGESTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_MASK = " + ".join(
    f"CASE WHEN ('0x' || substr(md5(term || '#{i}'), 1, 8))::BIGINT < {(1 << 32) // share} THEN {1 << i}::BIGINT ELSE 0::BIGINT END"
    for i, share in enumerate(s for s in SHARES for _ in range(OF_EACH))
)
_LIKENESS = """CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE
  len(list_filter(range(1, {n}), lambda i: coalesce(string_split({a}, '-')[i], '') <> '' AND coalesce(string_split({a}, '-')[i], '') = coalesce(string_split({b}, '-')[i], '')))::DOUBLE
  / len(list_filter(range(1, {n}), lambda i: coalesce(string_split({a}, '-')[i], '') <> '' OR coalesce(string_split({b}, '-')[i], '') <> '')) END"""

#: The same in DuckDB, by one window over all documents.
FINGERPRINT_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS pos
  FROM documents
),
paired AS (
  SELECT a.pos, a.doc_id, a.text, length(a.text) AS n_chars,
         substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) AS edited
  FROM docs a JOIN docs b ON b.pos = CASE WHEN a.pos = (SELECT max(pos) FROM docs) THEN 1 ELSE a.pos + 1 END
),
termed AS (
  SELECT pos, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS own,
         list_distinct(regexp_extract_all(lower(edited), '[\p{{L}}\p{{N}}]+')) AS other
  FROM paired
),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(own) AS term FROM termed) GROUP BY term),
lexicon AS (
  SELECT term, {_MASK} AS mask FROM counts
  WHERE n >= greatest({LEAST}, {LEAST_SHARE} * (SELECT count(*) FROM docs)) AND n <= greatest({LEAST}, {MOST_SHARE} * (SELECT count(*) FROM docs))
),
kept AS (
  SELECT pos, which, list(struct_pack(term := term, mask := mask) ORDER BY term) AS found
  FROM (SELECT pos, 0 AS which, unnest(own) AS term FROM termed UNION ALL SELECT pos, 1, unnest(other) FROM termed) JOIN lexicon USING (term)
  GROUP BY pos, which
),
prints AS (
  SELECT pos, which, substr(md5(array_to_string(list_transform(found, lambda x: x.term), ' ')), 1, 8) || '-' ||
         array_to_string(list_transform(range(0, {len(SHARES) * OF_EACH}), lambda i:
           CASE WHEN len(list_filter(found, lambda x: (x.mask >> i) & 1 = 1)) > 0
                THEN substr(md5(array_to_string(list_transform(list_filter(found, lambda x: (x.mask >> i) & 1 = 1), lambda x: x.term), ' ')), 1, 8)
                ELSE '' END), '-') AS print
  FROM kept
),
both_prints AS (
  SELECT p.pos, p.doc_id, p.n_chars, sha256(p.edited) AS edited_sha256,
         coalesce(a.print, substr(md5(p.text), 1, 12)) AS fingerprint, coalesce(b.print, substr(md5(p.edited), 1, 12)) AS edited_fingerprint
  FROM paired p LEFT JOIN prints a ON a.pos = p.pos AND a.which = 0 LEFT JOIN prints b ON b.pos = p.pos AND b.which = 1
),
followed AS (
  SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY pos), first_value(fingerprint) OVER (ORDER BY pos)) AS next_fingerprint FROM both_prints
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       {_LIKENESS.format(a="fingerprint", b="edited_fingerprint", n=len(SHARES) * OF_EACH + 2)} AS near_edited,
       {_LIKENESS.format(a="fingerprint", b="next_fingerprint", n=len(SHARES) * OF_EACH + 2)} AS near_next
FROM followed
"""
