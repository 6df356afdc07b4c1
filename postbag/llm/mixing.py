"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, ``-ln(u) / quality``; in ascending order of the keys a source's documents
are a weighted sample without replacement, whatever its length. A source takes as many complete passes over its
documents as its target holds, and then documents in the order of their keys until the rest of the target is filled.

The order is needed at one place only: where the rest runs out. Keys are dealt to buckets, bucket sums say in which
bucket that is, and only that bucket of each source is sorted. Whether a document is taken then follows from its
own key and its source's cut, so texts don't move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postbag.llm.common import uniform
from postbag.session import pin

WORD = r"[^\x20\x09-\x0D]+"
MOST_PASSES = 3
#: Rows of a source's key bucket, about; and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64


def size() -> Column:
    """Words of the text; 0 for NULL."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")


def quality() -> Column:
    """1, or 0.5 for texts whose words are 3 characters long at most or over 12 on average: lists, numbers, code."""
    mean = F.try_divide(F.length("text"), "size")
    return F.when((mean > 3) & (mean <= 12), 1.0).otherwise(0.5)


def drawn(documents: DataFrame, buckets: int, seed: int, weight: Column | None = None) -> DataFrame:
    """``documents`` in ``doc``, with what decides about each: source_key, size, key, bucket."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), "doc_id", "text", "source", size().alias("size"))
    u = uniform(F.lit(str(seed)), "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = rows.select("*", (-F.log(u) / (quality() if weight is None else weight)).alias("key"))
    share = F.floor((1 - F.exp(-F.col("key"))) * buckets)
    return rows.select(
        "doc",
        "doc_id",
        "source",
        # NULL is a source of its own, apart from the empty name.
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        "size",
        "key",
        F.least(share, F.lit(buckets - 1)).alias("bucket"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source_size, target.

    Sources by code point, NULL last, weigh ``weights`` in turn. Targets share the sum of all sizes by weight; none is
    above MOST_PASSES times its source, the excess goes to the others by weight. In the order of size by weight the
    sources that reach their bound come first, and running sums tell which they are.
    """
    # One row per source, as many as a mix lists; not a table that grows with the documents.
    by_name = Window.orderBy(F.col("source_key") == "", "source_key")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * MOST_PASSES
    listed = sizes.select("source_key", "source_size", weight.cast("double").alias("weight"), bound.cast("double").alias("bound"))
    everything = Window.partitionBy()
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), "source_key")
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_bound.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = listed.select("*", (left / F.sum("weight").over(onward)).alias("level"))
    level = level.select("*", (F.col("bound") <= F.col("weight") * F.col("level")).alias("full"))
    # The first source below its bound sets the level for all of them; left over can only shrink before it.
    common = F.max(F.when(~F.col("full"), F.struct(-F.col("bound") / F.col("weight"), F.col("level")))).over(everything)
    return level.select("source_key", "source_size", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * common["level"]).alias("target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source_size, target, passes, and up to where the keys go once more (cut_bucket, cut)."""
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = pin(sums, "mix-sums")
    found = targets(sums.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")), weights)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    found = found.select("*", passes.alias("passes"))
    found = pin(found.select("*", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest")), "mix-targets")
    running = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("*", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("start"))
    # Written, tables of one row per source have a known size, and rows of a large source needn't meet to join them.
    crossed = pin(
        starts.join(found.select("source_key", "rest"), "source_key")
        .filter("start <= rest")
        .groupBy("source_key")
        .agg(F.max("bucket").alias("cut_bucket"), F.max_by("start", "bucket").alias("start"), F.max("rest").alias("rest")),
        "mix-crossed",
    )
    inside = rows.join(crossed.withColumnRenamed("cut_bucket", "bucket"), ["source_key", "bucket"])
    place = F.struct("key", "doc_id", "size")
    by_key = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    # Where the rest runs out inside a document, it is taken if that comes nearer.
    taken = inside.select("source_key", place.alias("place"), (2 * before + F.col("size") <= 2 * F.col("rest")).alias("fits"))
    last = taken.filter("fits").groupBy("source_key").agg(F.max("place").alias("cut"))
    return pin(found.join(crossed.select("source_key", "cut_bucket"), "source_key", "left").join(last, "source_key", "left"), "mix-cuts")


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, math.ceil(rows / BUCKET_ROWS))


def _copies(rows: DataFrame, cut: DataFrame) -> DataFrame:
    joined = rows.join(cut, "source_key")
    again = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.struct("key", "doc_id", "size") <= F.col("cut"), F.lit(False)))
    return joined.select("*", (F.col("passes") + F.when(again, 1).otherwise(0)).cast("int").alias("copies"))


def decided(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document) for every document.

    ``weight``: quality weight of a document over its columns and ``size``, above 0. Draws depend on seed, doc_id and
    text, so equal rows are taken alike; equal keys are ordered by doc_id and size. NULL texts have size 0.
    """
    rows = pin(drawn(documents.select("doc_id", "text", "source"), bucket_count(documents.count()), seed, weight).drop("doc"), "mix-rows")
    return _copies(rows, cuts(rows, weights)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(documents: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), weight: Column | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    buckets = bucket_count(documents.count())
    slim = pin(drawn(documents.select("doc_id", "text", "source"), buckets, seed, weight).drop("doc"), "mix-rows")
    found = _copies(drawn(documents, buckets, seed, weight), cuts(slim, weights))
    return found.filter("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


def mix_digests(documents: DataFrame, seed: int = 0) -> DataFrame:
    """Query 3: how many words of every document the mix takes."""
    return decided(documents, seed).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB. Draws, targets and cuts by plain windows over whole sources.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
),
drawn AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(body)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / (CASE WHEN size > 0 AND length(body) / size > 3 AND length(body) / size <= 12 THEN 1.0 ELSE 0.5 END)::DOUBLE AS key
  FROM sized
),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM drawn GROUP BY source
),
bounds AS (
  SELECT *, 3.0::DOUBLE * source_size AS bound, (SELECT sum(source_size) FROM sources)::DOUBLE AS everything FROM sources
),
levels AS (
  SELECT *,
         (everything - coalesce(sum(bound) OVER (ORDER BY bound / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY bound / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bounds
),
targets AS (
  SELECT source, source_size,
         CASE WHEN bound <= weight * level THEN bound
              ELSE weight * (SELECT arg_min(level, bound / weight) FROM levels WHERE bound > weight * level) END AS target
  FROM levels
),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM targets
),
ordered AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM drawn d JOIN passes p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
       ((passes + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ordered
"""
