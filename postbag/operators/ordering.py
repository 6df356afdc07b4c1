"""Fetch order, ordinals and running sums over a whole corpus, without a one-task window.

A running sum over everything needs an order over everything. The rows are range-partitioned and sorted
(sampled ranges over a unique key stay even, whatever value is frequent), each range is summed on its own,
and the sums of the earlier ranges are added. The add-on is a table with at most one row per range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postbag.session import pin

# A range holds about so many bytes of what is moved by it and so many rows; the driver holds a key of each.
RANGE_BYTES, RANGE_ROWS, MOST_RANGES = 128 << 20, 100_000, 20_000
# Rows that are not worth another range, and what a row weighs if nothing is known.
SMALL_RANGE, ROW_BYTES = 1000, 8 << 10
# Up to so many keys are the first of all found by keeping the first of every input split.
TOP_KEYS = 100_000
DAY_US = 86_400_000_000

# Makes the order total: uid is unique within mailbox and folder.
ORDER = ("mailbox_ord", "mailbox", "folder_ord", "date_us", "uid", "folder")


def position(c: Column, names: list[str]) -> Column:
    """Place of a name in a list, counted from 0; names outside come last."""
    if not names:
        return F.lit(0)
    place = F.array_position(F.array(*[F.lit(name.lower()) for name in names]), F.lower(c))
    return F.when(place > 0, place - 1).otherwise(len(names)).cast("int")


def with_order(messages: DataFrame, mailboxes: list[str], folders: list[str]) -> DataFrame:
    """Add the fetch-order columns: mailbox, then folder, then date, then uid. Mailboxes that are not listed
    follow by name."""
    return messages.withColumns(
        {
            "mailbox_ord": position(F.col("mailbox"), mailboxes),
            "folder_ord": position(F.col("folder"), folders),
            "date_us": date_us(F.col("date_local")),
        }
    )


def date_us(date_local: Column) -> Column:
    """Wall clock as a number that sorts; messages without a date come first."""
    days = F.unix_date(F.to_date(date_local)).cast("long")
    minutes = (days * 24 + F.hour(date_local)) * 60 + F.minute(date_local)
    seconds = F.extract(F.lit("SECOND"), date_local)
    micros = minutes * 60_000_000 + (seconds * 1_000_000).cast("long")
    return F.coalesce(micros, F.lit(-(2**63) + 1))


def range_count(rows: int, size: int) -> int:
    """Ranges for so many rows that take so many bytes, texts included. One range is one task: there are no more of
    them than it takes to bound a task, since every further one costs the driver a key."""
    wanted = max(math.ceil(size / RANGE_BYTES), math.ceil(rows / RANGE_ROWS))
    return max(1, min(MOST_RANGES, wanted, max(1, rows // SMALL_RANGE)))


def fits_one_range(size: int | None) -> bool:
    return size is not None and size <= RANGE_BYTES


def running_sums(
    rows: DataFrame, order: tuple[str, ...], cost: str, within: tuple[str, ...] = (), ranges: int | None = None
) -> DataFrame:
    """Add ``before``, the sum of ``cost`` over the rows that come earlier, and ``slot``, the range.

    With ``within`` each group sums for itself; the order must begin with those columns. Give it only the
    columns it needs: the rows are written before they are sampled for ranges, so that whatever computes them
    runs once, and again after, to fix which range each is in. With ``ranges`` they are taken to be a written table.
    """
    if order[: len(within)] != within:
        raise ValueError("the order has to begin with the group columns")
    keys = rows if ranges else pin(rows, "keys")
    count = ranges or range_count(keys.count(), 0)
    ranged = pin(
        keys.repartitionByRange(count, *order).withColumn("slot", F.spark_partition_id()), "ranges"
    )
    local = Window.partitionBy("slot", *within).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = ranged.groupBy("slot", *within).agg(F.sum(cost).alias("_sum"))
    earlier = Window.partitionBy(*within).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a range can have begun in an earlier one: at most one row per range is left.
    carried = (
        sums.withColumn("_carried", F.sum("_sum").over(earlier))
        .filter("_carried IS NOT NULL")
        .drop("_sum")
    )
    keys = ["slot", *within]
    here = F.coalesce(F.sum(cost).over(local), F.lit(0))
    return (
        ranged.repartitionById(count, "slot")
        .withColumn("_here", here)
        .join(F.broadcast(carried), keys, "left")
        .withColumn("before", F.col("_here") + F.coalesce("_carried", F.lit(0)))
        .drop("_here", "_carried")
    )


def first_keys(keys: DataFrame, n: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The first ``n`` keys; every input split passes on no more than these."""
    return keys.orderBy(*order).limit(n)


def _last_taken(keys: DataFrame, n: int, order: tuple[str, ...] = ORDER) -> dict | None:
    """The key at which the weights of the first ones reach ``n``, and what lies before it; None without keys."""
    if n > TOP_KEYS:
        taken = running_sums(keys, order, "_weight").filter(F.col("before") < n)
    else:
        # A weight is 1 or more, so the first n keys are enough.
        first = first_keys(keys, n, order)
        earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        taken = first.withColumn("before", F.coalesce(F.sum("_weight").over(earlier), F.lit(0))).filter(F.col("before") < n)
    last = taken.agg(F.max(F.struct(*order, "before")).alias("last")).first()["last"]
    return last.asDict() if last else None


def limit(messages: DataFrame, n: int | None, copies: str | None = None) -> DataFrame:
    """The first ``n`` messages in fetch order; no limit for 0 or None.

    With ``copies`` a row stands for that many messages, and the last row taken may keep only some of them.

    The cut-off key is looked up among the keys; the messages are then filtered by a constant where they are
    read. For up to ``TOP_KEYS`` messages every input split passes on its own first ``n`` keys. For more the keys are
    first counted by mailbox, folder and day; only those of the day with the cut are looked at one by one.
    """
    if not n:
        return messages
    weight = F.col(copies) if copies else F.lit(1)
    keys = messages.select(*ORDER, weight.cast("long").alias("_weight"))
    taken = 0
    if n > TOP_KEYS:
        stretch = ("mailbox_ord", "mailbox", "folder_ord", "_day")
        dated = keys.withColumn("_day", F.expr(f"date_us div {DAY_US}"))
        found = _last_taken(dated.groupBy(*stretch).agg(F.sum("_weight").alias("_weight")), n, stretch)
        if found is None:
            return messages
        taken = found["before"]
        same = F.lit(True)
        for name in stretch:
            same = same & F.col(name).eqNullSafe(F.lit(found[name]))
        keys = dated.filter(same).drop("_day")
    last = _last_taken(keys, n - taken)
    if last is None:
        return messages
    types = {field.name: field.dataType for field in messages.schema.fields}
    key = F.struct(*ORDER)
    cut = F.struct(*[F.lit(last[name]).cast(types[name]).alias(name) for name in ORDER])
    kept = messages.filter(key <= cut)
    if copies is None:
        return kept
    rest = F.least(F.col(copies), F.lit(n - taken - last["before"]))
    return kept.withColumn(copies, F.when(key == cut, rest).otherwise(F.col(copies)))
