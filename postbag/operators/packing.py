"""Putting consecutive messages together: batches, transcripts, and their cut into chunks.

A pack holds the consecutive rows whose running cost falls into the same multiple of a budget. With cost 1
these are batches of fixed size, with cost = characters they are batches that fill a context.

The order is found on the key columns alone (``running_sums``). That yields the first key of a pack in each
range; rows then find their range by comparing their key with these first keys, so the texts move once, to
the task that owns the range. Packs never straddle ranges, and ranges are even however the data is skewed.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.functions.chunks import chunk_size, chunks, fixed_chunks
from postbag.functions.text import SEPARATOR, iso_date, let
from postbag.operators.ordering import ORDER, ROW_BYTES, fits_one_range, range_count, running_sums
from postbag.session import input_bytes, pin

DEFAULT_BATCH = 10


def _keys(bounds: list, key_type: T.StructType) -> Column:
    """Order keys as a constant array."""
    text = "[" + ",".join(bound["key"] for bound in bounds) + "]"
    return F.from_json(F.lit(text), T.ArrayType(key_type))


def range_of(key: Column, bounds: list, key_type: T.StructType) -> Column:
    """Number of the last range whose first key is not above ``key``.

    Looks at every √n-th first key, then at the keys between two of these.
    """
    step = max(1, math.isqrt(len(bounds)))
    firsts, heads = _keys(bounds, key_type), _keys(bounds[::step], key_type)

    def number(k: Column) -> Column:
        head = F.greatest(F.size(F.filter(heads, lambda first: first <= k)), F.lit(1))
        near = F.slice(firsts, (head - 1) * step + 1, F.lit(step))
        inside = F.greatest(F.size(F.filter(near, lambda first: first <= k)), F.lit(1))
        return (head - 1) * step + inside - 1

    return let(key, number)


def with_packs(
    rows: DataFrame,
    order: tuple[str, ...],
    cost: Column,
    budget: int,
    within: tuple[str, ...] = (),
    sized: bool = False,
    start: int = 0,
) -> DataFrame:
    """Add ``pack`` (number of the pack, counted from 0 in its group), ``place`` (running cost before the row)
    and ``slot``. Rows of a pack lie in one partition, partitioned by ``slot``: grouping by ``slot``, the
    group columns and ``pack`` needs no further shuffle.

    ``sized`` says that the cost is about the size of the row. Then the rows are written once with their cost, which
    may take cleaning whole bodies, and order and texts both come from there. Other costs are cheap: only keys are
    written, and the rows are computed when they are moved. Ranges are made for the size of the rows; what fits one
    task is one range, and with groups even that is dealt out by group. ``start`` is where counting begins.
    """
    if order[: len(within)] != within:
        raise ValueError("the order has to begin with the group columns")
    costed = rows.withColumn("_cost", cost.cast("long"))
    keys = costed.select(*order, "_cost")
    if sized:
        costed = pin(costed, "costed")
        seen = costed.agg(F.count("*").alias("n"), F.sum("_cost").alias("size")).first()
        keys, count = costed.select(*order, "_cost"), range_count(seen["n"], seen["size"] or 0)
    else:
        size = input_bytes(rows)
        count = 1
        if not fits_one_range(size):
            keys = pin(keys, "keys")
            n = keys.count()
            count = range_count(n, n * ROW_BYTES if size is None else size)
    if count == 1:
        one = costed.withColumn("slot", F.lit(0))
        earlier = Window.partitionBy(*(within or ("slot",))).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        place = F.coalesce(F.sum("_cost").over(earlier), F.lit(0)) + start
        return one.withColumn("place", place).withColumn("pack", F.expr(f"place div {budget}")).drop("_cost")

    sums = running_sums(keys, order, "_cost", within, count).withColumn("before", F.col("before") + start)
    packs = sums.groupBy(*within, F.expr(f"before div {budget}").alias("pack")).agg(
        F.min(F.struct(*order, "slot", "before")).alias("first")
    )
    bounds = (
        packs.groupBy("first.slot")
        .agg(F.min("first").alias("first"))
        .select(
            "slot",
            F.to_json(F.struct(*[F.col("first")[name].alias(name) for name in order])).alias("key"),
            F.col("first")["before"].alias("before"),
        )
        .collect()  # one row per range
    )
    bounds.sort(key=lambda bound: bound["slot"])
    key_type = T.StructType([costed.schema[name] for name in order])
    starts = F.from_json(F.lit(json.dumps([bound["before"] for bound in bounds])), "array<bigint>")

    placed = costed.withColumn("slot", range_of(F.struct(*order), bounds, key_type))
    local = (
        Window.partitionBy("slot", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    here = F.coalesce(F.sum("_cost").over(local), F.lit(0))
    # A group that began in an earlier range goes on counting where it stood there.
    first_place = F.get(starts, F.col("slot"))
    if within:
        first = F.get(_keys(bounds, key_type), F.col("slot"))
        same = F.struct(*within) == F.struct(*[first[name].alias(name) for name in within])
        first_place = F.when(same, first_place).otherwise(F.lit(start))
    return (
        placed.repartitionById(len(bounds), "slot")
        .withColumn("place", here + first_place)
        .withColumn("pack", F.expr(f"place div {budget}"))
        .drop("_cost")
    )


def email_struct() -> Column:
    """What a record shows of a message."""
    return F.struct(
        "uid",
        "subject",
        "sender",
        "recipients",
        iso_date(F.col("date_local"), F.col("date_offset_min")).alias("date"),
        "date_local",
        # Not shown, but counted by.
        "mailbox",
        F.col("copies").cast("long").alias("copies"),
    )


def counted(messages: DataFrame) -> DataFrame:
    """``messages`` with ``copies``: how often each was found, once if nothing says otherwise."""
    return messages if "copies" in messages.columns else messages.withColumn("copies", F.lit(1))


EMAIL_COLUMNS = ("uid", "subject", "sender", "recipients", "date_local", "date_offset_min")


MEMBER_COLUMNS = tuple(dict.fromkeys([*ORDER, *EMAIL_COLUMNS, "mailbox", "copies", "content"]))


def members(messages: DataFrame) -> DataFrame:
    """What batches need of messages."""
    return counted(messages).select(*MEMBER_COLUMNS)


def batch_cost(fit: bool) -> Column:
    """What a message takes of a batch: as many places as it has copies or, to fill a context, its characters."""
    return F.length("content") + len(SEPARATOR) if fit else F.coalesce("copies", F.lit(1))


def gathered(packed: DataFrame, budget: int, fit: bool = False, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per batch of members that ``with_packs`` has placed."""
    if fit:
        # What reaches over the end of its stretch is a batch of its own.
        over = F.coalesce(F.col("place") + batch_cost(fit) > (F.col("pack") + 1) * budget, F.lit(False))
        packed = packed.withColumn("pack", 2 * F.col("pack") + over.cast("long"))
    member = F.struct(F.struct(*order).alias("key"), email_struct().alias("email"), "mailbox", "content")
    return (
        packed.groupBy("slot", "pack")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .select(
            F.col("pack").alias("batch_id"),
            F.col("members.mailbox")[0].alias("mailbox"),
            F.col("members.email").alias("emails"),
            F.array_join(F.col("members.content"), SEPARATOR).alias("content"),
        )
    )


def _batched(messages: DataFrame, budget: int, fit: bool = False) -> DataFrame:
    return gathered(with_packs(members(messages), ORDER, batch_cost(fit), budget, sized=fit), budget, fit)


def batches(messages: DataFrame, size: int | None = None) -> DataFrame:
    """``size`` consecutive messages per batch, over folder and mailbox borders; the last may be smaller.

    Takes messages with order columns and ``content``; the mailbox of a batch is that of its first message. A
    message that was found several times is there once, and takes as many places as it was found times.
    """
    return _batched(messages, size or DEFAULT_BATCH)


def fitted_batches(messages: DataFrame, size: int) -> DataFrame:
    """Consecutive messages in batches of at most ``size`` characters, separators included.

    All messages one after the other are cut into stretches of ``size`` characters. A batch holds the messages that
    lie within one stretch (even ``batch_id``), a message across the end of a stretch is alone (odd). So only a
    single message can be longer than ``size``, and the result does not depend on how rows are partitioned.
    """
    return _batched(messages, size, fit=True)


def single_items(messages: DataFrame) -> DataFrame:
    """Every message its own item."""
    item = F.concat_ws("|", F.lit("m"), "mailbox", "folder", "uid")
    return counted(messages).select(
        item.alias("item_id"),
        "mailbox",
        F.array(email_struct()).alias("emails"),
        F.col("copies").cast("long").alias("copies"),
        "content",
    )


def batch_items(batched: DataFrame) -> DataFrame:
    return batched.select(
        F.concat(F.lit("b|"), F.col("batch_id").cast("string")).alias("item_id"),
        "mailbox",
        "emails",
        F.lit(1).cast("long").alias("copies"),
        "content",
    )


def chunked(
    items: DataFrame, max_context: int | None = None, size: int | None = None, fixed: bool = False
) -> DataFrame:
    """One row per chunk. An item without text stays, as one row whose chunk is NULL: it is no call, but it
    still counts as processed."""
    if size is None:
        size = chunk_size(max_context)
    pieces = (fixed_chunks if fixed else chunks)(F.col("content"), size)
    kept = [name for name in items.columns if name != "content"]
    return items.select(*kept, F.posexplode_outer(pieces).alias("chunk_ix", "chunk"))
