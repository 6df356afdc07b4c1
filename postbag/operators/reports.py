"""Counts and statistics of a run, and its progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from postbag.sources.records import first_key, with_verdict


def mailbox_counts(messages: DataFrame, mailboxes: list[str] | None = None) -> DataFrame:
    """Messages per requested mailbox, in that order, those without any included, and the total. Without a
    request all mailboxes that have messages, by name."""
    copies = F.sum("copies") if "copies" in messages.columns else F.count("*")
    counted = messages.groupBy("mailbox").agg(copies.alias("_n"))
    if mailboxes:
        requested = messages.sparkSession.createDataFrame(
            list(enumerate(mailboxes)), "mailbox_ord int, mailbox string"
        )
        counted = requested.join(counted, "mailbox", "left")
    else:
        counted = counted.withColumn("mailbox_ord", F.lit(0))
    return (
        counted.rollup("mailbox_ord", "mailbox")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("processed"))
        .filter("mailbox IS NOT NULL OR mailbox_ord IS NULL")
        .orderBy(F.col("mailbox_ord").asc_nulls_last(), "mailbox")
        .select(F.coalesce("mailbox", F.lit("Total")).alias("mailbox"), "processed")
    )


def item_stats(responses: DataFrame) -> DataFrame:
    """One row per item: what became of it. An item has failed if one of its chunks has."""
    used = F.col("response.usage_prompt_tokens") + F.col("response.usage_completion_tokens")
    return (
        with_verdict(responses)
        .withColumn("output_key", first_key(F.col("emails")))
        # An item has one mailbox and one key: as group columns they keep the aggregation on hash tables.
        .groupBy("item_id", "mailbox", "output_key")
        .agg(
            F.max(F.aggregate("emails", F.lit(0).cast("long"), lambda n, e: n + e["copies"])).alias("messages"),
            F.max(F.col("error").isNotNull()).alias("failed"),
            F.count("response").alias("calls"),
            F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
            F.coalesce(F.sum(used), F.lit(0)).alias("tokens"),
            F.count_if(~F.col("is_empty")).alias("written"),
            F.count_if("is_empty").alias("skipped"),
        )
    )


def run_stats(responses: DataFrame) -> DataFrame:
    """The run in one row. Everything is derived from the written responses, so it is exact however often
    tasks were repeated."""
    ok = F.when(~F.col("failed"), F.col("messages")).otherwise(0)
    bad = F.when(F.col("failed"), F.col("messages")).otherwise(0)
    total = [
        F.sum("messages").alias("emails_fetched"),
        F.sum(ok).alias("emails_processed"),
        F.sum(bad).alias("emails_failed"),
        F.sum("calls").alias("calls"),
        F.sum("retries").alias("retries"),
        F.sum("tokens").alias("tokens_used"),
        F.sum("written").alias("records_written"),
        F.sum("skipped").alias("answers_skipped"),
        F.count_distinct(F.when(F.col("written") > 0, F.col("output_key"))).alias("distinct_keys"),
    ]
    names = [
        "emails_fetched", "emails_processed", "emails_failed", "calls", "retries",
        "tokens_used", "records_written", "answers_skipped", "distinct_keys",
    ]
    return item_stats(responses).agg(*total).select(
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in names],
        (F.coalesce("emails_fetched", F.lit(0)) == 0).alias("no_emails"),
    )


def error_report(responses: DataFrame, shown: int = 3) -> DataFrame:
    """Per mailbox: number of errors, the last ones as text, and how many more there are.

    Each task keeps its own last errors before anything is shuffled.
    """
    errors = responses.filter("error IS NOT NULL")
    subjects = F.array_join(F.transform(F.slice("emails", 1, 2), lambda e: F.left(e["subject"], F.lit(20))), ", ")
    line = F.concat(F.lit("no answer on ["), subjects, F.lit("]: "), F.col("error"))
    newest = Window.partitionBy("mailbox").orderBy(
        F.col("emails")[0]["date_local"].desc(), F.col("item_id").desc(), F.col("chunk_ix").desc()
    )
    last = (
        errors.withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= shown)
        .select("mailbox", F.struct((-F.col("_rank")).alias("_rank"), line.alias("line")).alias("_line"))
        .groupBy("mailbox")
        .agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
    )
    counted = errors.groupBy("mailbox").agg(F.count("*").alias("errors"))
    return counted.join(last, "mailbox").select(
        "mailbox",
        "errors",
        F.array_join(F.col("_lines.line"), "; ").alias("last_errors"),
        F.greatest(F.col("errors") - shown, F.lit(0)).alias("more"),
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while it is processed. For display: repeated tasks count again."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


class Progress(StreamingQueryListener):
    """Reports a stream's progress to a function of (rows of the last batch, rows so far)."""

    def __init__(self, report: Callable[[int, int], None]) -> None:
        self._report = report
        self._total = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        rows = event.progress.numInputRows
        self._total += rows
        self._report(rows, self._total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
