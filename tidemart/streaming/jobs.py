"""Summaries as streams: the batch job's function on rows with a watermark, and whole chains from facts to windows in one query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs, windows
from ..operators.dims import enrich_sku
from ..operators.windows import WIDTH, traffic_rows
from ..operators.windows import traffic as traffic_sums
from ..sources.feeds import parse_lines
from ..sources.sinks import append_stream, foreach_batch
from . import states

#: Watermarks of the summaries: logins wait not at all, the union of three traffic streams waits for the bounces.
WATERMARKS = {"user_login": "0 seconds", "traffic": "14 seconds"}
WATERMARK = "2 seconds"


def with_time(df: DataFrame, ms: str = "ms") -> DataFrame:
    """Rows with the event time ``rt`` from epoch milliseconds."""
    return df.withColumn("rt", F.timestamp_millis(ms))


def windowed(df: DataFrame, name: str, summary: Callable[[DataFrame], DataFrame], time: str = "rt", delay: str | None = None) -> DataFrame:
    """The named summary of a stream; rows later than its watermark, or than ``delay``, are dropped."""
    return summary(df.withWatermark(time, delay or WATERMARKS.get(name, WATERMARK)))


def traffic(page: DataFrame, visitors: DataFrame, jumps: DataFrame, width: str = WIDTH, delay: str | None = None) -> DataFrame:
    """The traffic summary of three streams, which land apart: page views, unique visitors and bounces."""
    return windowed(traffic_rows(page, visitors, jumps), "traffic", lambda rows: traffic_sums(rows, width), delay=delay)


# Each of these is one query with one checkpoint: rows find their order, repeats and first days are told apart, and windows follow.


def page_views(views: DataFrame, width: str = WIDTH, delay: str = WATERMARK, tie: list[str] | None = None) -> DataFrame:
    """From the views (``mid, page_id, rt``) of home and detail pages."""
    return windows.page_view(states.first_per_day(views, ["mid", "page_id"], "rt", tie, delay), width)


def user_logins(logins: DataFrame, width: str = WIDTH, delay: str = WATERMARK, tie: list[str] | None = None) -> DataFrame:
    """From the page views (``uid, rt``) that are logins."""
    return windows.user_login(states.daily_logins(logins, "uid", "rt", tie=tie, watermark=delay), width)


def cart_adds(added: DataFrame, width: str = WIDTH, delay: str = WATERMARK, tie: list[str] | None = None) -> DataFrame:
    """From the cart's increments (``user_id, rt``)."""
    return windows.cart_add(states.first_per_day(added, ["user_id"], "rt", tie, delay), width)


def payments(paid: DataFrame, by: list[str], width: str = WIDTH, delay: str = WATERMARK, wait_s: int = 5) -> DataFrame:
    """From payments with repeats: of each order detail the last one by ``by``, then who pays for the first time."""
    kept = states.latest(paid.where("order_detail_id IS NOT NULL"), ["order_detail_id"], "rt", [], delay, 1000 * wait_s, by)
    flagged = states.user_flags(kept, "user_id", "rt", "payment_suc_unique_user_count", "payment_new_user_count", ["order_detail_id"], None, 1000 * wait_s)
    return windows.payment(flagged, width, f"{wait_s} seconds")


def trade_orders(details: DataFrame, by: list[str], width: str = WIDTH, delay: str = WATERMARK, wait_s: int = 5) -> DataFrame:
    """From order details with repeats: the first one of each id by ``by``, then who orders for the first time."""
    kept = states.first(details, ["id"], "rt", [], delay, 1000 * wait_s, by)
    flagged = states.user_flags(kept, "user_id", "rt", "order_unique_user_count", "order_new_user_count", ["id"], None, 1000 * wait_s)
    return windows.trade_order(flagged, width, f"{wait_s} seconds")


def user_spu_orders(details: DataFrame, by: list[str], sku: DataFrame, spu: DataFrame, trademark: DataFrame, chain: DataFrame, width: str = WIDTH, delay: str = WATERMARK, wait_s: int = 5) -> DataFrame:
    """From order details with repeats, the first one of each id, and its sku's dimensions."""
    kept = enrich_sku(states.first(details, ["id"], "rt", [], delay, 1000 * wait_s, by), sku)
    return windows.user_spu_order(kept, spu, trademark, chain, width, f"{wait_s} seconds")


def province_orders(details: DataFrame, by: list[str], province: DataFrame, width: str = WIDTH, delay: str = WATERMARK, wait_s: int = 5) -> DataFrame:
    """From order details with repeats, the last one of each id."""
    return windows.province_order(states.latest(details, ["id"], "rt", [], delay, 1000 * wait_s, by), province, width, f"{wait_s} seconds")


def refunds(asked: DataFrame, sku: DataFrame, trademark: DataFrame, chain: DataFrame, width: str = WIDTH, delay: str = WATERMARK) -> DataFrame:
    return windows.refund(enrich_sku(asked.withWatermark("rt", delay), sku), trademark, chain, width)


def log_outputs(raw: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The outputs of a raw behaviour log as one table in partitions by ``kind``, bad lines included: one query parses each line once and commits all outputs together.

    The file sink's log has each batch once, so a restart anywhere repeats nothing; read an output with ``logs.of_kind``.
    """
    writer = logs.fan_out(parse_lines(raw)).writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def log_topics(raw: DataFrame, write: Callable[[DataFrame, str], None], done: Callable[[str], int], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """The outputs of a raw behaviour log for sinks that do not commit together, such as topics: each batch is parsed once and kept for all outputs.

    ``write`` gets the rows of an output with the batch's number as ``batch``, and its kind; ``done`` says up to which batch a kind has come, so that
    after a stop between two outputs only the missing ones are written.
    """

    def work(batch: DataFrame, number: int) -> None:
        rows = logs.fan_out(parse_lines(batch)).persist()
        try:
            for kind in logs.KINDS:
                if done(kind) < number:
                    write(logs.of_kind(rows, kind).withColumn("batch", F.lit(number).cast("long")), kind)
        finally:
            rows.unpersist()

    return foreach_batch(raw, checkpoint, work, available_now)


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream holds now to Parquet files and wait for the end."""
    done = append_stream(df, path, checkpoint, available_now=True)
    done.awaitTermination()
    return done
