"""The page queue as a stream: page events in, the latest status of each page out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses in the order in which a page goes through them; those from which it doesn't go on.
STATUSES = ("queued", "rasterizing", "processing", "needs-review", "done", "error")
TERMINAL = ("needs-review", "done", "error")


def page_status_stream(events: DataFrame) -> DataFrame:
    """(page_id, status, ts): of streamed events(page_id, ts, status) the latest status of each page, of equal times the later one in
    STATUSES. For the output modes update and complete; the state holds one row a page, however late its events come."""
    known = events.where(F.col("status").isin(*STATUSES))
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return known.groupBy("page_id").agg(F.max_by("status", F.struct("ts", rank)).alias("status"), F.max("ts").alias("ts"))


def throughput_stream(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(start, status, pages): pages that reached a terminal status, by window."""
    ended = events.where(F.col("status").isin(*TERMINAL)).withWatermark("ts", lateness)
    return ended.groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("pages")).select(F.col("window.start").alias("start"), "status", "pages")
