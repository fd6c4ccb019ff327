"""The store of documents, pages, results and corrections as tables: last writes, scans by key, and joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses of pages that have been read, and the pipeline whose results can be read more deeply.
PROCESSED, QUICK = ("needs-review", "done"), "E"


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log: what a store holds after its writes. Equal orders: the largest row."""
    rest = [c for c in log.columns if c not in (*keys, order)]
    last = log.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in (order, *rest)]).select(*log.columns)


def pages_of(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """pages(doc_id, page_no, …) of the documents asked for, with the documents' ord; sort by ord and page_no to show them."""
    return pages.join(documents.select("doc_id", "ord"), "doc_id")


def pages_in(pages: DataFrame, *statuses: str) -> DataFrame:
    return pages.where(F.col("status").isin(*statuses))


def page_records(pages: DataFrame, results: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pages with their result and correction, null where there is none: pages(page_id, …), results(page_id, pipeline, markdown),
    corrections(page_id, corrected)."""
    return pages.join(results.select("page_id", "pipeline", "markdown"), "page_id", "left").join(corrections.select("page_id", "corrected"), "page_id", "left")


def deep_candidates(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages that have been read, by the quick pipeline: those that a deeper reading is offered for."""
    return pages_in(pages, *PROCESSED).join(results.where(F.col("pipeline") == QUICK).select("page_id"), "page_id", "left_semi")
