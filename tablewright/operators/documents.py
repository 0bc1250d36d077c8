"""Operators on a table of page texts (document id, page number, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MARKDOWN_PREVIEW_CHARS, MIN_PAGE_TEXT, PAGE_LABEL
from ..functions.scalars import needs_ocr
from .shape import col


def route_pages(pages: DataFrame, text: str = "text", minimum: int = MIN_PAGE_TEXT) -> DataFrame:
    """Adds routed_to_ocr: the text layer of the page is shorter than the minimum."""
    return pages.withColumn("routed_to_ocr", needs_ocr(col(text), minimum))


def classify_documents(
    pages: DataFrame, doc: str, page: str, text: str = "text", minimum: int = MIN_PAGE_TEXT, recognised: str | None = None
) -> DataFrame:
    """One row per document: page_count, ocr_pages, pages_needing_ocr, document_type, status.

    ``recognised`` names a column with text recovered for routed pages; a routed page without any
    stays in need of recognition. Page lists hold page numbers only and are bounded by the document.
    """
    routed = needs_ocr(col(text), minimum)
    recovered = F.length(F.trim(F.coalesce(col(recognised), F.lit("")))) > 0 if recognised else F.lit(False)
    open_page = routed & ~recovered
    grouped = pages.groupBy(col(doc)).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.array_sort(F.collect_list(F.when(routed, col(page)))).alias("ocr_pages"),
        F.array_sort(F.collect_list(F.when(open_page, col(page)))).alias("pages_needing_ocr"),
    )
    n_routed, n_open = F.size("ocr_pages"), F.size("pages_needing_ocr")
    kind = F.when(n_routed == F.col("page_count"), "scanned").when(n_routed > 0, "mixed").otherwise("text_based")
    status = F.when(n_open == 0, "parsed").when(n_open == F.col("page_count"), "ocr_required").otherwise("partial")
    return grouped.withColumn("document_type", kind).withColumn("status", status)


def _heading(page: str) -> Column:
    return F.concat(F.lit(PAGE_LABEL[0]), col(page).cast("string"), F.lit(PAGE_LABEL[1]))


def _joined(pages: DataFrame, doc: str, page: str, block: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(col(page).alias("p"), block.alias("b"))))
    return pages.groupBy(col(doc)).agg(F.concat_ws("\n\n", F.transform(ordered, lambda x: x["b"])).alias(name))


def export_markdown(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, markdown): a second-level heading per page, pages separated by a blank line."""
    block = F.concat(F.lit("## "), _heading(page), F.lit("\n\n"), F.coalesce(col(text), F.lit("")))
    return _joined(pages, doc, page, block, "markdown")


def export_text(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, plain_text): page label line, then the text."""
    block = F.concat(_heading(page), F.lit("\n"), F.coalesce(col(text), F.lit("")))
    return _joined(pages, doc, page, block, "plain_text")


def assemble_markdown(pages: DataFrame, doc: str, page: str, text: str = "text", preview_chars: int = MARKDOWN_PREVIEW_CHARS) -> DataFrame:
    """(doc, markdown, markdown_preview): empty pages are left out, documents without text get ''."""
    filled = F.length(F.coalesce(col(text), F.lit(""))) > 0
    block = F.when(filled, F.concat(F.lit("## "), _heading(page), F.lit("\n\n"), col(text)))
    return _joined(pages, doc, page, block, "markdown").withColumn(
        "markdown_preview", F.substring("markdown", 1, preview_chars)
    )


def search_pages(pages: DataFrame, needle: str, text: str = "text", regex: bool = False) -> DataFrame:
    """Pages whose text contains the phrase, or matches the pattern."""
    return pages.filter(col(text).rlike(needle) if regex else F.contains(col(text), F.lit(needle)))
