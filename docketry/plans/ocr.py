"""Recognition quality of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docketry.operators import quality


def ocr_report(documents: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """Status, text-layer class and engine routing of every document in one table.

    ``documents(doc_key, method, status)``, ``pages(doc_key, page, text)``.
    """
    confidence = quality.page_confidence(pages, words)
    report = quality.document_report(documents, confidence)
    layer = quality.text_layer(pages, documents)
    routed = quality.acceptance(quality.text_metrics(pages, words)).select("doc_key", "engine", "reasons")
    return report.join(layer, "doc_key").join(routed, "doc_key", "left")
