"""Document text from pages, document metadata and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import text as tx

# Fixed values that results depend on.
COLLECTIONS = ["clinical_notes", "disease_info", "patient_records"]
DEFAULT_COLLECTION = "clinical_notes"


def document_text(pages: DataFrame, doc_col: str = "source_file") -> DataFrame:
    """Page texts in page order, a blank line after each non-empty page, with the page count.

    A group is the pages of one document, which is the text it becomes.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy(doc_col).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.array_join(
            F.transform(F.filter(ordered, lambda p: p["text"] != ""), lambda p: F.concat(p["text"], F.lit("\n\n"))), ""
        ).alias("text"),
    )


def document_metadata(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds document type, patient id and date taken from the text."""
    c = F.col(text_col)
    return docs.withColumns(
        {"document_type": tx.document_type(c), "patient_id": tx.patient_id(c), "date": tx.document_date(c)}
    )


def metadata_struct(extracted_at: Column) -> Column:
    """The metadata row of a document as one struct."""
    return F.struct("document_type", "patient_id", "date", F.regexp_extract("source_file", r"[^/]*$", 0).alias("source_file"),
                    "page_count", extracted_at.alias("extracted_at"))


def string_metadata(fields: dict[str, Column]) -> Column:
    """Key-value metadata as strings, null values dropped."""
    m = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))])
    return F.map_filter(m, lambda k, v: v.isNotNull())


def collection_of(document_type: Column) -> Column:
    """Target collection of a document type; unknown types go to the default."""
    return F.when(document_type.isin(COLLECTIONS), document_type).otherwise(F.lit(DEFAULT_COLLECTION))


def collection_rows(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """Chunks as stored: routed to a collection, positions added to the string metadata."""
    target = F.lit(collection) if collection else collection_of(F.try_element_at("metadata", F.lit("document_type")))
    own = string_metadata({c: F.col(c) for c in ("chunk_index", "document_id", "start_char", "end_char")})
    kept = F.map_filter(
        "metadata", lambda k, v: v.isNotNull() & ~k.isin("chunk_index", "document_id", "start_char", "end_char")
    )
    return chunks.select("text", F.col("chunk_id").alias("id"), F.map_concat(kept, own).alias("metadata"),
                         target.alias("collection"))


def collection_counts(stored: DataFrame) -> DataFrame:
    """Rows per collection plus the total."""
    per = stored.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
    total = per.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents")).select(
        F.lit("total").alias("collection"), "documents"
    )
    return per.unionByName(total)
