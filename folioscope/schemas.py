"""Declared schemas of everything that is read or produced; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Column names of the raw paper record, in its order.
RAW_COLUMNS = ["arXiv ID", "arXiv URL", "PDF URL", "DOI", "Publication Date", "Updated Date", "Title", "Authors", "Author Affiliations", "Abstract", "Categories", "Primary Category", "Comment", "Journal Reference"]
# Raw columns that enriched records rename.
RENAMED = {"arXiv ID": "arxiv_id", "Title": "title", "Authors": "authors", "Publication Date": "publication_date", "Abstract": "abstract"}
# Fields of the relevance and of the metadata answer.
RELEVANCE_FIELDS = ["is_dataset_paper", "skip_reasoning"]
METADATA_FIELDS = ["role_in_paper", "intended_primary_use", "scope_of_use", "task_family", "targeted_capability", "output_type", "language_coverage", "domain", "source_of_text", "collection_method", "llm_involvement", "approximate_scale", "relationship_to_prior", "claimed_contribution"]
MULTI_VALUE_FIELDS = ["intended_primary_use", "targeted_capability", "source_of_text", "relationship_to_prior"]
SINGLE_VALUE_FIELDS = ["role_in_paper", "scope_of_use", "task_family", "output_type", "language_coverage", "domain", "collection_method", "llm_involvement", "approximate_scale", "claimed_contribution", "expected_adoption_scope"]
# Ordered categories of dataset size, and columns completeness leaves out.
SCALES = ["<10K", "10K-100K", "100K-1M", ">1M"]
ID_COLUMNS = ["arxiv_id", "title", "authors", "publication_date", "abstract"]
# Order of the conference paper's columns.
CONFERENCE_COLUMNS = ["year", "id", "title", "abstract", "authors", "author_ids", "venue", "primary_area", "decision", "scores", "keywords", "openreview_url"]
# Subject classes a feed is crawled for, and page sizes and pauses of the two sources.
CATEGORIES = ["cs.CL", "cs.LG", "cs.IR", "cs.HC", "cs.SI", "cs.CY", "cs.MA", "cs.MM", "cs.DL"]
QUERY_TYPES = ["submission", "Submission", "Blind_Submission", "Withdrawn_Submission", "Rejected_Submission", "Desk_Rejected_Submission", ""]
FEED_PAGE, NOTES_PAGE = 2000, 1000
FEED_PAUSE_S, NOTES_PAUSE_S, BACKOFF_S = 3.0, 1.0, 30.0
ROW_CAP = 200_000


def strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


RAW_PAPER = strings(RAW_COLUMNS)
RELEVANCE = strings(RELEVANCE_FIELDS)
METADATA = strings(METADATA_FIELDS)
CONFERENCE_PAPER = StructType(
    [
        StructField("year", IntegerType()),
        *(StructField(n, StringType()) for n in CONFERENCE_COLUMNS[1:9]),
        StructField("scores", ArrayType(IntegerType())),
        StructField("keywords", ArrayType(StringType())),
        StructField("openreview_url", StringType()),
    ]
)
ATOM_ENTRY = StructType(
    [
        *(StructField(n, StringType()) for n in ("id", "title", "published", "updated", "summary", "doi", "comment", "journal_ref")),
        StructField("author", ArrayType(strings(["name", "affiliation"]))),
        StructField("category", ArrayType(strings(["_term"]))),
        StructField("primary_category", strings(["_term"])),
        StructField("link", ArrayType(strings(["_href", "_title"]))),
        StructField("_corrupt_record", StringType()),
    ]
)
