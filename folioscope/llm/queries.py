"""The pN_ queries of the llm operators and their SQL twins where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..plans.packed import PACKED_FIELDS, packed_lists
from ..functions.text import is_missing
from . import canonical, containers, history, linkage, names, spans, terms, tokens


CANONICAL_FIELDS = ["role_in_paper", "task_family", "domain", "language_coverage"]
TERM_FIELDS = ["targeted_capability", "categories"]
BATCHES_AT_ONCE = 16


def _mapped(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    cells = canonical.typed_cells(table(spark, sf_dir, "enriched_metadata"), "meta_id", CANONICAL_FIELDS)
    return canonical.map_values(cells, table(spark, sf_dir, "canonical_values"), exact)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry meant by every cell that is not written as the list has it."""
    return _mapped(spark, sf_dir, False).select(F.col("rec_id").alias("meta_id"), "field_name", "canon_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with their number of cells."""
    return _mapped(spark, sf_dir, False).where("canon_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("n_cells"))


def _keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "openreview_papers").select(F.lit("keywords").alias("field_name"), F.col("keywords").alias("items"))


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, rows and mark of every term of the three fields."""
    lists = packed_lists(spark, sf_dir, *TERM_FIELDS).select("field_name", "items").unionByName(_keyword_lists(spark, sf_dir))
    sources = {f: PACKED_FIELDS[f][0] for f in TERM_FIELDS} | {"keywords": "openreview_papers"}
    totals = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(f).alias("field_name"), F.count("*").alias("rows")) for f, t in sources.items()])
    return terms.marked_terms(terms.term_counts(lists), totals)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms too rare or too common to be useful."""
    return p2_terms(spark, sf_dir).where("mark IS NOT NULL").select("field_name", "term", "mark")


def p2_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the keywords alone, whose cells need no splitting."""
    return terms.term_counts(_keyword_lists(spark, sf_dir))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "arxiv_results").select("row_id", "batch_no", F.col("arXiv ID").alias("paper_id"), F.col("Title").alias("title"))
    return history.same_papers(rows, BATCHES_AT_ONCE)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row of a paper that came before, the paper's first row."""
    return history.duplicates(_papers(spark, sf_dir))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with its confidence."""
    rows = table(spark, sf_dir, "arxiv_results").select("row_id", "batch_no", F.col("arXiv ID").alias("paper_id"), F.col("Title").alias("title"), F.col("Authors").alias("authors"), F.col("Abstract").alias("abstract"))
    entities = table(spark, sf_dir, "openreview_papers").where("id IS NOT NULL").select(F.col("id").alias("entity"), "title", "authors", "abstract")
    return linkage.link_sources(rows, entities).withColumnRenamed("entity", "paper_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs whose confidence accepts them."""
    return p4_links(spark, sf_dir).where(F.col("confidence") >= linkage.MATCH).select("row_id", "paper_id")


def _person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.distinct_names(packed_lists(spark, sf_dir, "authors").select(F.explode("items").alias("name")))


def _body_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("Author Affiliations")
    pieces = table(spark, sf_dir, "arxiv_results").where(~is_missing(cell)).select(F.explode(F.split(cell, "; ")).alias("piece"))
    return names.distinct_names(pieces.where(F.col("piece").contains(": ")).select(F.expr("substring(piece, instr(piece, ': ') + 2)").alias("name")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one person or body."""
    persons = names.entity_pairs(names.person_entities(_person_names(spark, sf_dir)))
    bodies = names.entity_pairs(names.body_entities(_body_names(spark, sf_dir)))
    return persons.select(F.lit("person").alias("kind"), "*").unionByName(bodies.select(F.lit("body").alias("kind"), "*"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of each spelling that has another one: what the pairs of p5_found come from, a row a spelling."""
    persons, bodies = names.person_entities(_person_names(spark, sf_dir)), names.body_entities(_body_names(spark, sf_dir))
    return persons.select(F.lit("person").alias("kind"), "name", "entity").unionByName(bodies.select(F.lit("body").alias("kind"), "name", "entity"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by byte_bpe_50k."""
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with tokens in containers of 2,048 byte_bpe_50k tokens."""
    return containers.pack_items(tokens.token_counts(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common verbatim passage of 200 characters or more."""
    return spans.SharedSpans(table(spark, sf_dir, "documents")).pairs()


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal shared stretches of each document at their original offsets."""
    return spans.SharedSpans(table(spark, sf_dir, "documents")).passages()


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the number of its characters that stand in shared passages (0 if none)."""
    docs = table(spark, sf_dir, "documents")
    per_doc = spans.SharedSpans(docs).passages().groupBy("doc_id").agg(F.sum("n_chars").alias("shared_chars"), F.sum("repeated").alias("repeated_chars"))
    zero = F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("shared_chars", zero).alias("shared_chars"), F.coalesce("repeated_chars", zero).alias("repeated_chars"))


def p9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that stay if of equal lines the earliest alone is kept, at their original offsets."""
    return spans.kept_lines(spans.line_units(table(spark, sf_dir, "documents")))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_terms": p2_terms, "p2_keywords": p2_keywords, "p3_found": p3_found, "p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p5_entities": p5_entities, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_passages": p9_passages, "p9_shared": p9_shared, "p9_lines": p9_lines}

ORACLE_SQL: dict[str, str] = {
    "p2_keywords": r"""
        SELECT 'keywords' AS field_name, term, count(*)::BIGINT AS occurrences, count(DISTINCT rec)::BIGINT AS records
        FROM (SELECT rec, lower(trim(regexp_replace(k, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+', ' ', 'g'))) AS term
              FROM (SELECT row_number() OVER () AS rec, keywords FROM openreview_papers), unnest(keywords) AS u(k))
        WHERE term <> ''
        GROUP BY term""",
}
