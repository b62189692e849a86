"""Queries that pass the given tables through the sources and sinks: feed entries, notes, files, streams.

The tables are first put into the shape a source delivers, then read by the source's own operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import collapse_ws
from ..operators import analyze as A
from ..operators import enrich as X
from ..operators import resolve
from ..schemas import CONFERENCE_COLUMNS
from ..session import scratch_path, table
from ..sinks import write_csv, write_papers, write_text_report
from ..sources.atom import papers_and_rejects, read_atom
from ..sources.notes import WRAPPED_FROM, conference_papers
from ..sources.paged import crawl_totals, distinct_requests, notes_of_pages
from ..sources.tables import read_csv, read_metadata
from ..streaming import jobs
from .reference import META, _collapse, _counts_sql, _decision_sql, _json_list_sql, _na, _query_type, _query_type_sql, _score_sql, _strip, _tokens_sql

QUERIES = {}
ORACLE_SQL = {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


# feed entries: S3-S6, P1-P7
_FEED_TEXT = {"Title": "title", "Abstract": "summary", "DOI": "doi", "Comment": "comment", "Journal Reference": "journal_ref"}


def _feeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition inside one feed element, as a document has one root: the reader ends a file after its first."""
    line = lambda text: pa.RecordBatch.from_pydict({"value": [text]})
    yield line("<feed>")
    yield from batches
    yield line("</feed>")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as Atom entries in the shared folder, read from there."""
    # characters that XML can't hold aside, as a feed has none
    clean = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    fields = [clean("arXiv URL").alias("id"), *(clean(c).alias(tag) for c, tag in _FEED_TEXT.items())]
    fields += [F.when(F.col("`Authors`").isNotNull(), F.array(F.struct(collapse_ws(clean("Authors")).alias("name")))).alias("author")]
    fields += [F.struct(F.coalesce(collapse_ws(clean("Primary Category")), F.lit("")).alias("_term")).alias("primary_category")]
    entry = F.regexp_replace(F.to_xml(F.struct(*fields), {"rowTag": "entry"}), r"[\r\n]+", " ")
    path = scratch_path(spark, "feed")
    # a partition is a file, whatever the session says of records a file
    table(spark, sf_dir, "arxiv_results").select(entry.alias("value")).mapInArrow(_feeds, "value string").write.option("maxRecordsPerFile", 0).text(path)
    return read_atom(spark, path)


def _feed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = papers_and_rejects(_entries(spark, sf_dir))
    return good.select(F.col("arXiv ID").alias("paper"), F.md5(collapse_ws(F.col("Title"))).alias("title"), F.md5(collapse_ws(F.col("Abstract"))).alias("abstract"), "DOI", F.col("Primary Category").alias("primary_category"))


def _feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = papers_and_rejects(_entries(spark, sf_dir))
    return bad.groupBy(F.col("_bad").alias("reason")).agg(F.count("*").alias("n"))


# notes, flat or wrapped by year: P8-P16, S9-S11
def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, query_type, note) of every paper, in the form of its year."""
    values = {"title": F.col("title"), "abstract": F.col("abstract"), "keywords": F.col("keywords"), "authors": F.split("authors", ", "), "authorids": F.split("author_ids", ", "), "venue": F.col("venue"), "primary_area": F.col("primary_area")}

    def note(wrap: bool) -> Column:
        content = F.struct(*((F.when(v.isNotNull(), F.struct(v.alias("value"))) if wrap else v).alias(k) for k, v in values.items()))
        return F.to_json(F.struct(F.col("id").alias("forum"), content.alias("content")))

    return table(spark, sf_dir, "openreview_papers").select("year", _query_type().alias("query_type"), F.when(F.col("year") < WRAPPED_FROM, note(False)).otherwise(note(True)).alias("note"))


def _papers_of(notes: DataFrame) -> DataFrame:
    papers = conference_papers(notes, "https://example.org/forum?id=")
    return papers.select(*(F.array_join(c, "|").alias(c) if c == "keywords" else F.size(c).alias(c) if c == "scores" else F.md5(c).alias(c) if c in ("title", "abstract") else F.col(c) for c in CONFERENCE_COLUMNS))


def _paged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes as pages of one note each, as a scan delivers them, taken apart again."""
    group = F.concat_ws("/", F.col("year").cast("string"), "query_type")
    pages = _notes(spark, sf_dir).select(group.alias("group"), F.lit(0).alias("start"), F.lit("").alias("url"), F.lit(1).alias("n_items"), F.concat(F.lit('{"notes":['), "note", F.lit("]}")).alias("page"))
    return pages


_by_year = lambda c, first: f"CASE WHEN year >= {first} THEN coalesce({c}, '') ELSE '' END AS {c}"
_papers_sql = f"""SELECT year, id, md5({_strip("coalesce(title, '')")}) AS title, md5({_strip("coalesce(abstract, '')")}) AS abstract, coalesce(authors, '') AS authors,
    {_by_year("author_ids", 2021)}, {_by_year("venue", 2024)}, {_by_year("primary_area", 2024)}, CASE WHEN decision IN ('Withdrawn', 'Desk rejected', 'Reject') THEN decision ELSE '' END AS decision,
    0::INTEGER AS scores, coalesce(array_to_string(list_transform(keywords, lambda x: lower(x)), '|'), '') AS keywords, 'https://example.org/forum?id=' || id AS openreview_url FROM openreview_papers"""
_clean = lambda c: f"""trim(regexp_replace(regexp_replace("{c}", '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{FFFE}}\\x{{FFFF}}]', '', 'g'), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"""
_titled = f"coalesce({_clean('Title')}, '') <> ''"
add(
    "feed_entries",
    _feed_papers,
    f"""SELECT coalesce(list_extract(string_split({_clean("arXiv URL")}, '/abs/'), -1), '') AS paper, md5({_clean("Title")}) AS title, md5(coalesce({_clean("Abstract")}, '')) AS abstract, coalesce({_clean("DOI")}, '') AS "DOI", "Primary Category" AS primary_category
    FROM arxiv_results WHERE {_titled} AND "Primary Category" IN ('cs.CL', 'cs.LG', 'cs.IR', 'cs.HC', 'cs.SI', 'cs.CY', 'cs.MA', 'cs.MM', 'cs.DL')""",
)
add("feed_rejects", _feed_rejects, f"SELECT 'no title' AS reason, count(*)::BIGINT AS n FROM arxiv_results WHERE NOT ({_titled}) HAVING count(*) > 0")
add("notes_to_papers", lambda s, d: _papers_of(_notes(s, d)), _papers_sql)
add("paged_notes", lambda s, d: _papers_of(notes_of_pages(_paged_notes(s, d))), _papers_sql)
add("crawl_totals", lambda s, d: crawl_totals(_paged_notes(s, d)), f"SELECT count(*)::BIGINT AS pages, count(*)::BIGINT AS items, count(DISTINCT concat_ws('/', year, {_query_type_sql}))::BIGINT AS groups FROM openreview_papers")
add("distinct_requests", lambda s, d: distinct_requests(table(s, d, "openreview_papers").select("id", "year"), ["id"]).select("id"), "SELECT DISTINCT id FROM openreview_papers")

# decisions left alone, scores of undecided papers only: F21
add(
    "scores_of_undecided",
    lambda s, d: resolve.with_decisions(table(s, d, "openreview_papers"), table(s, d, "forum_notes"), decisions=False).select("id", "decision", F.size("scores").alias("n_scores")),
    _json_list_sql(f", f AS (SELECT forum, count(score) AS n FROM ({_score_sql}) GROUP BY forum) SELECT p.id, p.decision, (CASE WHEN f.forum IS NOT NULL AND coalesce(p.decision, '') = '' THEN f.n ELSE coalesce(len(p.scores), 0) END)::INTEGER AS n_scores FROM openreview_papers p LEFT JOIN f ON f.forum = p.id"),
)


# sinks: K1, K4, K6, K9
def _csv_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch_path(spark, "csv"), table(spark, sf_dir, "arxiv_results").select(F.col("row_id").cast("string").alias("row_id"), "DOI", "Primary Category", "batch_no")
    for part in (rows.where("batch_no <= 20"), rows.where("batch_no > 20")):
        write_csv(part.drop("batch_no"), path, "append")
    return read_csv(spark, path, rows.drop("batch_no").schema, na=False).select("row_id", F.coalesce("DOI", F.lit("")).alias("doi"), F.coalesce("Primary Category", F.lit("")).alias("primary_category"))


def _text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    write_text_report(A.report_sections(read_metadata(spark, sf_dir), ["output_type", "scope_of_use"], ["relationship_to_prior"]), path)
    return spark.read.text(path).select(F.trim("value").alias("line"))


def _papers_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "papers")
    write_papers(table(spark, sf_dir, "openreview_papers").select("id", "year", "decision"), path)
    return spark.read.parquet(path)


add("csv_append", _csv_append, """SELECT row_id::VARCHAR AS row_id, coalesce("DOI", '') AS doi, coalesce("Primary Category", '') AS primary_category FROM arxiv_results""")
add("text_report", _text_report, f"SELECT trim(printf('%-24s %-40s %8d', section, value, n)) AS line FROM (SELECT 'output_type' AS section, value, n FROM ({_counts_sql('output_type', 'all')}) UNION ALL SELECT 'scope_of_use', value, n FROM ({_counts_sql('scope_of_use', 'all')}) UNION ALL SELECT 'relationship_to_prior', value, n FROM ({_tokens_sql('relationship_to_prior')}))")
add("papers_file", _papers_file, "SELECT id, year, decision FROM openreview_papers")

# a row to any number of rows: X3
_WORDS = StructType([StructField("doc_id", LongType()), StructField("word", StringType())])
add(
    "row_to_rows",
    lambda s, d: X.expanded(table(s, d, "documents").select("doc_id", "text"), lambda r: [{"doc_id": r["doc_id"], "word": w} for w in (r["text"] or "").split(" ") if w], _WORDS).groupBy("doc_id").agg(F.count("*").alias("n")),
    "SELECT doc_id, count(*)::BIGINT AS n FROM documents, unnest(string_split(text, ' ')) AS u(w) WHERE w <> '' GROUP BY doc_id",
)

# keep-first deduplication of a stream with repeated keys: T4
add("stream_first_of_user", lambda s, d: jobs.run_available(jobs.first_of_key(jobs.stream_table(s, d, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")), "SELECT DISTINCT user_id, event_type FROM events")
