"""Atom feeds: scan with a declared schema, projection to the raw paper record, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_newlines
from ..operators.refine import date_window, primary_category
from ..schemas import ATOM_ENTRY, RAW_COLUMNS


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry. Pages that aren't XML come with ``_corrupt_record``."""
    return spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).option("attributePrefix", "_").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(ATOM_ENTRY).load(path)


def last_piece(c: Column, sep: str) -> Column:
    """What follows the last separator; the whole string without one, empty for null."""
    return F.coalesce(F.element_at(F.split(c, r"\Q" + sep + r"\E", -1), -1), F.lit(""))


def iso_date(c: Column) -> Column:
    """The UTC date of a timestamp string as yyyy-MM-dd, empty for null. Bad strings give null."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"))


def _joined(c: Column) -> Column:
    return F.coalesce(F.array_join(c, "; "), F.lit(""))


def project_entries(entries: DataFrame) -> DataFrame:
    """The 14 columns of the raw paper record, plus ``_bad``: why an entry can't be taken, or null."""
    author, category, link = F.col("author"), F.col("category"), F.col("link")
    pdf = F.get(F.filter(link, lambda x: x._title == "pdf"), 0).getField("_href")
    with_affiliation = F.filter(author, lambda a: a["affiliation"].isNotNull())
    nameless = F.exists(author, lambda a: a["affiliation"].isNotNull() & a["name"].isNull())
    values = {
        "arXiv ID": last_piece(F.col("id"), "/abs/"),
        "arXiv URL": F.coalesce("id", F.lit("")),
        "PDF URL": F.coalesce(pdf, F.lit("")),
        "DOI": F.coalesce("doi", F.lit("")),
        "Publication Date": iso_date(F.col("published")),
        "Updated Date": iso_date(F.col("updated")),
        "Title": clean_newlines(F.col("title")),
        "Authors": _joined(F.transform(author, lambda a: a["name"])),
        "Author Affiliations": _joined(F.transform(with_affiliation, lambda a: F.concat(a["name"], F.lit(": "), a["affiliation"]))),
        "Abstract": clean_newlines(F.col("summary")),
        "Categories": _joined(F.transform(F.filter(category, lambda c: F.coalesce(c._term, F.lit("")) != ""), lambda c: c._term)),
        "Primary Category": F.coalesce(F.col("primary_category._term"), F.lit("")),
        "Comment": clean_newlines(F.col("comment")),
        "Journal Reference": clean_newlines(F.col("journal_ref")),
    }
    bad = F.when(F.col("_corrupt_record").isNotNull(), "malformed page").when(values["Title"] == "", "no title").when(F.coalesce(nameless, F.lit(False)), "affiliation without name").when(values["Publication Date"].isNull() | values["Updated Date"].isNull(), "bad date")
    return entries.select(*(v.alias(n) for n, v in values.items()), bad.alias("_bad"))


def papers_and_rejects(entries: DataFrame, start: str | None = None, end: str | None = None, categories: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records that pass the date window and the subject classes, entries that can't be read)."""
    projected = project_entries(entries)
    good = projected.where("_bad IS NULL").select(*RAW_COLUMNS)
    if start and end:
        good = good.where(date_window("Publication Date", start, end))
    return good.where(primary_category(categories=categories)), projected.where("_bad IS NOT NULL").select("arXiv URL", "_bad")
