"""Review-platform notes, flat or wrapped by year, as conference papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pystrip
from ..schemas import CONFERENCE_COLUMNS

WRAPPED_FROM = 2024


def _value(c: Column, key: str, year: Column, kind: str = "string") -> Column:
    flat, wrapped = F.try_variant_get(c, f"$.{key}", kind), F.try_variant_get(c, f"$.{key}.value", kind)
    return F.when(year < WRAPPED_FROM, flat).otherwise(wrapped)


def _list_text(c: Column, key: str, year: Column) -> Column:
    """A list joined by comma and blank; a scalar stays, if it is flat; nothing gives the empty string."""
    many = _value(c, key, year, "array<string>")
    one = F.when(year < WRAPPED_FROM, F.try_variant_get(c, f"$.{key}", "string"))
    return F.coalesce(F.array_join(many, ", "), one, F.lit(""))


def decision_of_query(query_type: Column) -> Column:
    """Withdrawn before desk rejected before rejected, since the last is part of the second."""
    return F.when(F.contains(query_type, F.lit("Withdrawn_Submission")), "Withdrawn").when(F.contains(query_type, F.lit("Desk_Rejected_Submission")), "Desk rejected").when(F.contains(query_type, F.lit("Rejected_Submission")), "Reject").otherwise("")


def conference_papers(notes: DataFrame, url_prefix: str) -> DataFrame:
    """Papers of (year, query_type, note): note is the JSON text of one note."""
    year, text = F.col("year"), F.lit("")
    note = notes.withColumn("v", F.try_parse_json("note")).where("v IS NOT NULL")
    content = F.try_variant_get("v", "$.content", "variant")
    paper_id = F.coalesce(F.try_variant_get("v", "$.forum", "string"), F.try_variant_get("v", "$.id", "string"), text)
    ids = F.when(year <= 2020, "").otherwise(_list_text(content, "authorids", year))
    recent = year >= WRAPPED_FROM
    scalar = F.when(year < WRAPPED_FROM, F.try_variant_get(content, "$.keywords", "string"))
    keywords = F.coalesce(F.transform(_value(content, "keywords", year, "array<string>"), F.lower), F.when(scalar.isNotNull() & ~scalar.startswith("["), F.array(scalar)), F.array().cast("array<string>"))
    values = {
        "year": year,
        "id": paper_id,
        "title": pystrip(F.coalesce(_value(content, "title", year), text)),
        "abstract": pystrip(F.coalesce(_value(content, "abstract", year), text)),
        "authors": _list_text(content, "authors", year),
        "author_ids": ids,
        "venue": F.when(recent, F.coalesce(_value(content, "venue", year), text)).otherwise(""),
        "primary_area": F.when(recent, F.coalesce(_value(content, "primary_area", year), text)).otherwise(""),
        "decision": decision_of_query(F.col("query_type")),
        "scores": F.array().cast("array<int>"),
        "keywords": keywords,
        "openreview_url": F.concat(F.lit(url_prefix), paper_id),
    }
    return note.select(*(values[c].alias(c) for c in CONFERENCE_COLUMNS))
