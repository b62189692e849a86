"""Writers: CSV in three flavours, Parquet, JSON and text reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import clean_text

# The text columns that the quoted CSV collapses.
QUOTED_TEXT = ["title", "abstract", "authors", "author_ids", "venue", "primary_area"]


def stamped(stem: str, suffix: str, now: datetime | None = None) -> str:
    return f"{stem}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.{suffix}"


def for_quoted_csv(papers: DataFrame) -> DataFrame:
    """Lists joined by comma and blank, text columns collapsed, backslashes doubled."""
    out = papers
    for c, t in papers.dtypes:
        if t.startswith("array"):
            out = out.withColumn(c, F.coalesce(F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ", "), F.lit("")))
        elif c in QUOTED_TEXT:
            out = out.withColumn(c, clean_text(F.col(c)))
    return out.select(*(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes))


def write_quoted_csv(papers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    for_quoted_csv(papers).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``mode="append"`` adds part files, each with its header."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_papers(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "csv":
        write_quoted_csv(df, path, mode)
    else:
        df.write.mode(mode).parquet(path)


def report_json(sections: DataFrame) -> DataFrame:
    """One JSON object per section of (section, value, n): a report's size, not the data's."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "value", "n"))), lambda p: F.struct(p.value, p.n))
    return sections.groupBy("section").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def write_text_report(sections: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line per value: section, value, count."""
    sections.orderBy("section", F.desc("n"), "value").select(F.format_string("%-24s %-40s %8d", "section", "value", "n").alias("value")).write.mode(mode).text(path)
