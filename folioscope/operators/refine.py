"""Filters, splits, unions and slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, icontains, is_yes
from ..schemas import CATEGORIES, RENAMED
from .analyze import date_of


def date_window(column: str, start: str, end: str) -> Column:
    """ISO strings between two dates, both included; blank dates pass."""
    c = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    return (c == "") | c.between(start, end)


def on_or_before(column: str, cutoff: str) -> Column:
    """Dates up to the cutoff, included; dates that can't be read fail. A bad cutoff raises."""
    return F.coalesce(date_of(F.col(f"`{column}`")) <= F.to_date(F.lit(cutoff), "yyyy-MM-dd"), F.lit(False))


def min_length(column: str, n: int = 100) -> Column:
    """At least ``n`` code points; null counts as empty."""
    return F.length(F.coalesce(F.col(column), F.lit(""))) >= n


def venue_contains(keyword: str, column: str = "venue") -> Column:
    return icontains(F.col(column), keyword)


def primary_category(column: str = "Primary Category", categories: list[str] | None = None) -> Column:
    return F.coalesce(F.col(f"`{column}`").isin(*(categories or CATEGORIES)), F.lit(False))


def split_yes(df: DataFrame, column: str = "is_dataset_paper") -> tuple[DataFrame, DataFrame]:
    """(rows that say yes, all others including null)."""
    yes = is_yes(F.col(column))
    return df.where(yes), df.where(~yes)


def reunion(*frames: DataFrame) -> DataFrame:
    """Bag union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_batches(frames: list[DataFrame], key: list[str] | None = None) -> DataFrame:
    """Union of batches; with a key, one row of each."""
    merged = reunion(*frames)
    return merged.dropDuplicates(key) if key else merged


def keep_latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (a total one)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def slice_rows(df: DataFrame, order: list[Column], start: int = 0, most: int | None = None) -> DataFrame:
    """Rows ``start`` to ``start + most`` of an explicit order; ``most`` 0 or None: no end."""
    df = df.orderBy(*order).offset(start)
    return df.limit(most) if most else df


def rename_clean(df: DataFrame) -> DataFrame:
    """The record's names in snake case, every string collapsed and without nulls."""
    df = df.withColumnsRenamed(RENAMED)
    return df.select(*(clean_text(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def dataset_title_or_abstract(title: str, abstract: str, word: str = "dataset") -> Column:
    return icontains(F.col(f"`{title}`"), word) | icontains(F.col(f"`{abstract}`"), word)
