"""Queries of the packed-cell operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dialects import packed_cells, split_cells, split_packed
from ..session import table

# field_name: table, id column, cell column
PACKED_FIELDS = {
    "authors": ("arxiv_results", "row_id", "Authors"),
    "categories": ("arxiv_results", "row_id", "Categories"),
    "targeted_capability": ("enriched_metadata", "meta_id", "targeted_capability"),
    "intended_primary_use": ("enriched_metadata", "meta_id", "intended_primary_use"),
}


def packed_fields(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The cells of the named fields (all four by default) that are not missing."""
    cells = [packed_cells(table(spark, sf_dir, t), f, i, c) for f, (t, i, c) in PACKED_FIELDS.items() if not fields or f in fields]
    return reduce(DataFrame.unionByName, cells)


def packed_lists(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """One row per cell, as ``split_cells`` gives it."""
    return split_cells(packed_fields(spark, sf_dir, *fields))


def packed_values(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The values of the named fields (all four by default), as ``split_packed`` gives them."""
    return split_packed(packed_fields(spark, sf_dir, *fields))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of every cell that holds two or more."""
    return packed_values(spark, sf_dir).where("n_items > 1").select("field_name", "rec_id", "pos", "item")


QUERIES = {"p6_found": p6_found}
