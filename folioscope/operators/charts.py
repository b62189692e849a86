"""The data behind the ten charts. All but the first look at accepted papers only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_yes
from .analyze import has, ordered_categories, token_counts, top, value_counts


def accepted(df: DataFrame) -> DataFrame:
    """Rows that say yes, or all if the flag is missing."""
    return df.where(is_yes(F.col("is_dataset_paper"))) if has(df, "is_dataset_paper") else df


def _top(column: str, k: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: top(value_counts(accepted(df), column), k).select("value", "n")


CHARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "classification": lambda df: value_counts(df, "is_dataset_paper", over="non_null"),
    "roles": _top("role_in_paper", 10),
    "uses": lambda df: top(token_counts(accepted(df), "intended_primary_use"), 10),
    "languages": _top("language_coverage", 10),
    "llm": lambda df: value_counts(accepted(df), "llm_involvement").select("value", "n"),
    "scales": lambda df: ordered_categories(accepted(df), "approximate_scale"),
    "tasks": _top("task_family", 15),
    "domains": _top("domain", 15),
    "contributions": lambda df: value_counts(accepted(df), "claimed_contribution").select("value", "n"),
    "scopes": lambda df: value_counts(accepted(df), "scope_of_use", over="non_null"),
}
