"""Decisions and scores out of ordered lists of replies.

A list stays one value per paper, so the order is kept without a shuffle: the lists are folded with
higher-order functions over VARIANT, and papers are joined to the result once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WRAPPED_FROM = 2024


def _has(note: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(note), key), F.lit(False))


def _text(note: Column, path: str) -> Column:
    return F.get_json_object(note, path)


def _content(notes: Column) -> Column:
    """The replies' contents as JSON texts, in order; a reply may hold them under ``content``."""
    items = F.from_json(notes, "array<string>")
    return F.transform(items, lambda x: F.when(_has(x, "content"), _text(x, "$.content")).otherwise(x))


def _unwrapped(note: Column, key: str, unwrap: Column) -> Column:
    """The text of a key; ``{"value": ...}`` is unwrapped where asked for, else its JSON text stays."""
    value = _text(note, f"$.{key}")
    wrapped = value.startswith("{")
    return F.when(wrapped & unwrap, F.coalesce(_text(note, f"$.{key}.value"), F.lit(""))).otherwise(value)


def decision_of(notes: Column, year: Column) -> Column:
    """The first reply that decides: decision, withdrawal, desk rejection, recommendation; null if none does."""

    def hit(note: Column) -> Column:
        return (
            F.when(_has(note, "decision"), F.coalesce(_unwrapped(note, "decision", year >= WRAPPED_FROM), F.lit("")))
            .when(_has(note, "withdrawal_confirmation"), "Withdrawn")
            .when(_has(note, "desk_reject_comments"), "Desk rejected")
            .when(_has(note, "recommendation"), F.coalesce(_unwrapped(note, "recommendation", F.lit(True)), F.lit("")))
            .when(_text(note, "$.withdrawal") == "Confirmed", "Withdrawn")
        )

    return F.get(F.filter(F.transform(_content(notes), hit), lambda x: x.isNotNull()), 0)


def scores_of(notes: Column, year: Column) -> Column:
    """Ratings in order: the whole number before a colon, or a number truncated; others are left out."""

    def score(note: Column) -> Column:
        raw = _unwrapped(note, "rating", year >= WRAPPED_FROM)
        # numbers and strings both come as text; the reply itself tells which it is
        number = F.regexp_like(note, F.lit(r'"rating"\s*:\s*(?:\{\s*"value"\s*:\s*)?-?[0-9.]'))
        whole = F.get(F.split(raw, ":"), F.lit(0)).try_cast("int")
        return F.when(number, raw.try_cast("double").cast("int")).otherwise(whole)

    return F.array_compact(F.transform(_content(notes), score))


def with_decisions(papers: DataFrame, notes: DataFrame, decisions: bool = True, scores: bool = True, force: bool = False) -> DataFrame:
    """Papers with decisions and scores from their forums.

    A paper without replies keeps what it has. A decision that a paper has already is kept; with scores
    alone, papers that have a decision are left as they are, unless ``force``.
    """
    found = notes.dropDuplicates(["forum"]).select(F.col("forum").alias("id"), F.col("notes").alias("_notes"))
    both = papers.join(found, "id", "left")
    undecided = F.coalesce(F.col("decision"), F.lit("")) == ""
    seen = F.col("_notes").isNotNull()
    if decisions:
        both = both.withColumn("decision_", F.when(undecided & seen, F.coalesce(decision_of(F.col("_notes"), F.col("year")), F.lit(""))).otherwise(F.coalesce("decision", F.lit(""))))
    if scores:
        due = seen if decisions or force else seen & undecided
        both = both.withColumn("scores_", F.when(due, scores_of(F.col("_notes"), F.col("year"))).otherwise(F.coalesce("scores", F.array().cast("array<int>"))))
    return both.select(*(F.col(f"{c}_").alias(c) if f"{c}_" in both.columns else F.col(c) for c in papers.columns))
