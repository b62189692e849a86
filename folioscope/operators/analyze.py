"""Descriptive analytics. Every function maps a DataFrame to a DataFrame and stays lazy.

Columns that an input lacks make an analysis empty, never an error. Counts are partially aggregated
on the map side; percentages use a scalar subquery over the same scan instead of a join.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import icontains, imatches, is_yes, np_round1, pct, tokens
from ..schemas import ID_COLUMNS, SCALES

COUNTS = "value string, n bigint"


def has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def value_counts(df: DataFrame, column: str, over: str = "all") -> DataFrame:
    """(value, n, pct) of the values that are not null; pct over all rows, or over ``non_null`` ones."""
    if not has(df, column):
        return _empty(df, COUNTS + ", pct double")
    c = F.col(f"`{column}`")
    total = df.agg(F.count("*" if over == "all" else c)).scalar()
    return df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("pct", pct(F.col("n"), total))


def token_counts(df: DataFrame, column: str, sep: str = ",", drop_empty: bool = False) -> DataFrame:
    """(value, n) of the tokens of a packed column: split at ``sep``, stripped, every occurrence counted."""
    if not has(df, column):
        return _empty(df, COUNTS)
    c = F.col(f"`{column}`")
    found = df.where(c.isNotNull()).select(F.explode(tokens(c, sep)).alias("value"))
    return (found.where("value != ''") if drop_empty else found).groupBy("value").agg(F.count("*").alias("n"))


def list_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the elements of an array column, stripped; empty ones are left out."""
    return df.select(F.explode(F.col(f"`{column}`")).alias("value")).where("value != ''").groupBy("value").agg(F.count("*").alias("n"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent; ties by value."""
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def ordered_categories(df: DataFrame, column: str, order: list[str] | None = None, zero_fill: bool = True) -> DataFrame:
    """(value, ord, n) in the given order; absent ones are 0, or left out. Values off the list are dropped."""
    order = SCALES if order is None else order
    dimension = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(order)), "ord int, value string"))  # a row per category of the argument
    counts = value_counts(df.where(F.col(f"`{column}`").isin(*order)), column).select("value", "n") if has(df, column) else _empty(df, COUNTS)
    return counts.join(dimension, "value", "right" if zero_fill else "inner").select("value", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification(df: DataFrame, column: str = "is_dataset_paper") -> DataFrame:
    """(positive, other, total): rows that say yes and all others, nulls among them."""
    yes = is_yes(F.col(column))
    return df.agg(F.count_if(yes).alias("positive"), F.count_if(~yes).alias("other"), F.count("*").alias("total"))


def date_of(c: Column) -> Column:
    """The date of an ISO date or timestamp string, null if it is none or doesn't exist."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), F.substring(c, 1, 10).try_cast("date"))


def yearly_counts(df: DataFrame, column: str) -> DataFrame:
    """(year, n) by calendar year, in its order; dates that can't be read are left out."""
    return df.select(F.year(date_of(F.col(f"`{column}`"))).alias("year")).where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


def share_by_year(df: DataFrame, column: str, matches: Column, zero_fill: bool = False) -> DataFrame:
    """(year, total, share): percentage of matching rows, one decimal half to even, null where none match."""
    hit = F.coalesce(matches, F.lit(False))
    by = df.select(F.year(date_of(F.col(f"`{column}`"))).alias("year"), hit.alias("hit")).where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))
    hits = F.col("hits") if zero_fill else F.nullif("hits", F.lit(0))
    return by.select("year", "total", np_round1(pct(hits, F.col("total"))).alias("share"))


def llm_involved(c: Column, strict: bool = False) -> Column:
    """Mentions LLM (which "No LLM" does too), or, strictly, one of the answers that mean it."""
    return F.coalesce(c.isin("Generated", "Assisted", "Filtering"), F.lit(False)) if strict else icontains(c, "LLM")


def summary(df: DataFrame, date_column: str = "publication_date") -> DataFrame:
    """(total, first, last): rows and range of the date strings."""
    c = F.col(f"`{date_column}`")
    return df.agg(F.count("*").alias("total"), F.min(c).alias("first"), F.max(c).alias("last"))


def completeness(df: DataFrame, leave_out: list[str] | None = None) -> DataFrame:
    """(column, present, missing, pct_missing) of every column, in one pass."""
    columns = [c for c in df.columns if c not in (ID_COLUMNS if leave_out is None else leave_out)]
    one = df.agg(F.count("*").alias("total"), *(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)))
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("present")) for i, c in enumerate(columns)))
    missing = F.col("total") - F.col("e.present")
    return one.select("total", F.explode(entries).alias("e")).select("e.column", "e.present", missing.alias("missing"), pct(missing, F.col("total")).alias("pct_missing"))


def subset_predicates(df: DataFrame) -> dict[str, Column]:
    """The named subsets whose columns the input has."""
    wanted = {
        "new_large": (("role_in_paper", "approximate_scale"), lambda: icontains(F.col("role_in_paper"), "new") & F.coalesce(F.col("approximate_scale") == ">1M", F.lit(False))),
        "llm_generated": (("llm_involvement",), lambda: icontains(F.col("llm_involvement"), "generated")),
        "multilingual": (("language_coverage",), lambda: icontains(F.col("language_coverage"), "multilingual")),
        "safety": (("targeted_capability",), lambda: imatches(F.col("targeted_capability"), "safety|toxicity")),
        "multi_task": (("scope_of_use",), lambda: icontains(F.col("scope_of_use"), "multi-task")),
    }
    return {k: make() for k, (needed, make) in wanted.items() if has(df, *needed)}


def subset_sizes(df: DataFrame) -> DataFrame:
    """(subset, n) of all named subsets, in one pass."""
    preds = subset_predicates(df)
    if not preds:
        return _empty(df, "subset string, n bigint")
    one = df.agg(*(F.count_if(p).alias(k) for k, p in preds.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("subset"), F.col(k).alias("n")) for k in preds))).alias("e")).select("e.*")


def subset_titles(df: DataFrame, subset: str, title: str = "title", at_most: int = 10) -> DataFrame:
    """The titles of a subset if it has 1 to ``at_most`` rows, else none: the listing is the feature."""
    chosen = df.where(subset_predicates(df)[subset]).select(title)
    size = chosen.agg(F.count("*")).scalar()
    return chosen.where(size <= at_most)


def macro_mean(df: DataFrame, column: str = "scores") -> DataFrame:
    """(papers, mean): mean of the means of the rows whose list isn't empty."""
    scores = F.col(column)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return df.where(F.size(scores) > 0).agg(F.count("*").alias("papers"), F.avg(mean).alias("mean"))


def success_rate(df: DataFrame, column: str = "is_dataset_paper") -> DataFrame:
    """(hits, total, rate): rows that say exactly Yes; the rate is null for no rows."""
    hits = F.count_if(F.col(column) == "Yes")
    return df.agg(hits.alias("hits"), F.count("*").alias("total"), pct(hits, F.count("*")).alias("rate"))


def kept_removed(df: DataFrame, keep: Column) -> DataFrame:
    """(total, kept, removed) of a filter; what isn't true is removed."""
    ok = F.coalesce(keep, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("removed"))


def counts_json(counts: DataFrame) -> DataFrame:
    """One row: the counts as a JSON object, by descending count, then value. A report's size, not the data's."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "value", "n")))
    return counts.agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p.value, p.n)))).alias("json"))


def report_sections(df: DataFrame, single: list[str], multi: list[str]) -> DataFrame:
    """(section, value, n) of all value and token counts, one below the other."""
    parts = [value_counts(df, c).select(F.lit(c).alias("section"), "value", "n") for c in single]
    parts += [token_counts(df, c).select(F.lit(c).alias("section"), "value", "n") for c in multi]
    return reduce(DataFrame.unionByName, parts)


def keyword_share(df: DataFrame, column: str, word: str) -> DataFrame:
    """(pct): percentage of the rows whose text holds the word, null for no rows."""
    return df.agg((F.try_divide(F.count_if(icontains(F.col(column), word)), F.count("*")) * 100.0).alias("pct"))


def has_values(df: DataFrame, *columns: str) -> DataFrame:
    """(column, any): whether a column has a value in any row; a column that isn't there has none."""
    there = [c for c in columns if c in df.columns]
    one = df.agg(*(F.coalesce(F.max(F.col(f"`{c}`").isNotNull()), F.lit(False)).alias(c) for c in there)) if there else df.agg(F.lit(0))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"`{c}`") if c in there else F.lit(False)).alias("any")) for c in columns))).alias("e")).select("e.*")


def analysis_report(df: DataFrame, single: list[str], multi: list[str], date_column: str = "publication_date", flag: str = "is_dataset_paper") -> DataFrame:
    """(section, value, n, n_accepted, pct) of the whole analysis, in one pass over the rows and one aggregation.

    Every row gives its pairs of section and value: a pair a single-value column (nulls too), a pair a token of a
    multi-value column, its year, its yes or no, the subsets it is in and the columns it fills. Pairs are counted in
    every task before they move, so the shuffle has a row a distinct value and task. ``n_accepted`` counts the rows
    that say yes: the charts' data. ``pct`` is over all rows; a section of tokens has none. Null values are the empty
    sections' totals: the row (``rows``, null) counts all rows.
    """
    single, multi = [c for c in single if has(df, c)], [c for c in multi if has(df, c)]

    def pair(section: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"))

    pairs = [F.array(pair("rows", F.lit(None)))]
    pairs += [F.array(pair(c, F.col(f"`{c}`"))) for c in single]
    pairs += [F.transform(tokens(F.col(f"`{c}`")), partial(pair, c)) for c in multi]
    if has(df, date_column):
        year = F.year(date_of(F.col(f"`{date_column}`")))
        pairs.append(F.when(year.isNotNull(), F.array(pair("year", year))))
        if has(df, "llm_involvement"):
            pairs.append(F.when(year.isNotNull() & llm_involved(F.col("llm_involvement")), F.array(pair("year with LLM", year))))
    if has(df, flag):
        pairs.append(F.array(pair("classification", F.when(is_yes(F.col(flag)), "positive").otherwise("other"))))
    pairs += [F.when(p, F.array(pair("subset", F.lit(k)))) for k, p in subset_predicates(df).items()]
    pairs += [F.when(F.col(f"`{c}`").isNotNull(), F.array(pair("present", F.lit(c)))) for c in df.columns if c not in ID_COLUMNS]
    yes = is_yes(F.col(flag)) if has(df, flag) else F.lit(True)
    nothing = F.array().cast("array<struct<section:string,value:string>>")
    one = df.select(yes.alias("yes"), F.explode(F.flatten(F.array(*(F.coalesce(p, nothing) for p in pairs)))).alias("p"))
    counts = one.groupBy("p.section", "p.value").agg(F.count("*").alias("n"), F.count_if("yes").alias("n_accepted"))
    total = df.agg(F.count("*")).scalar()  # of the files' footers: no column is read
    whole = F.when(~F.col("section").isin(*multi), pct(F.col("n"), total)) if multi else pct(F.col("n"), total)
    return counts.select("section", "value", "n", "n_accepted", whole.alias("pct"))
