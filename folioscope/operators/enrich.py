"""Two-stage enrichment: a cheap relevance answer for every paper, metadata for those that pass.

The model behind the answers is a *provider*, injected and called with batches of prompts inside
Arrow-batched ``mapInPandas``. The rule provider answers from keywords, so everything runs offline.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import icontains
from ..schemas import METADATA_FIELDS, RELEVANCE_FIELDS
from ..session import materialise
from .refine import rename_clean, reunion, split_yes


class Provider(Protocol):
    """Answers a batch: one dict of strings per (title, abstract), or None for an answer that failed."""

    def relevance(self, papers: list[tuple[str, str]]) -> list[dict | None]: ...

    def metadata(self, papers: list[tuple[str, str]]) -> list[dict | None]: ...


# Keywords of the rule provider: field, then (answer, words that give it), the first that fits.
RULES: dict[str, list[tuple[str, list[str]]]] = {
    "role_in_paper": [("New version", [" 2.0", " ii "]), ("Reannotation", ["reannotat", "relabel"]), ("New dataset", ["dataset", "corpus", "benchmark", "treebank", "collection"]), ("Only existing", [""])],
    "intended_primary_use": [("Evaluation", ["benchmark", "test suite", "challenge set", "evaluat"]), ("Pretraining", ["pretrain"]), ("Fine-tuning", [""])],
    "scope_of_use": [("Multi-task", ["multi-task", "multi-domain"]), ("Domain-specific", ["clinical", "insurance", "legal"]), ("General purpose", [""])],
    "task_family": [("Machine translation", ["translation"]), ("Question answering", ["question answering"]), ("Summarization", ["summarization"]), ("Text classification", [""])],
    "targeted_capability": [("reasoning", ["reasoning"]), ("safety", ["safety", "toxicity"]), ("language understanding", [""])],
    "output_type": [("Generation", ["generation", "translation", "summarization"]), ("Span", ["answering"]), ("Categorical", [""])],
    "language_coverage": [("Multilingual", ["multilingual", "cross-lingual"]), ("English only", [""])],
    "domain": [("Clinical", ["clinical"]), ("News", ["news"]), ("General web text", [""])],
    "source_of_text": [("newswire", ["news"]), ("web pages", [""])],
    "collection_method": [("Human annotation", ["annotat"]), ("Automatic extraction", [""])],
    "llm_involvement": [("Generated", ["machine-made", "synthetic"]), ("No LLM", [""])],
    "approximate_scale": [(">1M", ["large-scale"]), ("<10K", ["small"]), ("10K-100K", [""])],
    "relationship_to_prior": [("Re-annotation", ["reannotat"]), ("Filtered", ["filter"]), ("From scratch", [""])],
    "claimed_contribution": [("New task", ["new task"]), ("New scale", ["large-scale"]), ("New domain", [""])],
}
RELEVANT_WORDS = ["dataset", "corpus", "benchmark", "treebank", "collection", "test suite", "challenge set", "resource"]


class RuleProvider:
    """Deterministic answers from keywords in title and abstract, as native expressions (:meth:`columns`) or in batches."""

    def columns(self, stage: str, text: Column) -> list[Column]:
        """The stage's answer fields; none of them needs Python."""
        if stage == "metadata":
            return [rule_column(f, text).alias(f) for f in METADATA_FIELDS]
        first = F.coalesce(*(F.when(icontains(text, w), w) for w in RELEVANT_WORDS))
        said = F.coalesce(F.concat(F.lit("mentions "), first), F.lit("mentions no dataset"))
        return [F.when(first.isNotNull(), "Yes").otherwise("No").alias("is_dataset_paper"), said.alias("skip_reasoning")]

    def relevance(self, papers: list[tuple[str, str]]) -> list[dict | None]:
        out = []
        for title, abstract in papers:
            text = f"{title} {abstract}".lower()
            hit = next((w for w in RELEVANT_WORDS if w in text), None)
            out.append({"is_dataset_paper": "Yes" if hit else "No", "skip_reasoning": f"mentions {hit}" if hit else "mentions no dataset"})
        return out

    def metadata(self, papers: list[tuple[str, str]]) -> list[dict | None]:
        texts = [f"{t} {a}".lower() for t, a in papers]
        return [{f: next(answer for answer, words in rules if any(w in text for w in words)) for f, rules in RULES.items()} for text in texts]


def rule_column(field: str, text: Column) -> Column:
    """The rule provider's answer as a native expression."""
    out = None
    for answer, words in RULES[field]:
        hit = F.lit(False)
        for w in words:
            hit = hit | (F.lit(True) if w == "" else icontains(text, w))
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    return out


def with_retry(call: Callable[[list], list], papers: list, retries: int = 1, wait: float = 0.0) -> list:
    """The call's answers; after the last failure, None for each."""
    for left in range(retries, -1, -1):
        try:
            return call(papers)
        except Exception:  # noqa: BLE001 - a provider may fail in any way
            if left and wait:
                time.sleep(wait)
    return [None] * len(papers)


def answers(df: DataFrame, provider: Provider, stage: str, title: str = "Title", abstract: str = "Abstract", keep: list[str] | None = None) -> DataFrame:
    """The input's columns and the stage's answer fields; a failed answer leaves them null."""
    fields = RELEVANCE_FIELDS if stage == "relevance" else METADATA_FIELDS
    if type(provider) is RuleProvider:
        text = F.concat_ws(" ", F.coalesce(F.col(f"`{title}`"), F.lit("")), F.coalesce(F.col(f"`{abstract}`"), F.lit("")))
        return df.select(*(F.col(f"`{c}`") for c in (keep or df.columns) if c not in fields), *provider.columns(stage, text))
    names = [c for c in (keep or df.columns) if c not in fields]
    schema = StructType([*(df.schema[c] for c in names), *(StructField(f, StringType()) for f in fields)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            papers = [(t or "", a or "") for t, a in zip(b[title], b[abstract], strict=True)]
            found = with_retry(getattr(provider, stage), papers)
            for f in fields:
                b[f] = [None if x is None else x.get(f) for x in found]
            yield b[[*names, *fields]]

    return df.mapInPandas(run, schema)


def expanded(df: DataFrame, parse: Callable[[dict], list[dict]], schema: StructType) -> DataFrame:
    """Row to rows: ``parse`` gives any number of rows for one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for x in b.to_dict("records") for r in parse(x)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.mapInPandas(run, schema)


def enrich(papers: DataFrame, provider: Provider, skip_relevance: bool = False, title: str = "Title", abstract: str = "Abstract") -> DataFrame:
    """Accepted papers with 14 fields, then rejected ones without; records renamed and cleaned.

    A provider's relevance answers are kept before the split, so that no paper is asked twice.
    """
    if skip_relevance:
        return rename_clean(answers(papers, provider, "metadata", title, abstract).withColumn("is_dataset_paper", F.lit("Yes")))
    asked = answers(papers, provider, "relevance", title, abstract)
    if type(provider) is not RuleProvider:
        asked = materialise(asked)
    yes, no = split_yes(asked)
    yes = answers(yes, provider, "metadata", title, abstract).withColumn("is_dataset_paper", F.lit("Yes"))
    return rename_clean(reunion(yes, no))


def relevance_prompt(template: str, title: Column, abstract: Column) -> Column:
    """The template with its two places filled; nulls are empty."""
    return F.replace(F.replace(F.lit(template), F.lit("{title}"), F.coalesce(title, F.lit(""))), F.lit("{abstract}"), F.coalesce(abstract, F.lit("")))


def parsed_answers(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """Adds the fields of a JSON answer column, validated by the schema; an answer that isn't JSON gives nulls."""
    return df.withColumn("_answer", F.from_json(F.col(column), schema)).select(*df.columns, "_answer.*")


def dumps(answer: dict) -> str:
    return json.dumps(answer, ensure_ascii=False)
