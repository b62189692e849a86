"""The catalogue of queries on the given tables, each with its SQL twin.

Every query reads its whole tables. A twin is plain SQL that shares no code with the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CSV_NA_TOKENS, clean_newlines, clean_text, icontains, imatches
from ..operators import analyze as A
from ..operators import enrich as X
from ..operators import refine as R
from ..operators import resolve
from ..operators.charts import CHARTS
from ..schemas import CATEGORIES, CONFERENCE_COLUMNS, CONFERENCE_PAPER, METADATA_FIELDS, MULTI_VALUE_FIELDS, RAW_COLUMNS, RENAMED, SCALES, SINGLE_VALUE_FIELDS
from ..session import scratch_path, table
from ..sinks import for_quoted_csv, report_json, write_quoted_csv
from ..sources.atom import last_piece
from ..sources.notes import decision_of_query
from ..sources.paged import feed_query_column, notes_url_column
from ..sources.tables import read_csv, read_metadata
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

META = "enriched_metadata"
_NA = ", ".join("'" + t + "'" for t in CSV_NA_TOKENS)
_WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _na(c: str) -> str:
    return f'CASE WHEN "{c}" IN ({_NA}) THEN NULL ELSE "{c}" END'


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"coalesce(trim(regexp_replace({x}, '{_WS}+', ' ', 'g')), '')"


def _meta(*columns: str, where: str = "TRUE") -> str:
    inner = ", ".join(f'{_na(c)} AS "{c}"' for c in columns)
    return f"(SELECT * FROM (SELECT {inner} FROM {META}) WHERE {where})"


_YES = "coalesce(lower(is_dataset_paper) IN ('yes', 'y'), FALSE)"
_DATE = "CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?$') THEN try_cast(substr({c}, 1, 10) AS DATE) END"


def _date(c: str) -> str:
    return _DATE.format(c=c)


def _counts_sql(c: str, over: str) -> str:
    total = f"(SELECT count(*) FROM {META})" if over == "all" else f"(SELECT count(v) FROM (SELECT {_na(c)} AS v FROM {META}))"
    return f"SELECT v AS value, count(*)::BIGINT AS n, count(*)::DOUBLE / {total}::DOUBLE * 100.0::DOUBLE AS pct FROM (SELECT {_na(c)} AS v FROM {META}) WHERE v IS NOT NULL GROUP BY v"


def _tokens_sql(c: str, where: str = "TRUE") -> str:
    source = _meta(c, "is_dataset_paper", where=where) if c != "is_dataset_paper" else _meta(c)
    return f"""SELECT value, count(*)::BIGINT AS n FROM (SELECT {_strip("t")} AS value FROM (SELECT "{c}" AS cell FROM {source}) s, unnest(string_split(cell, ',')) AS u(t) WHERE cell IS NOT NULL) GROUP BY value"""


def _json_list_sql(body: str) -> str:
    return f"""WITH e AS (SELECT k, forum, year, unnest(l) AS note, generate_subscripts(l, 1) AS pos FROM (SELECT row_number() OVER () AS k, forum, year, from_json(notes, '["JSON"]') AS l FROM forum_notes)) {body}"""


# value counts (A1-A6, A10-A12) and token counts
for _c in SINGLE_VALUE_FIELDS[:-1]:
    add(f"value_counts_{_c}", lambda s, d, c=_c: A.value_counts(read_metadata(s, d), c), _counts_sql(_c, "all"))
add("value_counts_missing_column", lambda s, d: A.value_counts(read_metadata(s, d), SINGLE_VALUE_FIELDS[-1]), "SELECT '' AS value, 0::BIGINT AS n, 0.0::DOUBLE AS pct WHERE FALSE")
for _c in MULTI_VALUE_FIELDS:
    add(f"token_counts_{_c}", lambda s, d, c=_c: A.token_counts(read_metadata(s, d), c), _tokens_sql(_c))
add("token_counts_drop_empty", lambda s, d: A.token_counts(read_metadata(s, d), "intended_primary_use", drop_empty=True), f"SELECT * FROM ({_tokens_sql('intended_primary_use')}) WHERE value <> ''")
add("keyword_counts", lambda s, d: A.list_counts(table(s, d, "openreview_papers"), "keywords"), "SELECT k AS value, count(*)::BIGINT AS n FROM openreview_papers, unnest(keywords) AS u(k) WHERE k <> '' GROUP BY k")
for _c in ("venue", "primary_area", "decision"):
    add(f"{_c}_counts", lambda s, d, c=_c: A.value_counts(table(s, d, "openreview_papers"), c), f"SELECT {_c} AS value, count(*)::BIGINT AS n, count(*)::DOUBLE / (SELECT count(*) FROM openreview_papers)::DOUBLE * 100.0::DOUBLE AS pct FROM openreview_papers WHERE {_c} IS NOT NULL GROUP BY {_c}")
add("lang_counts", lambda s, d: A.value_counts(table(s, d, "documents"), "lang"), "SELECT lang AS value, count(*)::BIGINT AS n, count(*)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE * 100.0::DOUBLE AS pct FROM documents WHERE lang IS NOT NULL GROUP BY lang")
add("classification_counts", lambda s, d: A.classification(read_metadata(s, d)), f"SELECT count(*) FILTER ({_YES})::BIGINT AS positive, count(*) FILTER (NOT {_YES})::BIGINT AS other, count(*)::BIGINT AS total FROM {_meta('is_dataset_paper')}")
add("top15_tasks", lambda s, d: A.top(A.value_counts(read_metadata(s, d), "task_family"), 15), f"SELECT * FROM ({_counts_sql('task_family', 'all')}) ORDER BY n DESC, value LIMIT 15")
add("top10_tokens", lambda s, d: A.top(A.token_counts(read_metadata(s, d), "targeted_capability"), 10), f"SELECT * FROM ({_tokens_sql('targeted_capability')}) ORDER BY n DESC, value LIMIT 10")

# ordered categories
_scales = ", ".join(f"({i}, '{v}')" for i, v in enumerate(SCALES))


def _scale_sql(join: str, where: str = "TRUE") -> str:
    return f"SELECT d.value, d.ord::INTEGER AS ord, coalesce(c.n, 0)::BIGINT AS n FROM (VALUES {_scales}) AS d(ord, value) {join} JOIN (SELECT approximate_scale AS value, count(*) AS n FROM {_meta('approximate_scale', 'is_dataset_paper', where=where)} GROUP BY 1) c ON c.value = d.value"


add("scale_zero_fill", lambda s, d: A.ordered_categories(read_metadata(s, d), "approximate_scale"), _scale_sql("LEFT"))
add("scale_present_only", lambda s, d: A.ordered_categories(read_metadata(s, d), "approximate_scale", zero_fill=False), _scale_sql(""))
_prio = ["1-URGENT", "2-HIGH", "3-MEDIUM", "6-NEVER"]
add(
    "priority_zero_fill",
    lambda s, d: A.ordered_categories(table(s, d, "orders"), "o_orderpriority", _prio),
    f"SELECT d.value, d.ord::INTEGER AS ord, coalesce(c.n, 0)::BIGINT AS n FROM (VALUES {', '.join(f'({i}, {v!r})' for i, v in enumerate(_prio))}) AS d(ord, value) LEFT JOIN (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1) c ON c.value = d.value",
)

# time (A14-A16)
add("yearly_counts", lambda s, d: A.yearly_counts(read_metadata(s, d), "publication_date"), f"SELECT year(p)::INTEGER AS year, count(*)::BIGINT AS n FROM (SELECT {_date('publication_date')} AS p FROM {_meta('publication_date')}) WHERE p IS NOT NULL GROUP BY 1")
for _name, _strict, _zero in (("llm_share_by_year", False, False), ("llm_share_by_year_strict", True, True)):
    _hit = "coalesce(llm_involvement IN ('Generated', 'Assisted', 'Filtering'), FALSE)" if _strict else "coalesce(contains(lower(llm_involvement), 'llm'), FALSE)"
    _hits = f"count(*) FILTER ({_hit})" if _zero else f"nullif(count(*) FILTER ({_hit}), 0)"
    add(
        _name,
        lambda s, d, st=_strict, z=_zero: A.share_by_year(read_metadata(s, d), "publication_date", A.llm_involved(F.col("llm_involvement"), st), z),
        f"SELECT year(p)::INTEGER AS year, count(*)::BIGINT AS total, round_even({_hits}::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE * 10, 0) / 10 AS share FROM (SELECT {_date('publication_date')} AS p, llm_involvement FROM {_meta('publication_date', 'llm_involvement')}) WHERE p IS NOT NULL GROUP BY 1",
    )
add("summary_stats", lambda s, d: A.summary(read_metadata(s, d)), f"SELECT count(*)::BIGINT AS total, min(publication_date) AS first, max(publication_date) AS last FROM {_meta('publication_date')}")
add("orders_per_year", lambda s, d: table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("o_orderkey").alias("n")), "SELECT year(o_orderdate)::INTEGER AS year, count(o_orderkey)::BIGINT AS n FROM orders GROUP BY 1")
add("papers_per_year", lambda s, d: table(s, d, "openreview_papers").groupBy("year").agg(F.count("id").alias("n")), "SELECT year, count(id)::BIGINT AS n FROM openreview_papers GROUP BY year")

# one-pass aggregates
_entries = [c for c in [*RAW_COLUMNS[1:3], "DOI", "Updated Date", "Author Affiliations", *RAW_COLUMNS[10:], "is_dataset_paper", "skip_reasoning", *METADATA_FIELDS]]
add(
    "completeness",
    lambda s, d: A.completeness(read_metadata(s, d), ["meta_id", *RENAMED.values()]),
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(v)::BIGINT AS present, (count(*) - count(v))::BIGINT AS missing, (count(*) - count(v))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS pct_missing FROM (SELECT {_na(c)} AS v FROM {META})""" for c in _entries),
)
_subset_sql = {
    "new_large": "contains(lower(role_in_paper), 'new') AND approximate_scale = '>1M'",
    "llm_generated": "contains(lower(llm_involvement), 'generated')",
    "multilingual": "contains(lower(language_coverage), 'multilingual')",
    "safety": "regexp_matches(targeted_capability, '(?i)safety|toxicity')",
    "multi_task": "contains(lower(scope_of_use), 'multi-task')",
}
_subset_columns = ["title", "role_in_paper", "approximate_scale", "llm_involvement", "language_coverage", "targeted_capability", "scope_of_use"]
add("subset_sizes", lambda s, d: A.subset_sizes(read_metadata(s, d)), " UNION ALL ".join(f"SELECT '{k}' AS subset, count(*) FILTER ({p})::BIGINT AS n FROM {_meta(*_subset_columns)}" for k, p in _subset_sql.items()))
for _k, _p in _subset_sql.items():
    add(f"subset_{_k}", lambda s, d, k=_k: read_metadata(s, d).where(A.subset_predicates(read_metadata(s, d))[k]).select("title"), f"SELECT title FROM {_meta(*_subset_columns, where=_p)}")
add("subset_titles_if_few", lambda s, d: A.subset_titles(read_metadata(s, d), "new_large"), f"SELECT title FROM {_meta(*_subset_columns, where=_subset_sql['new_large'])} WHERE (SELECT count(*) FROM {_meta(*_subset_columns, where=_subset_sql['new_large'])}) <= 10")
add("success_rate", lambda s, d: A.success_rate(read_metadata(s, d)), f"SELECT count(*) FILTER (is_dataset_paper = 'Yes')::BIGINT AS hits, count(*)::BIGINT AS total, count(*) FILTER (is_dataset_paper = 'Yes')::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS rate FROM {_meta('is_dataset_paper')}")
add("macro_avg_scores", lambda s, d: A.macro_mean(table(s, d, "openreview_papers")).select("papers", F.round("mean", 6).alias("mean")), "SELECT count(*)::BIGINT AS papers, round(avg(list_sum(scores)::DOUBLE / len(scores)), 6) AS mean FROM openreview_papers WHERE len(scores) > 0")
add("kept_removed", lambda s, d: A.kept_removed(table(s, d, "arxiv_results"), R.on_or_before("Publication Date", "2024-06-30")), f"""SELECT count(*)::BIGINT AS total, count(*) FILTER (ok)::BIGINT AS kept, count(*) FILTER (NOT ok)::BIGINT AS removed FROM (SELECT coalesce({_date('"Publication Date"')} <= DATE '2024-06-30', FALSE) AS ok FROM arxiv_results)""")
add("llm_share", lambda s, d: A.keyword_share(read_metadata(s, d), "llm_involvement", "LLM"), f"SELECT count(*) FILTER (contains(lower(llm_involvement), 'llm'))::DOUBLE / nullif(count(*), 0)::DOUBLE * 100.0::DOUBLE AS pct FROM {_meta('llm_involvement')}")
add("has_values", lambda s, d: A.has_values(table(s, d, "openreview_papers"), "venue", "decision", "track"), """SELECT 'venue' AS "column", count(venue) > 0 AS "any" FROM openreview_papers UNION ALL SELECT 'decision', count(decision) > 0 FROM openreview_papers UNION ALL SELECT 'track', FALSE""")
add("keyword_share", lambda s, d: A.keyword_share(table(s, d, "documents"), "text", "corpus"), "SELECT count(*) FILTER (contains(lower(text), 'corpus'))::DOUBLE / nullif(count(*), 0)::DOUBLE * 100.0::DOUBLE AS pct FROM documents")

# the whole analysis in one pass
def _report_sql() -> str:
    columns = [*_entries, *RENAMED.values()]
    source = f"(SELECT meta_id, {', '.join(f'{_na(c)} AS \"{c}\"' for c in columns)} FROM {META})"
    share = f"count(*)::DOUBLE / (SELECT count(*) FROM {META})::DOUBLE * 100.0::DOUBLE AS pct"
    whole = [f"SELECT 'rows' AS section, NULL::VARCHAR AS value, is_dataset_paper FROM {source}"]
    whole += [f"SELECT '{c}', {c}, is_dataset_paper FROM {source}" for c in SINGLE_VALUE_FIELDS[:-1]]
    year = f"year({_date('publication_date')})::VARCHAR"
    whole += [f"SELECT 'year', {year}, is_dataset_paper FROM {source} WHERE {year} IS NOT NULL", f"SELECT 'year with LLM', {year}, is_dataset_paper FROM {source} WHERE {year} IS NOT NULL AND contains(lower(llm_involvement), 'llm')"]
    whole += [f"SELECT 'classification', CASE WHEN {_YES} THEN 'positive' ELSE 'other' END, is_dataset_paper FROM {source}"]
    whole += [f"SELECT 'subset', '{k}', is_dataset_paper FROM {source} WHERE {p}" for k, p in _subset_sql.items()]
    whole += [f"""SELECT 'present', '{c}', is_dataset_paper FROM {source} WHERE "{c}" IS NOT NULL""" for c in ["meta_id", *_entries]]
    packed = [f"""SELECT '{c}' AS section, {_strip("t")} AS value, is_dataset_paper FROM {source} s, unnest(string_split("{c}", ',')) AS u(t) WHERE "{c}" IS NOT NULL""" for c in MULTI_VALUE_FIELDS]
    counts = f"section, value, count(*)::BIGINT AS n, count(*) FILTER ({_YES})::BIGINT AS n_accepted"
    return f"SELECT {counts}, {share} FROM ({' UNION ALL '.join(whole)}) GROUP BY ALL UNION ALL SELECT {counts}, NULL FROM ({' UNION ALL '.join(packed)}) GROUP BY ALL"


add("analysis_report", lambda s, d: A.analysis_report(read_metadata(s, d), SINGLE_VALUE_FIELDS, MULTI_VALUE_FIELDS), _report_sql())

# charts (V1-V10)
_chart_sql = {
    "classification": _counts_sql("is_dataset_paper", "non_null"),
    "uses": f"SELECT * FROM ({_tokens_sql('intended_primary_use', _YES)}) ORDER BY n DESC, value LIMIT 10",
    "scales": _scale_sql("LEFT", _YES),
    "scopes": f"SELECT scope_of_use AS value, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE * 100.0::DOUBLE AS pct FROM {_meta('scope_of_use', 'is_dataset_paper', where=_YES)} WHERE scope_of_use IS NOT NULL GROUP BY 1",
}
for _k, (_c, _n) in {"roles": ("role_in_paper", 10), "languages": ("language_coverage", 10), "llm": ("llm_involvement", 0), "tasks": ("task_family", 15), "domains": ("domain", 15), "contributions": ("claimed_contribution", 0)}.items():
    _chart_sql[_k] = f"SELECT {_c} AS value, count(*)::BIGINT AS n FROM {_meta(_c, 'is_dataset_paper', where=_YES)} WHERE {_c} IS NOT NULL GROUP BY 1" + (f" ORDER BY n DESC, value LIMIT {_n}" if _n else "")
for _k, _chart in CHARTS.items():
    add(f"chart_{_k}", lambda s, d, f=_chart: f(read_metadata(s, d)), _chart_sql[_k])

# filters (F1-F21)
add("date_range", lambda s, d: table(s, d, "arxiv_results").where(R.date_window("Publication Date", "2022-01-01", "2023-12-31")).select("row_id"), """SELECT row_id FROM arxiv_results WHERE coalesce("Publication Date", '') = '' OR "Publication Date" BETWEEN '2022-01-01' AND '2023-12-31'""")
add("date_cutoff", lambda s, d: table(s, d, "arxiv_results").where(R.on_or_before("Publication Date", "2022-06-30")).select("row_id"), f"""SELECT row_id FROM arxiv_results WHERE {_date('"Publication Date"')} <= DATE '2022-06-30'""")
add("primary_category_in", lambda s, d: table(s, d, "arxiv_results").where(R.primary_category()).select("row_id"), f"""SELECT row_id FROM arxiv_results WHERE "Primary Category" IN ({", ".join(repr(c) for c in CATEGORIES)})""")
add("min_abstract_length", lambda s, d: table(s, d, "openreview_papers").where(R.min_length("abstract")).select("id", F.length("abstract").alias("n_chars")), "SELECT id, length(abstract)::INTEGER AS n_chars FROM openreview_papers WHERE length(coalesce(abstract, '')) >= 100")
add("venue_substring", lambda s, d: table(s, d, "openreview_papers").where(R.venue_contains("WORKSHOP")).select("id", "venue"), "SELECT id, venue FROM openreview_papers WHERE contains(lower(venue), 'workshop')")
add("split_positive", lambda s, d: R.split_yes(read_metadata(s, d))[0].select("meta_id"), f"SELECT meta_id FROM {META} WHERE {_YES}")
add("split_negative", lambda s, d: R.split_yes(read_metadata(s, d))[1].select("meta_id"), f"SELECT meta_id FROM {META} WHERE NOT {_YES}")
add("split_reunion", lambda s, d: R.reunion(R.split_yes(read_metadata(s, d))[0].select("meta_id", "task_family"), R.split_yes(read_metadata(s, d))[1].select("meta_id")), f"SELECT meta_id, {_na('task_family')} AS task_family FROM {META} WHERE {_YES} UNION ALL BY NAME SELECT meta_id FROM {META} WHERE NOT {_YES}")
add("keyword_or_filter", lambda s, d: table(s, d, "arxiv_results").where(R.dataset_title_or_abstract("Title", "Abstract")).select("row_id"), """SELECT row_id FROM arxiv_results WHERE coalesce(contains(lower("Title"), 'dataset'), FALSE) OR coalesce(contains(lower("Abstract"), 'dataset'), FALSE)""")
add("keyword_regex", lambda s, d: table(s, d, "openreview_papers").where(imatches(F.col("title"), "nlp|language|text|linguistic|dialogue|translation")).select("id", "title"), "SELECT id, title FROM openreview_papers WHERE regexp_matches(title, '(?i)nlp|language|text|linguistic|dialogue|translation')")
add("compound_subset", lambda s, d: table(s, d, "events").where(icontains(F.col("event_type"), "PURCH") & (F.col("value") > 10)).select("event_id"), "SELECT event_id FROM events WHERE contains(lower(event_type), 'purch') AND value > 10")

# projections (P2-P19) and functions
add("id_from_url", lambda s, d: table(s, d, "arxiv_results").select("row_id", last_piece(F.col("arXiv URL"), "/abs/").alias("paper")), """SELECT row_id, coalesce(list_extract(string_split("arXiv URL", '/abs/'), -1), '') AS paper FROM arxiv_results""")
add("clean_newlines", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(clean_newlines(F.col("text"))).alias("digest")), f"SELECT doc_id, md5(coalesce(replace({_strip('text')}, chr(10), ' '), '')) AS digest FROM documents")
add("clean_collapse_ws", lambda s, d: table(s, d, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({_collapse('text')}) AS digest FROM documents")
add("rename_clean_all", lambda s, d: R.rename_clean(table(s, d, "arxiv_results").drop("ingested_at")), "SELECT row_id, batch_no, " + ", ".join(f'{_collapse(chr(34) + c + chr(34))} AS "{RENAMED.get(c, c)}"' for c in RAW_COLUMNS) + " FROM arxiv_results")
add("lower_keywords", lambda s, d: table(s, d, "openreview_papers").select("id", F.array_join(F.transform("keywords", F.lower), ", ").alias("keywords"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ", ").alias("scores")), "SELECT id, array_to_string(list_transform(keywords, lambda x: lower(x)), ', ') AS keywords, array_to_string(list_transform(scores, lambda x: x::VARCHAR), ', ') AS scores FROM openreview_papers")
def _query_type() -> Column:
    return F.when(F.col("decision") == "Withdrawn", "Withdrawn_Submission").when(F.col("decision") == "Desk rejected", "Desk_Rejected_Submission").when(F.col("decision") == "Reject", "Rejected_Submission").otherwise("")


_query_type_sql = "CASE decision WHEN 'Withdrawn' THEN 'Withdrawn_Submission' WHEN 'Desk rejected' THEN 'Desk_Rejected_Submission' WHEN 'Reject' THEN 'Rejected_Submission' ELSE '' END"
add("query_type_case", lambda s, d: table(s, d, "openreview_papers").select("id", decision_of_query(_query_type()).alias("first_decision")), "SELECT id, CASE WHEN decision IN ('Withdrawn', 'Desk rejected', 'Reject') THEN decision ELSE '' END AS first_decision FROM openreview_papers")
add(
    "notes_url",
    lambda s, d: table(s, d, "openreview_papers").select("id", notes_url_column("http://v1", "http://v2", "conf", F.col("year"), _query_type(), F.lit(1000)).alias("url")),
    f"SELECT id, CASE WHEN year >= 2024 THEN 'http://v2?content.venueid=conf.cc/' || year || '/Conference' || CASE WHEN q <> '' THEN '/' || q ELSE '' END || '&offset=1000' WHEN q = '' THEN NULL ELSE 'http://v1?invitation=conf.cc%2F' || year || '%2F' || CASE WHEN year <= 2017 THEN 'conference' ELSE 'Conference' END || '%2F-%2F' || q || '&offset=1000' END AS url FROM (SELECT id, year, {_query_type_sql} AS q FROM openreview_papers)",
)
add(
    "feed_query",
    lambda s, d: table(s, d, "arxiv_results").where("`Primary Category` IS NOT NULL").select(feed_query_column(F.col("Primary Category"), F.lit("2025-10-01"), F.lit("2025-11-01")).alias("search_query")).distinct(),
    """SELECT DISTINCT 'cat%3A' || replace(replace(replace("Primary Category", ' ', '+'), ';', '%3B'), ',', '%2C') || '+AND+submittedDate%3A%5B20251001+TO+20251101%5D' AS search_query FROM arxiv_results WHERE "Primary Category" IS NOT NULL""",
)
add("author_lists", lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "; ").alias("names")), "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")

# joins and ordered folds
_unwrap = "CASE WHEN json_type(note, '$.{k}') = 'OBJECT' AND {c} THEN coalesce(note->>'$.{k}.value', '') ELSE coalesce(note->>'$.{k}', '') END"
_decision_sql = f"""CASE WHEN json_exists(note, '$.decision') THEN {_unwrap.format(k="decision", c="year >= 2024")} WHEN json_exists(note, '$.withdrawal_confirmation') THEN 'Withdrawn' WHEN json_exists(note, '$.desk_reject_comments') THEN 'Desk rejected' WHEN json_exists(note, '$.recommendation') THEN {_unwrap.format(k="recommendation", c="TRUE")} WHEN note->>'$.withdrawal' = 'Confirmed' THEN 'Withdrawn' END"""
add("decision_first_hit", lambda s, d: table(s, d, "forum_notes").select("forum", resolve.decision_of(F.col("notes"), F.col("year")).alias("decision")), _json_list_sql(f"SELECT any_value(forum) AS forum, arg_min(hit, pos) FILTER (hit IS NOT NULL) AS decision FROM (SELECT k, forum, pos, {_decision_sql} AS hit FROM e) GROUP BY k"))
_rating = "CASE WHEN year >= 2024 AND json_type(note, '$.rating') = 'OBJECT' THEN note->'$.rating.value' ELSE note->'$.rating' END"
_score_sql = f"""SELECT k, forum, pos, CASE WHEN json_type(r) = 'VARCHAR' THEN CASE WHEN regexp_matches(string_split(r->>'$', ':')[1], '^\\s*[+-]?\\d+\\s*$') THEN trim(string_split(r->>'$', ':')[1])::INTEGER END WHEN json_type(r) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc((r->>'$')::DOUBLE)::INTEGER END AS score FROM (SELECT *, {_rating} AS r FROM e)"""
add("score_lists", lambda s, d: table(s, d, "forum_notes").select("forum", F.array_join(F.transform(resolve.scores_of(F.col("notes"), F.col("year")), lambda x: x.cast("string")), ",").alias("scores")), _json_list_sql(f"SELECT any_value(forum) AS forum, coalesce(string_agg(score::VARCHAR, ',' ORDER BY pos) FILTER (score IS NOT NULL), '') AS scores FROM ({_score_sql}) GROUP BY k"))
add(
    "papers_with_decisions",
    lambda s, d: resolve.with_decisions(table(s, d, "openreview_papers"), table(s, d, "forum_notes")).select("id", "title", "decision", F.size("scores").alias("n_scores")),
    _json_list_sql(f""", f AS (SELECT forum, arg_min(hit, pos) FILTER (hit IS NOT NULL) AS decision, count(score) AS n FROM (SELECT h.*, sc.score FROM (SELECT k, forum, pos, {_decision_sql} AS hit FROM e) h JOIN ({_score_sql}) sc USING (k, pos)) GROUP BY forum) SELECT p.id, p.title, CASE WHEN coalesce(p.decision, '') = '' AND f.forum IS NOT NULL THEN coalesce(f.decision, '') ELSE coalesce(p.decision, '') END AS decision, (CASE WHEN f.forum IS NOT NULL THEN f.n ELSE coalesce(len(p.scores), 0) END)::INTEGER AS n_scores FROM openreview_papers p LEFT JOIN f ON f.forum = p.id"""),
)
add(
    "left_lookup_agg",
    lambda s, d: table(s, d, "customer").join(table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders")),
    "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)

# sorts, slices, set operations
add("sort_project", lambda s, d: table(s, d, "openreview_papers").orderBy("year", "id").select("year", "id", "title"), "SELECT year, id, title FROM openreview_papers ORDER BY year, id")
add("slice_offset_limit", lambda s, d: R.slice_rows(table(s, d, "documents"), [F.col("doc_id")], 100, 50).select("doc_id", "lang"), "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
add("first_ten", lambda s, d: table(s, d, "openreview_papers").orderBy("year", "id", "title").select("year", "id", F.substring("title", 1, 50).alias("title")).limit(10), "SELECT year, id, substr(title, 1, 50) AS title FROM (SELECT * FROM openreview_papers ORDER BY year, id, title LIMIT 10)")
add("union_bag", lambda s, d: table(s, d, "arxiv_results").where("batch_no <= 20").select("row_id").unionByName(table(s, d, "arxiv_results").where("batch_no >= 15").select("row_id")), "SELECT row_id FROM arxiv_results WHERE batch_no <= 20 UNION ALL SELECT row_id FROM arxiv_results WHERE batch_no >= 15")
add("merge_batches", lambda s, d: R.merge_batches([table(s, d, "arxiv_results").where("batch_no <= 20").select("row_id", "DOI"), table(s, d, "arxiv_results").where("batch_no >= 15").select("row_id", "DOI", "Title")], ["row_id"]).select("row_id"), "SELECT DISTINCT row_id FROM arxiv_results")
add("dedup_keep_latest", lambda s, d: R.keep_latest(table(s, d, "arxiv_results"), ["arXiv ID"], F.desc("Updated Date"), F.desc("row_id")).select("row_id", "arXiv ID"), """SELECT row_id, "arXiv ID" FROM (SELECT *, row_number() OVER (PARTITION BY "arXiv ID" ORDER BY "Updated Date" DESC NULLS LAST, row_id DESC) AS r FROM arxiv_results) WHERE r = 1""")

# sinks and round trips
add("counts_to_json", lambda s, d: A.counts_json(A.value_counts(read_metadata(s, d), "output_type")), f"""SELECT '{{' || string_agg('"' || value || '":' || n, ',' ORDER BY n DESC, value) || '}}' AS json FROM ({_counts_sql('output_type', 'all')})""")
add("report_sections", lambda s, d: A.report_sections(read_metadata(s, d), ["output_type", "scope_of_use"], ["relationship_to_prior"]), f"SELECT 'output_type' AS section, value, n FROM ({_counts_sql('output_type', 'all')}) UNION ALL SELECT 'scope_of_use', value, n FROM ({_counts_sql('scope_of_use', 'all')}) UNION ALL SELECT 'relationship_to_prior', value, n FROM ({_tokens_sql('relationship_to_prior')})")
add("report_json", lambda s, d: report_json(A.report_sections(read_metadata(s, d), ["output_type"], [])), f"""SELECT 'output_type' AS section, '{{' || string_agg('"' || value || '":' || n, ',' ORDER BY n DESC, value) || '}}' AS json FROM ({_counts_sql('output_type', 'all')})""")


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    papers = table(spark, sf_dir, "openreview_papers").select(*CONFERENCE_COLUMNS)
    write_quoted_csv(papers, path)
    flat = for_quoted_csv(papers).schema
    back = read_csv(spark, path, flat, na=False)
    single = F.replace(F.coalesce("title", F.lit("")), F.lit("\\\\"), F.lit("\\"))  # the writer doubles backslashes
    return back.select("year", "id", single.alias("title"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.coalesce("scores", F.lit("")).alias("scores"))


def _parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    table(spark, sf_dir, "openreview_papers").select(*CONFERENCE_COLUMNS).write.parquet(path)
    return spark.read.schema(CONFERENCE_PAPER).parquet(path).select("id", "year", F.size("scores").alias("n_scores"), F.array_join("keywords", "|").alias("keywords"))


add("csv_roundtrip", _csv_roundtrip, f"SELECT year, id, {_collapse('title')} AS title, coalesce(array_to_string(keywords, ', '), '') AS keywords, coalesce(array_to_string(list_transform(scores, lambda x: x::VARCHAR), ', '), '') AS scores FROM openreview_papers")
add("parquet_roundtrip", _parquet_roundtrip, "SELECT id, year, len(scores)::INTEGER AS n_scores, array_to_string(keywords, '|') AS keywords FROM openreview_papers")

# enrichment
_text_sql = """lower(coalesce("Title", '') || ' ' || coalesce("Abstract", ''))"""
_relevant_sql = " OR ".join(f"contains({_text_sql}, '{w}')" for w in X.RELEVANT_WORDS)


def _rule_sql(field: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join('TRUE' if w == '' else f'contains({_text_sql}, {w!r})' for w in words)} THEN '{answer}'" for answer, words in X.RULES[field]) + " END"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "arxiv_results").select("row_id", "Title", "Abstract")


add("rule_relevance", lambda s, d: X.answers(_raw(s, d), X.RuleProvider(), "relevance").select("row_id", "is_dataset_paper"), f"SELECT row_id, CASE WHEN {_relevant_sql} THEN 'Yes' ELSE 'No' END AS is_dataset_paper FROM arxiv_results")
add("rule_metadata", lambda s, d: X.answers(_raw(s, d), X.RuleProvider(), "metadata").select("row_id", *METADATA_FIELDS), "SELECT row_id, " + ", ".join(f"{_rule_sql(f)} AS {f}" for f in METADATA_FIELDS) + " FROM arxiv_results")
add("rule_metadata_native", lambda s, d: _raw(s, d).withColumn("_text", F.concat_ws(" ", F.coalesce("Title", F.lit("")), F.coalesce("Abstract", F.lit("")))).select("row_id", *(X.rule_column(f, F.col("_text")).alias(f) for f in METADATA_FIELDS)), "SELECT row_id, " + ", ".join(f"{_rule_sql(f)} AS {f}" for f in METADATA_FIELDS) + " FROM arxiv_results")
add(
    "two_stage_enrich",
    lambda s, d: X.enrich(_raw(s, d), X.RuleProvider()).select("row_id", "title", "is_dataset_paper", "task_family", "approximate_scale"),
    f"""SELECT row_id, {_collapse('"Title"')} AS title, CASE WHEN {_relevant_sql} THEN 'Yes' ELSE 'No' END AS is_dataset_paper, CASE WHEN {_relevant_sql} THEN {_rule_sql('task_family')} ELSE '' END AS task_family, CASE WHEN {_relevant_sql} THEN {_rule_sql('approximate_scale')} ELSE '' END AS approximate_scale FROM arxiv_results""",
)

# streams (T2, T4, T5, T7)
add("stream_daily_counts", lambda s, d: jobs.run_available(jobs.daily_counts(jobs.stream_table(s, d, "events"), "ts", "event_type"), "complete"), "SELECT ts::DATE AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
add("stream_filter", lambda s, d: jobs.run_available(jobs.stream_table(s, d, "events").where("event_type = 'error' AND value > 5").select("event_id", "user_id")), "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 5")
add("stream_dedup", lambda s, d: jobs.run_available(jobs.first_of_key(jobs.stream_table(s, d, "events"), "ts", ["event_id"]).select("event_id", "event_type")), "SELECT event_id, event_type FROM events")
