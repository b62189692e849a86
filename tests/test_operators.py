"""Analysis, refinement, resolution and enrichment on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import analyze as A
from folioscope.operators import enrich as X
from folioscope.operators import refine as R
from folioscope.operators import resolve
from folioscope.operators.charts import CHARTS

META = "title string, is_dataset_paper string, role_in_paper string, approximate_scale string, intended_primary_use string, llm_involvement string, publication_date string"
ROWS = [
    ("a", "Yes", "New dataset", ">1M", "Evaluation, Probing", "No LLM", "2024-01-05"),
    ("b", "yes", "New dataset", "<10K", "Evaluation,,Evaluation", "Generated", "2024-02-30"),
    ("c", "No", None, None, None, None, "2023-07-01"),
    ("d", None, "Composite", "huge", "", None, None),
]


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame(ROWS, META)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_percentages_are_over_all_rows(meta):
    assert rows(A.value_counts(meta, "role_in_paper")) == [("Composite", 1, 25.0), ("New dataset", 2, 50.0)]
    assert rows(A.value_counts(meta, "role_in_paper", over="non_null"))[1][2] == pytest.approx(200 / 3)
    assert A.value_counts(meta, "expected_adoption_scope").count() == 0


def test_counts_add_up(meta):
    for c in ("role_in_paper", "llm_involvement"):
        assert sum(r.n for r in A.value_counts(meta, c).collect()) + meta.where(F.col(c).isNull()).count() == meta.count()
    tokens = meta.where("intended_primary_use IS NOT NULL").select(F.sum(F.size(F.split("intended_primary_use", ",")))).first()[0]
    assert sum(r.n for r in A.token_counts(meta, "intended_primary_use").collect()) == tokens
    assert rows(A.token_counts(meta, "intended_primary_use", drop_empty=True)) == [("Evaluation", 3), ("Probing", 1)]


def test_ordered_categories(meta):
    assert sorted((r.ord, r.value, r.n) for r in A.ordered_categories(meta, "approximate_scale").collect()) == [(0, "<10K", 1), (1, "10K-100K", 0), (2, "100K-1M", 0), (3, ">1M", 1)]
    assert A.ordered_categories(meta, "approximate_scale", zero_fill=False).count() == 2
    assert A.ordered_categories(meta.drop("approximate_scale"), "approximate_scale").where("n = 0").count() == 4


def test_time_and_shares(meta):
    assert rows(A.yearly_counts(meta, "publication_date")) == [(2023, 1), (2024, 1)]  # 30 February isn't a date
    assert rows(A.share_by_year(meta, "publication_date", A.llm_involved(F.col("llm_involvement")))) == [(2023, 1, None), (2024, 1, 100.0)]
    assert rows(A.share_by_year(meta, "publication_date", A.llm_involved(F.col("llm_involvement"), strict=True), zero_fill=True)) == [(2023, 1, 0.0), (2024, 1, 0.0)]


def test_one_pass_aggregates(meta, spark):
    assert rows(A.classification(meta)) == [(2, 2, 4)]
    assert dict((r.subset, r.n) for r in A.subset_sizes(meta).collect()) == {"new_large": 1, "llm_generated": 1}
    assert rows(A.subset_titles(meta, "new_large")) == [("a",)] and A.subset_titles(meta, "new_large", at_most=0).count() == 0
    assert {r["column"]: r.missing for r in A.completeness(meta).collect()}["role_in_paper"] == 1
    assert rows(A.success_rate(meta)) == [(1, 4, 25.0)]
    assert rows(A.success_rate(meta.limit(0))) == [(0, 0, None)]
    assert rows(A.macro_mean(spark.createDataFrame([([1, 2],), ([4],), ([],)], "scores array<int>"))) == [(2, 2.75)]


def test_charts_run_on_frames_without_their_columns(spark, meta):
    for name, chart in CHARTS.items():
        chart(meta).collect()
        chart(spark.createDataFrame([("x",)], "title string")).collect(), name


def test_splits_partition_the_input(meta):
    yes, no = R.split_yes(meta)
    assert yes.count() + no.count() == meta.count() == 4 and yes.count() == 2
    again = R.reunion(yes, no.drop("role_in_paper"))
    assert again.count() == 4 and again.where("role_in_paper IS NULL").count() == 2


def test_dates_and_lengths(spark):
    df = spark.createDataFrame([("2024-01-31", "x" * 99), ("2024-02-01", "😀" * 100), ("", None), ("soon", "y" * 101)], "d string, abstract string")
    assert [r.d for r in df.where(R.on_or_before("d", "2024-01-31")).collect()] == ["2024-01-31"]
    assert df.where(R.date_window("d", "2024-02-01", "2024-02-01")).count() == 2
    assert df.where(R.min_length("abstract")).count() == 2
    with pytest.raises(Exception):
        df.where(R.on_or_before("d", "no date")).collect()


def test_slices_and_latest(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 3)
    assert [r.id for r in R.slice_rows(df, [F.col("id")], 4, 2).collect()] == [4, 5]
    assert R.slice_rows(df, [F.col("id")], 4, 0).count() == 6
    assert sorted(r.id for r in R.keep_latest(df, ["k"], F.desc("id")).collect()) == [7, 8, 9]


NOTES = [
    ('[{"rating":"8: top"},{"rating":"bad"},{"rating":7.9},{"decision":"Accept"}]', 2022, "Accept", [8, 7]),
    ('[{"decision":{"value":"Reject"}},{"withdrawal_confirmation":"x"}]', 2024, "Reject", []),
    ('[{"withdrawal":"Pending"},{"withdrawal":"Confirmed"}]', 2017, "Withdrawn", []),
    ('[{"recommendation":{"value":"Accept"}}]', 2020, "Accept", []),
    ('[{"desk_reject_comments":"..."},{"decision":"Accept"}]', 2021, "Desk rejected", []),
    ('[{"rating":{"value":6}},{"rating":{"value":"5: ok"}}]', 2024, None, [6, 5]),
    ('[{"rating":{"value":6}}]', 2022, None, []),
    ('[{"content":{"decision":"Accept"}}]', 2022, "Accept", []),
    ("[]", 2022, None, []),
    ("not json", 2022, None, None),
    (None, 2022, None, None),
]


def test_first_decision_and_scores(spark):
    df = spark.createDataFrame([(i, n, y) for i, (n, y, _, _) in enumerate(NOTES)], "i int, notes string, year int")
    got = df.select("i", resolve.decision_of(F.col("notes"), F.col("year")).alias("d"), resolve.scores_of(F.col("notes"), F.col("year")).alias("s")).orderBy("i").collect()
    assert [(r.d, r.s) for r in got] == [(d, s) for _, _, d, s in NOTES]


def test_papers_with_decisions(spark):
    papers = spark.createDataFrame([("p1", 2022, "", []), ("p2", 2022, "Reject", [3]), ("p3", 2022, "", [1])], "id string, year int, decision string, scores array<int>")
    notes = spark.createDataFrame([("p1", '[{"decision":"Accept"},{"rating":4}]'), ("p2", '[{"decision":"Accept"},{"rating":9}]')], "forum string, notes string")
    got = {r.id: (r.decision, r.scores) for r in resolve.with_decisions(papers, notes).collect()}
    assert got == {"p1": ("Accept", [4]), "p2": ("Reject", [9]), "p3": ("", [1])}
    alone = {r.id: r.scores for r in resolve.with_decisions(papers, notes, decisions=False).collect()}
    assert alone["p2"] == [3]  # decided papers are left out when only scores are wanted
    assert {r.id: r.scores for r in resolve.with_decisions(papers, notes, decisions=False, force=True).collect()}["p2"] == [9]


def test_two_stages_and_failures(spark):
    papers = spark.createDataFrame([("A Corpus\nof News", "text"), ("On Theory", None), (None, None)], "Title string, Abstract string")
    out = X.enrich(papers, X.RuleProvider())
    got = {r.title: (r.is_dataset_paper, r.task_family) for r in out.collect()}
    assert got == {"A Corpus of News": ("Yes", "Text classification"), "On Theory": ("No", ""), "": ("No", "")}

    class Broken:
        def relevance(self, papers):
            raise RuntimeError

    assert X.answers(papers, Broken(), "relevance").where("is_dataset_paper IS NULL").count() == 3
    assert X.with_retry(lambda p: [1 / 0], [1, 2]) == [None, None]


def test_rules_agree_with_their_native_form(spark):
    papers = spark.createDataFrame([("A large-scale toxicity benchmark", "clinical"), ("x", "question answering")], "Title string, Abstract string")
    text = F.concat_ws(" ", "Title", "Abstract")
    native = papers.select(*(X.rule_column(f, text).alias(f) for f in X.RULES)).collect()

    class InBatches(X.RuleProvider):
        """Only the provider itself answers natively; what derives from it is asked in batches, like any model."""

    for provider in (X.RuleProvider(), InBatches()):
        assert X.answers(papers, provider, "metadata").select(*X.RULES).collect() == native
    one, two = (X.answers(papers, p, "relevance").collect() for p in (X.RuleProvider(), InBatches()))
    assert one == two


def test_row_to_rows_and_parsed_answers(spark):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("t", StringType())])
    df = spark.createDataFrame([("a b",), ("",)], "x string")
    assert rows(X.expanded(df, lambda r: [{"t": w} for w in r["x"].split()], schema)) == [("a",), ("b",)]
    answers = spark.createDataFrame([(X.dumps({"t": "ü"}),), ("no json",)], "answer string")
    assert [r.t for r in X.parsed_answers(answers, "answer", schema).collect()] == ["ü", None]


def test_counts_json_is_ordered(meta):
    got = A.counts_json(A.value_counts(meta, "role_in_paper")).first().json
    assert list(json.loads(got)) == ["New dataset", "Composite"]
