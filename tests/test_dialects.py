"""Packed cells: candidates of single cells, and the choice over whole columns."""

from __future__ import annotations

import pytest

from folioscope.operators.dialects import RULES, packed_cells, parses, split_packed

CASES = [
    ("authors", "Ann Lee; Bo Chu", ["Ann Lee", "Bo Chu"]),
    ("authors", "Ann Lee, Bo Chu, and Cy Dee", ["Ann Lee", "Bo Chu", "Cy Dee"]),
    ("authors", "Ann Lee & Bo Chu", ["Ann Lee", "Bo Chu"]),
    ("authors", "Lee, Ann; Bo Chu", ["Lee, Ann", "Bo Chu"]),
    ("authors", '"Lee, Ann"', ["Lee, Ann"]),
    ("authors", '"Ann Lee","Bo Chu"', ["Ann Lee", "Bo Chu"]),
    ("authors", "['Ann Lee', \"Al O'Neil\"]", ["Ann Lee", "Al O'Neil"]),
    ("authors", ";Ann Lee; ; Bo Chu;", ["Ann Lee", "Bo Chu"]),
    ("authors", "Ann Lee；Bo Chu ", ["Ann Lee", "Bo Chu"]),
    ("categories", "cs.CL;cs.LG, cs.AI  cs.CV", ["cs.CL", "cs.LG", "cs.AI", "cs.CV"]),
    ("categories", "cs.CL", ["cs.CL"]),
    ("targeted_capability", "reasoning (logical, causal), safety", ["reasoning (logical, causal)", "safety"]),
    ("targeted_capability", "ethics, norms; safety", ["ethics, norms", "safety"]),
    ("targeted_capability", "read/write recall,, planning and acting", ["read/write recall", "planning and acting"]),
    ("targeted_capability", "• safety\n• ethics, norms", ["safety", "ethics, norms"]),
    ("intended_primary_use", "(1) Evaluation (2) RLHF", ["Evaluation", "RLHF"]),
    ("intended_primary_use", "Fine-tuning; Probing / RLHF", ["Fine-tuning", "Probing", "RLHF"]),
    ("intended_primary_use", "Evaluation + Fine-tuning and Probing", ["Evaluation", "Fine-tuning", "Probing"]),
]


@pytest.fixture(scope="module")
def split(spark):
    """The cases among many plain cells that tell which values there are."""
    names = ["Ann Lee", "Bo Chu", "Cy Dee", "Di Eck", "Al O'Neil"]
    filler = [("authors", f"{a}; {b}") for a in names for b in names if a != b]
    filler += [("categories", f"{a}; {b}") for a in ("cs.CL", "cs.LG", "cs.AI", "cs.CV") for b in ("cs.CL", "cs.LG", "cs.AI", "cs.CV")]
    filler += [("targeted_capability", f"{a}; {b}") for a in ("safety", "planning and acting", "read/write recall", "ethics, norms") for b in ("safety", "reasoning (logical, causal)")]
    filler += [("intended_primary_use", f"{a}; {b}") for a in ("Evaluation", "RLHF", "Probing", "Fine-tuning") for b in ("Evaluation", "RLHF", "Probing", "Fine-tuning")]
    cells = spark.createDataFrame([(f, i, c) for i, (f, c) in enumerate([*[(f, c) for f, c, _ in CASES], *filler])], "field_name string, rec_id long, cell string")
    out: dict[int, list] = {}
    for r in split_packed(cells).collect():
        out.setdefault(r.rec_id, []).append((r.pos, r.item, r.n_items))
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_values_in_order(split, k):
    want = CASES[k][2]
    assert sorted(split[k]) == [(i, v, len(want)) for i, v in enumerate(want, 1)]


def test_edge_cells(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "NA", "x"), (5, ";;", "x"), (6, "; ".join(["Ann Lee"] * 3000), "x"), (7, "Ann Lee", None), (7, "Ann Lee", None)]
    df = spark.createDataFrame(rows, "id long, cell string, item string")  # a clashing column name
    got = split_packed(packed_cells(df, "authors", "id", "cell")).groupBy("rec_id").count().collect()
    assert {r.rec_id: r["count"] for r in got} == {6: 3000, 7: 2}


def test_empty_table(spark):
    assert split_packed(packed_cells(spark.createDataFrame([], "id long, cell string"), "authors", "id", "cell")).count() == 0


def test_unbalanced_quotes_and_brackets_lose_nothing():
    for cell in ('"Ann Lee; Bo Chu', "Ann (Lee; Bo Chu", "['Ann Lee', Bo", '""', "( ; )"):
        assert all(v.strip() == v and v for _, values in parses(cell, RULES["authors"]) for v in values)
