"""Mapping typed values: the join against all pairs, and single values."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import canonical as C

LIST = [(1, "task", "Text classification", ["TC", "document categorization"]), (2, "task", "Token classification", []), (3, "task", "Dialogue", None), (4, "domain", "Farming", []), (5, "domain", "News", []), (6, "lang", "English only", ["en"]), (7, "lang", "German only", ["de"]), (8, "lang", "Multilingual", ["many languages"])]
VALUES = [
    ("task", "text clasisfication", 1),
    ("task", "ＴＥＸＴ  classification.", 1),
    ("task", "classification, text", 1),
    ("task", "Text classification (TC)", 1),
    ("task", "tc", 1),
    ("task", "Text classif.", 1),
    ("task", "tоken_classification", 2),  # a Cyrillic letter
    ("task", "Text simplification", 0),
    ("task", "x", 0),
    ("task", "Farming", 0),  # an entry of another field
    ("domain", "Gaming", 0),
    ("domain", "the nwes domain", 5),
    # remarks are learnt from values that are an entry but for them
    *[("domain", x, c) for x, c in (("the news", 5), ("the farming", 4), ("news domain", 5), ("Farming domain", 4))],
    *[("lang", x, c) for x, c in (("monolingual English", 6), ("monolingual german", 7), ("just German", 7))],
    ("lang", "monolingual Germn", 7),
    ("lang", "just english", 6),
    ("lang", "only Latin german", 0),  # words that stand beside one entry are no remark
    ("lang", "Latin only", 0),
    ("lang", "en", 6),
    ("task", "y" * 3000, 0),
]


@pytest.fixture(scope="module")
def canon(spark):
    return spark.createDataFrame(LIST, "canon_id int, field_name string, canon_value string, aliases array<string>")


def test_values(spark, canon):
    cells = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(VALUES)], "rec_id long, field_name string, value string")
    assert [r.canon_id for r in C.map_values(cells, canon).orderBy("rec_id").collect()] == [c for _, _, c in VALUES]


def test_missing_exact_and_repeated(spark, canon):
    rows = [(1, "task", None), (2, "task", " "), (3, "task", "N/A"), (4, "task", "Dialogue"), (5, "task", "dialogue"), (5, "task", "dialogue")]
    cells = spark.createDataFrame(rows, "rec_id long, field_name string, value string")
    assert sorted((r.rec_id, r.canon_id) for r in C.map_values(cells, canon, exact=False).collect()) == [(5, 3), (5, 3)]
    assert C.map_values(cells, canon).count() == 3
    assert C.map_values(cells.limit(0), canon).count() == 0
    assert {r.canon_id for r in C.map_values(cells, canon.limit(0)).collect()} == {0}


def test_join_is_all_pairs(spark, rng):
    keys = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    left, right = sorted(set(keys[:70])), sorted(set(keys[50:]))
    frames = [spark.createDataFrame([("f", k, C.key_tokens(k)) for k in x], "field_name string, key string, tokens array<string>") for x in (left, right)]
    got = {(r.l, r.r): r.jaccard for r in C.set_similarity_join(*frames, 0.4).collect()}
    want = {}
    for x in left:
        for y in right:
            a, b = set(C.key_tokens(x)), set(C.key_tokens(y))
            if len(a & b) / len(a | b) >= 0.4:
                want[x, y] = len(a & b) / len(a | b)
    assert got == pytest.approx(want)


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefgh", min_size=4, max_size=18), st.data())
def test_similarity_bound_loses_nothing_within_the_edits(word, data):
    """Words within their edit limit are never below the similarity bound."""
    other = word
    for _ in range(C.edit_limit(len(word))):
        at = data.draw(st.integers(0, len(other) - 1))
        kind = data.draw(st.sampled_from(["drop", "add", "change", "swap"]))
        letter = data.draw(st.sampled_from("abcdefgh"))
        other = {"drop": other[:at] + other[at + 1 :], "add": other[:at] + letter + other[at:], "change": other[:at] + letter + other[at + 1 :], "swap": other[:at] + other[at : at + 2][::-1] + other[at + 2 :]}[kind] or other
    a, b = set(C.key_tokens(word)), set(C.key_tokens(other))
    assert len(a & b) / len(a | b) >= C.JACCARD


def test_edits():
    assert [C.edits("abcd", x, 2) for x in ("abcd", "abdc", "abc", "axcd", "dcba")] == [0, 1, 1, 1, 3]
