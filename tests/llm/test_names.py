"""Variant spellings of persons and bodies."""

from __future__ import annotations

import pandas as pd
import pytest

from folioscope.llm import names as N

GIVEN = ["Vera", "Omar", "Umar", "Quentin", "Fernanda", "Kofi", "Dagny", "Xin-Yi", "Robert"]
SURNAMES = ["Bovakohi", "Tibipasa", "Rakamojo", "Homekome", "Sisigava", "Karehire"]
CROWD = [f"{g} {s}" for g in GIVEN for s in SURNAMES]


def groups(df):
    out: dict[str, set] = {}
    for r in df.collect():
        out.setdefault(r.entity, set()).add(r.name)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def entity_of(spark, fn, spellings, name):
    df = spark.createDataFrame([(s, 1) for s in spellings] * 2, "name string, entity int")
    return next((g for g in groups(fn(N.distinct_names(df))) if name in g), {name})


def test_persons(spark):
    variants = ["Zofia G. van Lipanove", "zofia g. van lipanove", "Lipanove, Zofia", "van Lipanove Zofia", "Z. Lipanove", "Zofia Lipañove", "Zofia Lipanoev", "ZOFIA LIPANOVE"]
    others = ["Quentin Lipanove", "Zachary Homekome"]
    assert entity_of(spark, N.person_entities, CROWD + variants + others, variants[0]) == set(variants)


def test_nicknames_umlauts_and_initials(spark):
    spellings = CROWD + ["Bob Karehire", "R. Karehire", "Xinyi Karehire", "X.-Y. Karehire", "Olga Rölevazi", "Olga Roelevazi"]
    assert entity_of(spark, N.person_entities, spellings, "Bob Karehire") == {"Bob Karehire", "Robert Karehire", "R. Karehire"}
    assert entity_of(spark, N.person_entities, spellings, "Xin-Yi Karehire") == {"Xin-Yi Karehire", "Xinyi Karehire", "X.-Y. Karehire"}
    assert entity_of(spark, N.person_entities, spellings, "Olga Rölevazi") == {"Olga Rölevazi", "Olga Roelevazi"}


def test_frequent_names_are_not_misspellings(spark):
    assert entity_of(spark, N.person_entities, CROWD, "Omar Bovakohi") == {"Omar Bovakohi"}


def test_refined_blocks_lose_nothing(spark, monkeypatch):
    spellings = CROWD + ["Vera Bovakoih", "Bovakohi, Vera", "Quentin Tibipsaa"]
    df = N.distinct_names(spark.createDataFrame([(s,) for s in spellings], "name string"))
    want = groups(N.person_entities(df))
    keyed = N.read_persons(df).mapInPandas(N._person_keys, N._KEYED)
    wide, _ = N.blocked_pairs(keyed)
    narrow, star = N.blocked_pairs(keyed, common=12)
    near = {frozenset(x) for x in (("Vera Bovakohi", "Vera Bovakoih"), ("Vera Bovakohi", "Bovakohi, Vera"), ("Quentin Tibipasa", "Quentin Tibipsaa"))}
    for pairs in (wide, narrow.unionByName(star.selectExpr("a AS name_a", "b AS name_b"))):
        assert near <= {frozenset((r.name_a, r.name_b)) for r in pairs.collect()}
    assert want == {frozenset(x) for x in (("Vera Bovakohi", "Vera Bovakoih", "Bovakohi, Vera"), ("Quentin Tibipasa", "Quentin Tibipsaa"))}


def test_blocks_common_to_the_end_are_compared(spark, rng):
    stems = ["".join(rng.choice("bdfgklmprtvz" if i % 2 else "aeiouy") for i in range(9)) for _ in range(N.COMMON + 20)]
    persons = [f"Anna {x}sson" for x in stems] + [f"ANNA {stems[0]}sson", f"Anna B. {stems[1]}sson", f"Anna C. {stems[2]}sson", f"Anna D. {stems[2]}sson"]
    df = N.distinct_names(spark.createDataFrame([(s,) for s in persons], "name string"))
    got = {frozenset(x) for x in groups(N.person_entities(df))}
    assert {frozenset((persons[0], f"ANNA {stems[0]}sson")), frozenset((persons[1], f"Anna B. {stems[1]}sson"))} <= got
    assert all(len({x.lower().split()[-1] for x in g}) == 1 for g in got)
    bodies = [f"University of Bor{x}stad" for x in stems] + [f"Univ. of Bor{stems[0]}stad"]
    df = N.distinct_names(spark.createDataFrame([(s,) for s in bodies], "name string"))
    assert groups(N.body_entities(df)) == {frozenset((bodies[0], bodies[-1]))}


def compared(*persons):
    """Kinds of the pair of two (surname, given, n_surname, n_given)."""
    row = {}
    for side, (surname, given, n_surname, n_given) in zip("ab", persons, strict=True):
        row |= {f"name_{side}": side, f"surname_{side}": surname, f"given_{side}": given, f"middle_{side}": "", f"initials_{side}": "", f"formal_{side}": given, f"n_surname_{side}": n_surname, f"n_given_{side}": n_given}
    return [k for b in N._compare_persons(iter([pd.DataFrame([row])])) for k in b["kind"]]


@pytest.mark.parametrize("n,m,kinds", [(2, 3, ["same"]), (5, 500, ["same"]), (40, 4000, ["same"]), (40, 60, []), (400, 600, [])])
def test_misspellings_grow_with_their_name(n, m, kinds):
    assert compared(("bovakohi", "willam", 9, n), ("bovakohi", "william", 9, m)) == kinds
    assert compared(("bovakohi", "vera", n, 9), ("bovakoih", "vera", m, 9)) == kinds


def test_true_pairs_meet_under_common_keys(spark, rng):
    crowd = [(f"{''.join(rng.choice('bcdefghijklm') for _ in range(7))}", "smith", "") for _ in range(N.COMMON + 20)]
    true = [("john", "smith", ""), ("johm", "smith", ""), ("jhon", "smiht", ""), ("", "smith", "j"), ("", "smiht", "jq"), ("robert", "roelevazi", ""), ("bob", "rolevazi", ""), ("maximilianaleksander", "smith", ""), ("maximilianaleksandr", "smith", "")]
    rows = [(f"{g or i} {s}", s, g, "", i, {"bob": "robert"}.get(g, g), 1, 1) for g, s, i in crowd + true]
    forms = spark.createDataFrame(rows, "name string, surname string, given string, middle string, initials string, formal string, n_given long, n_surname long")
    got = {(r.name_a, r.name_b) for r in N.person_pairs(forms).collect()}
    want = [("john smith", "johm smith"), ("john smith", "jhon smiht"), ("john smith", "j smith"), ("john smith", "jq smiht"), ("j smith", "jq smiht"), ("robert roelevazi", "bob rolevazi"), ("maximilianaleksander smith", "maximilianaleksandr smith")]
    assert {tuple(sorted(p)) for p in want} <= got
    keyed = forms.mapInPandas(N._person_keys, N._KEYED)
    assert {"john smith", "johm smith", "j smith"} <= {r.name for r in N.names_under_common_keys(keyed).collect()}


BODIES = [
    ["University of Quenren", "U. of Quenren", "Universität Quenren", "Quenren, University of", "The University of Quenren", "UNIVERSITY OF QUENREN.", "Dept. of Linguistics, University of Quenren", "University of Quenren, Westmark", "Univesity of Qunren"],
    ["Quenren Institute of Technology", "Quenren Inst. Technol.", "Quenren Institute of Technology (QIT)", "Institute of Technology, Quenren"],
    ["Quenren Research Labs", "Quenren Labs", "Quenren Research Laboratories Inc."],
    ["National Center for Data Ethics, Quenren", "Natl. Centre for Data Ethics (Quenren)", "Quenren National Center for Data Ethics"],
    ["National Center for Speech Research, Quenren", "Nat'l Ctr. for Speech Research, Quenren"],
    ["Quenren General Hospital", "Hospital Quenren (General)"],
    ["University of Florgut", "U. of Florgut"],
]


def test_bodies(spark):
    df = spark.createDataFrame([(s,) for g in BODIES for s in g], "name string")
    assert groups(N.body_entities(N.distinct_names(df))) == {frozenset(g) for g in BODIES}


def test_edge_cells(spark):
    df = N.distinct_names(spark.createDataFrame([(None,), ("",), (" ",), ("--",), ("x" * 3000,), ("X",), ("李",), ("Lee",), ("Lee",)], "name string"))
    for fn in (N.person_entities, N.body_entities):
        assert groups(fn(df)) == set()
        assert fn(df.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,ratio", [("abcd", "abcd", 1.0), ("abcd", "abd", 6 / 7), ("", "a", 0.0), ("abcd", "dcba", 0.25)])
def test_lcs_ratio(a, b, ratio):
    assert N.lcs_ratio(a, b) == pytest.approx(ratio)


@pytest.mark.parametrize("n", [150, 250])
def test_many_names_with_one_ending_stay_apart(spark, rng, n):
    """However many people share given name and end of the surname, nobody is linked unseen."""
    people = [f"John {''.join(rng.choice('bcdfghjklmnpqrstvwxyz') for _ in range(8)).title()}mann" for _ in range(n)]
    twins = [people[0].replace("mann", "man"), people[1].replace("John", "Jonh")]
    df = spark.createDataFrame([(x,) for x in {*people, *twins}], "name string")
    got = {(r.name_a, r.name_b) for r in N.entity_pairs(N.person_entities(N.distinct_names(df))).collect()}
    assert got == {tuple(sorted(p)) for p in zip(people, twins)}
