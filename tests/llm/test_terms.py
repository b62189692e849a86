"""Term counts against plain counting."""

from __future__ import annotations

from collections import Counter

from folioscope.llm import terms


def test_counts_and_splitting(spark, rng):
    words = ["Data", " data", "DATA  set", "x" * 5000, "", " ", None, "hot", *(f"t{i}" for i in range(300))]
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 6))] + ["hot"] * (i % 3 == 0) for i in range(900)] + [None, []]
    df = spark.createDataFrame([("k", x, 1) for x in lists], "field_name string, items array<string>, term int").select("field_name", "items", "term")
    want_n, want_r = Counter(), Counter()
    for x in lists:
        clean = [" ".join(w.lower().split()) for w in x or [] if w is not None and w.split()]
        want_n.update(clean)
        want_r.update(set(clean))
    for limit in (terms.PARTITION_ROWS, 3):  # the second splits partitions again and again
        got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, limit).collect()}
        assert got == {t: (want_n[t], want_r[t]) for t in want_n}


def test_marks_and_empty_tables(spark):
    df = spark.createDataFrame([("k", ["a"])] * 5 + [("k", ["b", "b"])] * 2 + [("k", ["c"])] * 3 + [("k", [])] * 10, "field_name string, items array<string>")
    totals = spark.createDataFrame([("k", 20)], "field_name string, rows long")
    got = {r.term: r.mark for r in terms.marked_terms(terms.term_counts(df), totals).collect()}
    assert got == {"a": "common", "b": "rare", "c": None}
    assert terms.term_counts(df.limit(0)).count() == 0
