"""Shared passages against brute force over every substring."""

from __future__ import annotations

from collections import defaultdict

import pytest

from folioscope.llm.spans import SharedSpans, kept_lines, line_units

SPAN, GRAM = 20, 10


def brute(docs: dict[int, str], span: int):
    where = defaultdict(set)
    for i, t in docs.items():
        for k in range(len(t) - span + 1):
            where[t[k : k + span]].add(i)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    shared = {}
    for i, t in docs.items():
        covered = {k + j for k in range(len(t) - span + 1) if len(where[t[k : k + span]]) > 1 for j in range(span)}
        shared[i] = len(covered)
    return pairs, shared


def make(rng):
    def text(n, letters="abcdefgh ij"):
        return "".join(rng.choice(letters) for _ in range(n))

    docs = {i: text(rng.randint(0, 150)) for i in range(60)}
    for i in range(0, 40, 2):  # passages around the bound, at any place
        n = rng.choice([SPAN - 1, SPAN, SPAN + 1, 60])
        passage = text(n)
        for j in (i, i + 1):
            at = rng.randint(0, len(docs[j]))
            docs[j] = docs[j][:at] + passage + docs[j][at:]
    boiler = text(SPAN - 2)  # too short a passage, in many texts
    for i in range(100, 130):
        docs[i] = text(30) + boiler + text(30)
    for i in range(130, 136):  # the same with one more passage
        docs[i] = text(10) + boiler + "xyz" + text(25)
    docs |= {200: docs[0], 201: docs[0], 210: "-" * 70, 211: "q" + "-" * 45 + "z", 212: "y" + "-" * SPAN, 213: "ab" * 30, 214: "x" + "ab" * 12, 220: "東京😀é" * 15, 221: "..." + "東京😀é" * 6}
    return docs


@pytest.mark.parametrize("pairs_up_to", [64, 3])
def test_all_passages(spark, rng, pairs_up_to, monkeypatch):
    monkeypatch.setattr("folioscope.llm.spans.CHUNK_CHARS", 60)  # long texts in overlapping pieces
    docs = make(rng)
    want, shared = brute(docs, SPAN)
    df = spark.createDataFrame([*docs.items(), (900, None), (901, "")], "doc_id long, text string")
    found = SharedSpans(df, SPAN, GRAM, pairs_up_to)
    got = [(r.doc_id_a, r.doc_id_b) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    per_doc = defaultdict(int)
    repeated = defaultdict(int)
    for r in found.passages().collect():
        per_doc[r.doc_id] += r.n_chars
        repeated[r.doc_id] += r.repeated
    assert {i: n for i, n in shared.items() if n} == dict(per_doc)
    assert all(repeated[i] == 0 for i in (0, 210, 213, 220)) and repeated[200] == len(docs[200]) * (len(docs[200]) >= SPAN)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a" * 30, 0), (1, "a" * 30, 0), (2, "b" * 30, 0)], "doc_id long, text string, h int")
    assert SharedSpans(df, SPAN, GRAM).pairs().count() == 0
    assert SharedSpans(df.limit(0), SPAN, GRAM).pairs().count() == 0
    assert SharedSpans(df.limit(0), SPAN, GRAM).passages().count() == 0


def test_lines(spark):
    """Of equal lines the earliest stays; offsets are those of the text; short and blank lines are no units."""
    docs = [(1, "one Long line here\n\nshort\nanother long line"), (2, "ONE  long line HERE \nsomething else, long"), (3, "x\none long line here"), (3, "x\none long line here"), (4, None), (5, ""), (6, "long " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    units = line_units(df, 10)
    assert sorted((r.doc_id, r.start, r.n_chars, r.repeated) for r in units.collect()) == [(1, 0, 18, False), (1, 26, 17, False), (2, 0, 20, True), (2, 21, 20, False), (3, 2, 18, True), (6, 0, 15000, False)]
    assert sorted((r.doc_id, r.start) for r in kept_lines(units).collect()) == [(1, 0), (1, 26), (2, 21), (6, 0)]
    assert line_units(df.limit(0)).count() == 0
