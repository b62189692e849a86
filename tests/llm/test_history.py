"""Duplicates across batches: single titles, probes against brute force, one batch against many."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import history as H
from folioscope.llm.canonical import edits
from folioscope.llm.components import connected_components

BASE = "Building a Corpus for Urdu Discourse Parsing: The {} Project"
ROWS = [
    (1, 0, "2101.000001v1", BASE.format("Prishuyuni")),
    (2, 0, "arXiv:2101.000001", "Something else altogether"),  # the identifier decides
    (3, 1, None, "the prishuyuni project (Extended Version): Building Corpus in \\emph{Urdu} {Discourse} parsing &nbsp;"),
    (4, 1, "2101.000002", BASE.format("Priehuyuni")),  # one letter
    (5, 1, "2101.000003", BASE.format("Prishuyuni 2.0")),
    (6, 1, "2101.000004", BASE.format("Prishuyuni").replace("Urdu", "Thai")),
    (7, 2, "2101.000005", BASE.format("Zalgrobanti")),
    (8, 2, "unknown", None),
    (9, 2, "NA", "N/A"),
    (10, 2, "", "of the"),
    (10, 2, "", "of the"),
    (11, 3, "2101.000006", "word " * 4000),
    (12, 0, "2101.000003v7", "x"),  # of an earlier batch than row 5
    (13, 3, None, BASE.format("Prishuyuni").replace("for", "fro")),
]
FILLER = [(100 + i, 0, f"2201.{i:06d}", f"Building a Corpus for {lang} Discourse Parsing: The {name} Project") for i, (lang, name) in enumerate((x, y) for x in ("Urdu", "Thai", "Greek") for y in ("Bakolumi", "Drentavor", "Hilpomaske", "Jurtenwal", "Kopsibret", "Lumdrafek", "Mosteriva", "Nelkuprot"))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, batch_no int, paper_id string, title string")


def test_same_and_different_papers(spark):
    got = sorted((r.row_id_a, r.row_id_b) for r in H.duplicates(H.same_papers(frame(spark, ROWS + FILLER))).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 13), (12, 5)]


def test_empty_table(spark):
    assert H.duplicates(H.same_papers(frame(spark, []))).count() == 0


def test_segments_meet_whenever_words_are_near(spark, rng):
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(250)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.probe, r.word): r.edits for r in H.probe_segments(df, H.store_segments(df).withColumn("own", F.lit(False))).collect()}
    want = {}
    for x in words:
        for y in words:
            most = min(H.word_edits(len(x)), H.word_edits(len(y)))
            if x != y and (n := edits(x, y, most)) <= most and not any(set(w) <= set("ivxlc") for w in (x, y)):
                want[x, y] = n
    assert got == want and want
    once = H.probe_segments(df, H.store_segments(df).withColumn("own", F.lit(True))).collect()
    assert {(r.probe, r.word) for r in once} == {(x, y) for x, y in want if x < y} and len(once) * 2 == len(want)


def test_words_of_one_batch_are_probed_by_shorter_ones(spark):
    words = ["abcdefg", "abcdefgh", "abcdefhg", "bcdefg", "abc", "abcd", "unlike"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = H.probe_segments(df, H.store_segments(df).withColumn("own", F.lit(True)), earlier=False).collect()
    want = {(x, y): H.edits(x, y, 2) for x in words for y in words if x < y and H.edits(x, y, 2) <= min(map(H.word_edits, (len(x), len(y))))}
    assert {(r.probe, r.word): r.edits for r in got} == want and len(got) == len(want)


def test_segments_and_probes_as_expressions(spark, rng):
    words = sorted({"".join(rng.choice("abñ𝒶") for _ in range(rng.randint(3, 14))) for _ in range(200)})
    df = spark.createDataFrame([(w, 0) for w in words], "word string, letters long")
    assert {(r.word, r.slot, r.segment) for r in H._stored(df).collect()} == {(w, *x) for w in words for x in H.segments(w, H.word_edits(len(w)))}
    assert {(r.probe, r.len, r.slot, r.segment) for r in H._probing(df).collect()} == {(w, *x) for w in words for x in H.probes(w)}
    assert edits("aab", "ccccb", 2) == 3 and edits("xabcy", "xbacy", 1) == 1  # never above the bound and one


def test_probes_are_never_broadcast(spark, tmp_path):
    words = spark.range(200).select(F.concat(F.lit("w"), F.translate(F.format_string("%09d", F.col("id") * 7919), "0123456789", "abcdefghij")).alias("word"))
    words.write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))  # a small file of which many probes are made
    near = H.probe_segments(words, H.store_segments(words).withColumn("own", F.lit(True)))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    near.collect()
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_words_of_titles_are_never_broadcast(spark):
    index = H.TitleIndex(spark)
    index.accept(frame(spark, ROWS + FILLER))
    bags = index._bags(index.store.all("titles", H._TITLES), index.store.all("words", H._WORDS))
    assert re.search(r"SortMergeJoin(\(.*\))? \[word#\d+\], \[word#\d+\], Inner", bags._jdf.queryExecution().executedPlan().toString())
    assert re.search(r"SortMergeJoin(\(.*\))? \[u#\d+, v#\d+\], \[u#\d+, v#\d+\], Inner", index.links()._jdf.queryExecution().executedPlan().toString())


def pairs(spark, rows, **kw):
    return {(r.row_id_a, r.row_id_b) for r in H.duplicates(H.same_papers(frame(spark, rows), **kw)).collect()}


def test_batches_give_what_all_rows_give(spark):
    rows = FILLER + [(r, b + 1, i, t) for r, b, i, t in ROWS]
    want = pairs(spark, rows)
    assert want and pairs(spark, rows, batches_at_once=1) == want and pairs(spark, rows, batches_at_once=2) == want


def test_an_index_is_opened_again(spark, tmp_path):
    """A version in a later batch under another title, and an interrupted batch."""
    path = f"file://{tmp_path}/index"
    H.TitleIndex(spark, path).accept(frame(spark, FILLER + ROWS[:1]))
    again = H.TitleIndex(spark, path)
    again.store.write("rows", again.store.before("rows", H._ROWS))  # a batch without its mark doesn't count
    third = H.TitleIndex(spark, path)
    third.accept(frame(spark, [(50, 9, "arXiv:2101.000001v4", "Quite Another Title"), (51, 9, None, BASE.format("Prishuyumi"))]))
    assert {(r.row_id_a, r.row_id_b) for r in H.duplicates(H.TitleIndex(spark, path).papers()).collect()} == {(1, 50), (1, 51)}


@pytest.mark.parametrize("n", [8, 60])
def test_frequent_misspelling_of_a_frequent_word(spark, n):
    """Both spellings stand in n titles each: that they stand in each other's place tells, whatever n is."""
    rows = [(k * n + i, k, None, f"The {w} {'abcdefghijklmnopqrst'[i % 20] * 5}{'uvwxyz'[i // 20] * 4} report") for k, w in enumerate(("Zalgrobanti", "Zalgrobenti")) for i in range(n)]
    assert pairs(spark, rows) == {(i, n + i) for i in range(n)}


def test_frequent_near_names_stay_apart(spark):
    """Two names in many titles each, of which few agree otherwise."""
    rows = [(k * 40 + i, 0, None, f"The {w} {'abcdefghijklmnopqrst'[(i + 21 * k) % 20] * 5}{'uvwxyz'[i // 20 + 2 * k] * 4} report") for k, w in enumerate(("Zalgrobanti", "Zalgrobenti")) for i in range(40)]
    rows += [(900, 1, None, "The Zalgrobanti common report"), (901, 1, None, "The Zalgrobenti common report")]
    assert pairs(spark, rows) == set()


def test_typing_errors_in_two_rare_words(spark):
    rows = [(1, 0, None, "The Prishuyuni guide to Zalgrobanti"), (2, 1, None, "The Prishuyumi guide to Zalgrobenti"), (3, 1, None, "The Other guide to Zalgrobenti"), (4, 2, None, "The Prishuyumi guide to Zalgrobanti")]
    for at_once in (None, 1):
        assert pairs(spark, rows, batches_at_once=at_once) == {(1, 2), (1, 4)}


@pytest.mark.parametrize("text,words", [("A {B}ig \\emph{Red} dog.", ["a", "big", "dog", "red"]), ("X 2.0 [preprint] - Supplement included", ["2.0", "x"]), ("&AMP; ﬁne—grained", ["fine", "grained"]), ("...", [])])
def test_title_words(text, words):
    assert H.title_words(text) == words


def test_components(spark, rng):
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(40)] + [(1, 1)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
