"""Feeds, notes, paged sources, sinks and streams on fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioscope import schemas, sinks
from folioscope.operators.resolve import with_decisions
from folioscope.plans import sources as plans
from folioscope.sources import atom, notes, paged
from folioscope.sources.tables import nulls_for_na, read_csv
from folioscope.streaming import jobs

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">{entries}</feed>"""
ENTRY = """<entry><id>http://x/abs/{id}</id><published>{date}T23:30:00-02:00</published><updated>{date}T10:00:00Z</updated><title>{title}</title><summary> a
 b </summary>{authors}<link href="http://x/abs/{id}" rel="alternate"/><link title="pdf" href="http://x/pdf/{id}"/><arxiv:primary_category term="{cat}"/><category term="{cat}"/><category term=""/></entry>"""
AUTHORS = "<author><name>Ann Lee</name><arxiv:affiliation>U. X</arxiv:affiliation></author><author><name>Bo Chu</name></author>"


def entry(i, date="2025-10-02", title="T\n x", authors=AUTHORS, cat="cs.CL"):
    return ENTRY.format(id=f"2510.{i:05d}v1", date=date, title=title, authors=authors, cat=cat)


def test_feed_to_records(spark, tmp_path):
    good = [entry(1), entry(2, cat="cs.CV"), entry(3, date="2025-09-01"), entry(4, title=""), entry(5, authors="<author><arxiv:affiliation>U. X</arxiv:affiliation></author>")]
    (tmp_path / "page.xml").write_text(FEED.format(entries="".join(good)))
    papers, rejects = atom.papers_and_rejects(atom.read_atom(spark, str(tmp_path)), "2025-10-01", "2025-11-01")
    assert papers.columns == schemas.RAW_COLUMNS
    [p] = papers.collect()
    assert (p["arXiv ID"], p["PDF URL"], p["Title"], p["Abstract"]) == ("2510.00001v1", "http://x/pdf/2510.00001v1", "T  x", "a  b")
    assert (p["Publication Date"], p["Updated Date"]) == ("2025-10-03", "2025-10-02")  # UTC dates
    assert (p["Authors"], p["Author Affiliations"], p["Categories"], p["DOI"]) == ("Ann Lee; Bo Chu", "Ann Lee: U. X", "cs.CL", "")
    assert sorted(r._bad for r in rejects.collect()) == ["affiliation without name", "no title"]


def raw_rows(spark, tmp_path, rows, files=1):
    """A folder with arxiv_results of (url, title) rows."""
    blank = ["DOI", "Comment", "Journal Reference", "Authors"]
    df = spark.createDataFrame(rows, "`arXiv URL` string, Title string").repartition(files)
    df.select("*", F.lit("A < B & C").alias("Abstract"), F.lit("cs.CL").alias("Primary Category"), *(F.lit(None).cast("string").alias(c) for c in blank)).write.parquet(str(tmp_path / "arxiv_results.parquet"))
    return str(tmp_path)


def test_feed_query_reads_every_entry_of_a_file(spark, tmp_path):
    folder = raw_rows(spark, tmp_path, [(f"http://x/abs/{i}", f"T {i}") for i in range(40)], files=3)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)  # must not cut a document
    try:
        got = sorted(int(r.paper) for r in plans.QUERIES["feed_entries"](spark, folder).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert got == list(range(40))


def test_feed_query_rejects_entries_without_title_only(spark, tmp_path):
    folder = raw_rows(spark, tmp_path, [("http://x/abs/1", "T"), ("http://x/abs/2", " "), ("http://x/abs/3", None), ("http://x/abs/4", "<T> & T")])
    assert [tuple(r) for r in plans.QUERIES["feed_rejects"](spark, folder).collect()] == [("no title", 2)]


def test_a_title_of_any_white_space_is_none(spark, tmp_path):
    blank = ["\u00a0", "\u0085", "\u2028", "\u3000 \u2003", "\x0b\u1680"]
    folder = raw_rows(spark, tmp_path, [(f"http://x/abs/{i}", t) for i, t in enumerate([*blank, "\u00a0T", "\u200b", "null"])])
    assert [tuple(r) for r in plans.QUERIES["feed_rejects"](spark, folder).collect()] == [("no title", len(blank))]
    assert sorted(r.paper for r in plans.QUERIES["feed_entries"](spark, folder).collect()) == ["5", "6", "7"]


def test_last_piece_and_dates(spark):
    df = spark.createDataFrame([("http://x/abs/1v2",), ("plain",), (None,)], "u string")
    assert [r[0] for r in df.select(atom.last_piece(F.col("u"), "/abs/")).collect()] == ["1v2", "plain", ""]


def note(**content):
    return json.dumps({"forum": "f1", "content": content})


def test_notes_of_both_kinds(spark):
    wrapped = {k: {"value": v} for k, v in {"title": " T ", "abstract": "A", "keywords": ["NLP"], "authors": ["Ann", "Bo"], "authorids": ["~A1"], "venue": "V", "primary_area": "P"}.items()}
    rows = [
        (2020, "Withdrawn_Submission", note(title="T\n", abstract="A", keywords=["NLP", "Data"], authors=["Ann", "Bo"], authorids=["a@x"])),
        (2023, "Desk_Rejected_Submission", note(title="T", abstract="A", keywords="one", authors="Ann")),
        (2024, "Rejected_Submission", note(**wrapped)),
        (2024, "", json.dumps({"id": "i1", "content": {}})),
        (2024, "", json.dumps({"content": {}})),
        (2024, "", "no json"),
    ]
    out = notes.conference_papers(spark.createDataFrame(rows, "year int, query_type string, note string"), "http://r/").collect()
    assert [r.decision for r in out] == ["Withdrawn", "Desk rejected", "Reject", "", ""]
    assert [r.authors for r in out] == ["Ann, Bo", "Ann", "Ann, Bo", "", ""]
    assert [r.author_ids for r in out][:3] == ["", "", "~A1"] and [r.keywords for r in out][:3] == [["nlp", "data"], ["one"], ["nlp"]]
    assert [(r.id, r.title, r.venue) for r in out] == [("f1", "T", ""), ("f1", "T", ""), ("f1", "T", "V"), ("i1", "", ""), ("", "", "")]
    assert out[0].openreview_url == "http://r/f1" and tuple(out[0].asDict()) == tuple(schemas.CONFERENCE_COLUMNS)


def save(folder, group, start, text):
    (folder / f"{group.replace('/', '_')}-{start}").write_text(text)


@pytest.fixture
def pages(tmp_path):
    save(tmp_path, "cs.CL", 0, FEED.format(entries=entry(1) + entry(2)))
    save(tmp_path, "cs.CL", 2, FEED.format(entries=entry(3, date="2025-09-01")))  # older than the range: ends the class
    save(tmp_path, "cs.CL", 3, FEED.format(entries=entry(4)))
    save(tmp_path, "cs.LG", 0, "<feed>")
    save(tmp_path, "cs.IR", 0, FEED.format(entries=entry(5)))
    return tmp_path


def feed(reader, folder):
    return reader.format("feed_pages").option("transport", f"file:{folder}").option("categories", "cs.CL,cs.LG,cs.IR").option("startDate", "2025-10-01").option("endDate", "2025-11-01")


def test_paged_feed(spark, pages):
    paged.register(spark)
    got = feed(spark.read, pages).load()
    assert sorted((r.group, r.start, r.n_items) for r in got.collect()) == [("cs.CL", 0, 2), ("cs.CL", 2, 1), ("cs.IR", 0, 1)]
    assert got.rdd.getNumPartitions() == 1
    assert feed(spark.read, pages).option("partitions", "3").load().count() == 3
    assert feed(spark.read, pages).option("rowCap", "2").load().count() == 1
    [url] = {r.url.split("?")[1] for r in got.where("group = 'cs.IR'").collect()}
    assert "search_query=cat%3Acs.IR+AND+submittedDate%3A%5B20251001+TO+20251101%5D&start=0&max_results=2000" in url


def test_paged_feed_as_stream(spark, pages, tmp_path):
    paged.register(spark)
    out = jobs.run_available(feed(spark.readStream, pages).load())
    assert sorted((r.group, r.start) for r in out.collect()) == [("cs.CL", 0), ("cs.CL", 2), ("cs.IR", 0)]


def note_pages(spark, folder, **options):
    reader = spark.read.format("note_pages").options(transport=f"file:{folder}", flat="http://v1", wrapped="http://v2", host="conf", pageSize="2", **options)
    return reader.load()


def test_paged_notes(spark, tmp_path):
    """Every status of every year, each at the address of its year, until a page isn't full."""
    paged.register(spark)
    full = json.dumps({"notes": [{"id": "a"}, {"id": "b"}]})
    save(tmp_path, "2024_", 0, full), save(tmp_path, "2024_", 2, json.dumps({"notes": [{"id": "c"}]})), save(tmp_path, "2024_", 4, full)
    save(tmp_path, "2023_Submission", 0, "broken"), save(tmp_path, "2023_Rejected_Submission", 0, json.dumps({"notes": [{"id": "d"}]}))
    got = note_pages(spark, tmp_path, fromYear="2023", toYear="2024")
    assert {(r.group, r.start): r.url for r in got.collect()} == {
        ("2024/", 0): "http://v2?content.venueid=conf.cc/2024/Conference&offset=0",
        ("2024/", 2): "http://v2?content.venueid=conf.cc/2024/Conference&offset=2",
        ("2023/Rejected_Submission", 0): "http://v1?invitation=conf.cc%2F2023%2FConference%2F-%2FRejected_Submission&offset=0",
    }
    found = notes.conference_papers(paged.notes_of_pages(got), "f=").select("year", "id", "decision")
    assert sorted(tuple(r) for r in found.collect()) == [(2023, "d", "Reject"), (2024, "a", ""), (2024, "b", ""), (2024, "c", "")]
    assert paged.crawl_totals(got).first().asDict() == {"pages": 3, "items": 4, "groups": 2}
    assert paged.capped(found, 2).count() == 2


def test_a_track_is_scanned_without_statuses(spark, tmp_path):
    paged.register(spark)
    save(tmp_path, "2024_Some_Track", 0, json.dumps({"notes": [{"id": "a"}]})), save(tmp_path, "2023_Some_Track", 0, json.dumps({"notes": [{"id": "b"}]}))
    [row] = note_pages(spark, tmp_path, fromYear="2023", toYear="2024", tracks="Some_Track").collect()
    assert row.url == "http://v2?content.venueid=conf.cc/2024/Some_Track&offset=0" and row.n_items == 1


def test_forum_lookup_feeds_decisions(spark, tmp_path):
    """One request a paper; a paper without an answer keeps what it has."""
    save(tmp_path, "forum_a", 0, json.dumps({"notes": [{"content": {"rating": {"value": "8: top"}}}, {"content": {"decision": {"value": "Accept"}}}]}))
    save(tmp_path, "forum_b", 0, "broken")
    papers = spark.createDataFrame([("a", 2024, "", [0]), ("a", 2024, "", [0]), ("b", 2024, "Reject", [3]), ("c", 2020, None, None), (None, 2020, None, None)], "id string, year int, decision string, scores array<int>")
    replies = paged.forum_replies(papers, "http://v1", "http://v2", f"file:{tmp_path}")
    assert [(r.forum, r.year) for r in replies.collect()] == [("a", 2024)]
    got = sorted((r.id or "", r.decision, r.scores) for r in with_decisions(papers, replies).collect())
    assert got == [("", "", []), ("a", "Accept", [8]), ("a", "Accept", [8]), ("b", "Reject", [3]), ("c", "", [])]
    assert paged.forum_url("1", "2", 2023, "x/y") == "1?forum=x%2Fy" and paged.forum_url("1", "2", 2024, "x") == "2?forum=x"


def test_rate_limit_in_the_answer_is_waited_out(tmp_path):
    limit, page = json.dumps({"name": "RateLimitError", "message": "slow"}), json.dumps({"notes": [{"title": "RateLimitError"}]})
    asked = []

    def host(*answers):
        left = list(answers)

        def get(url):
            asked.append(url)
            if isinstance(x := left.pop(0), Exception):
                raise x
            return x

        return paged.HttpTransport(0, 0, get)

    assert host(limit, page).fetch("g", 0, "u") == page and len(asked) == 2
    assert host(limit, limit).fetch("g", 0, "u") is None
    assert host(OSError()).fetch("g", 0, "u") is None
    kept = paged.ArchiveTransport(str(tmp_path), host(page))
    assert kept.fetch("g", 0, "u") == kept.fetch("g", 0, "u") == page  # the second comes from the folder


def test_notes_addresses(spark):
    df = spark.createDataFrame([(2017, "s"), (2020, "s"), (2020, ""), (2024, ""), (2024, "s")], "y int, q string")
    url = paged.notes_url_column("1", "2", "c", F.col("y"), F.col("q"), F.lit(0))
    assert [r[0] for r in df.select(url).collect()] == ["1?invitation=c.cc%2F2017%2Fconference%2F-%2Fs&offset=0", "1?invitation=c.cc%2F2020%2FConference%2F-%2Fs&offset=0", None, "2?content.venueid=c.cc/2024/Conference&offset=0", "2?content.venueid=c.cc/2024/Conference/s&offset=0"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(2024, "i", ' a "q", b\n c ', None, "\\x", "", "", "", "", [1, 2], ["k", " l"], "u")]
    papers = spark.createDataFrame(rows, schemas.CONFERENCE_PAPER)
    sinks.write_quoted_csv(papers, str(tmp_path / "a"))
    back = read_csv(spark, str(tmp_path / "a"), sinks.for_quoted_csv(papers).schema, na=False).first()
    assert (back.title, back.scores, back.keywords, back.authors) == ('a "q", b c', "1, 2", "k,  l", "\\\\x")
    sinks.write_papers(papers, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).first().scores == [1, 2]
    for _ in range(2):
        sinks.write_csv(papers.select("id", "title"), str(tmp_path / "c"), mode="append")
    assert read_csv(spark, str(tmp_path / "c"), schemas.strings(["id", "title"])).count() == 2


def test_na_rule_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("NA", 1), ("None", 2), ("No LLM", 3)], "c string, n int")
    assert [r.c for r in nulls_for_na(df).collect()] == [None, None, "No LLM"]
    sections = spark.createDataFrame([("s", "b", 1), ("s", "a", 2)], "section string, value string, n long")
    assert sinks.report_json(sections).first().json == '{"a":2,"b":1}'
    sinks.write_text_report(sections, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    assert sinks.stamped("x", "csv").startswith("x_2")


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    events = spark.range(60).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id") * 7200)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2).cast("string").alias("kind"))
    events.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    results = []
    for n in (None, 1):
        stream = jobs.stream_table(spark, str(tmp_path), "events", n)
        results.append(sorted(tuple(r) for r in jobs.run_available(jobs.daily_counts(stream, "ts", "kind"), "complete").collect()))
    want = events.groupBy(F.to_date("ts"), "kind").count().collect()
    assert results[0] == results[1] == sorted(tuple(r) for r in want)


def test_landing_is_appended_once(spark, tmp_path):
    landing = str(tmp_path / "landing")
    spark.range(3).write.parquet(landing)
    for extra in (0, 2):
        if extra:
            spark.range(10, 10 + extra).write.mode("append").parquet(landing)
        jobs.append_landing(spark.readStream.schema("id long").parquet(landing), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
