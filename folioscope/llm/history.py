"""Deduplicating new batches against everything accepted before (problem 3).

Method: a segment index for edit distance. A string that may have ``k`` edits is stored as ``k + 1``
segments, each under its number, the string's length and the segment's text. A batch string probes, for
each length within ``k``, the few substrings that can stand where a segment stands (as many places off as
edits may lie before and after it); strings that meet are verified with bounded edit distance; then the
batch's own segments are appended. A transposition across a segment's end would touch two segments, so
a string is also stored with the two letters at each end exchanged.

The strings are the words of folded titles, not whole titles, whose common beginnings would bring
thousands of titles under one segment. Pairs of near words decide about titles:

* a word that another one within ``word_edits`` exceeds ``CORRECTS_BY`` times in titles is its
  misspelling and is replaced;
* of two near words of comparable frequency the rarer may stand for the other. A title gives, besides
  the bag of its words, the bags with one or two such words exchanged; titles that share a bag are
  linked. Whether two such words are one is told by their use: at least ``EVIDENCE`` of the rarer
  one's titles must meet a title that has the other in its place. All bounds are ratios, so they judge alike at
  every size.

Titles that differ in a number, a version or a word that both use on their own stay apart.
Two rows are the same paper by identifier (apart from version and writing) or title; both relations and
their chains give components, and a paper's first row in (batch, row) order stands for it.

The index is a folder of tables that are only appended to: rows, titles, word counts, segments, near
words, bags, links. A batch stands in a subfolder of each and counts once its mark is written last, so a
batch that was interrupted is written again, and an index is opened again by its path. A batch shuffles
what meets it: its new words probe the segments, its bags the stored bags; older titles are signed anew
only if one of their words gains a near word. The history's key columns are scanned, never rewritten.

Defined results: rows without identifier and title (null, blank, NA token) are new; a title with no word
left matches nothing; repeated rows are duplicates of their first; an empty table gives no rows; other
columns are not carried along.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import combinations, product

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..session import materialise, scratch_path
from .canonical import edits, fold
from .components import connected_components
from .store import BatchStore

# Words that a title may gain, lose or exchange.
FUNCTION_WORDS = frozenset("a an and at by for from in into of on onto over the to with".split())
# Remarks that authors and archives add to titles.
REMARKS = (
    r"[\[(]\s*(?:(?:extended|full|long|short|revised|updated|final|preliminary|draft|corrected|journal|conference|workshop|arxiv)\s+(?:version|edition|abstract|paper|draft)|camera[\s-]*ready(?:\s+version)?|pre-?print|draft|accepted|to appear|under review|withdrawn|poster|oral|with appendix|(?:with\s+)?supplement(?:ary material)?(?:\s+included)?)\s*[\])]",
    r"[\s:;,.–—-]+(?:with\s+)?(?:supplement(?:ary material)?|appendix)\s+included\s*$",
)
CORRECTS_BY = 10
EVIDENCE = 0.5
EXCHANGED = 2


def title_words(title: str) -> list[str]:
    """The sorted words of a title, folded; numbers keep their decimal point."""
    s = re.sub(r"&#?\w+;", lambda m: html.unescape(m[0].lower()), title) if "&" in title else title
    # what stands in few titles is asked for before a pattern is tried
    s = fold(re.sub(r"\\[A-Za-z]+\s*\{|[{}$]", "", s) if "{" in s or "}" in s or "$" in s else s)
    for _ in range(2 if "(" in s or "[" in s or "included" in s else 0):  # remarks may follow one another
        for r in REMARKS:
            s = re.sub(r, " ", s.rstrip(" .”\"'")) if r.endswith("$") else re.sub(r, " ", s)
    return sorted(re.findall(r"[^\W_]+(?:\.\d+)*", s))


def word_edits(n: int) -> int:
    """Edits that a word of ``n`` letters may have: none below three, one below six, else two."""
    return 0 if n < 3 else 1 if n < 6 else 2


def _bounds(n: int, k: int) -> list[tuple[int, int]]:
    return [(n * i // (k + 1), n * (i + 1) // (k + 1)) for i in range(k + 1)]


def segments(word: str, k: int) -> set[tuple[int, str]]:
    """(number, text) of the ``k + 1`` segments, as they are and with the letters at each inner end exchanged."""
    found = set()
    cut = _bounds(len(word), k)
    for b in [0, *(start for start, _ in cut[1:])]:
        w = word if b == 0 else word[: b - 1] + word[b] + word[b - 1] + word[b + 1 :]
        found |= {(i, w[s:e]) for i, (s, e) in enumerate(cut)}
    return found


def probes(word: str, edits_of=word_edits) -> set[tuple[int, int, str]]:
    """(length of the stored word, number, substring) of which a stored word within the edits has one."""
    seen = set()
    most = edits_of(len(word))
    for n in range(max(3, len(word) - most), len(word) + most + 1):
        k, shift = edits_of(n), len(word) - n
        if abs(shift) > k:
            continue
        for i, (s, e) in enumerate(_bounds(n, k)):
            # at most i edits lie before segment i, at most k - i after it
            for at in range(max(0, s - i, s + shift - (k - i)), min(len(word) - (e - s), s + i, s + shift + k - i) + 1):
                seen.add((n, i, word[at : at + e - s]))
    return seen


def letters(word: str) -> int:
    """Which letters a word has, and which twice, as bits; an edit changes two of them at most."""
    bits = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        bits |= bit << 32 if bits & bit else bit
    return bits - (1 << 64) if bits >> 63 else bits


_KEY = "len int, slot int, segment string, letters long"


def _lettered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(letters=[letters(w) for w in b["word"]])


def _with_segment_ends(t: DataFrame) -> DataFrame:
    """Adds ``slot``, ``s`` and ``e``, the bounds of each segment, to rows with ``len`` and ``k``; a row for each segment."""
    t = t.withColumn("slot", F.explode(F.sequence(F.lit(0), "k")))
    return t.withColumns({"s": F.expr("CAST(len * slot DIV (k + 1) AS INT)"), "e": F.expr("CAST(len * (slot + 1) DIV (k + 1) AS INT)")})


def _edits_of(n: Column) -> Column:
    """:func:`word_edits` as an expression."""
    return F.when(n < 3, 0).when(n < 6, 1).otherwise(2)


def _stored(words: DataFrame) -> DataFrame:
    """The :func:`segments` of (word, letters) as expressions, a row for each."""
    cut = _with_segment_ends(words.withColumn("len", F.length("word")).withColumn("k", _edits_of(F.col("len"))))
    # the segment as it is, with its first letter exchanged for the one before, with its last for the one after
    first = "CASE WHEN slot > 0 AND substring(word, s, 1) != substring(word, s + 1, 1) THEN concat(substring(word, s, 1), substring(word, s + 2, e - s - 1)) END"
    last = "CASE WHEN slot < k AND substring(word, e, 1) != substring(word, e + 1, 1) THEN concat(substring(word, s + 1, e - s - 1), substring(word, e + 1, 1)) END"
    texts = F.array(F.expr("substring(word, s + 1, e - s)"), F.expr(first), F.expr(last))
    return cut.withColumn("segment", F.explode(texts)).where("segment IS NOT NULL").select("word", "len", "slot", "segment", "letters")


def _probing(words: DataFrame) -> DataFrame:
    """The :func:`probes` of (word, letters) as expressions, a row for each; one that a word has twice comes twice."""
    own, most = F.length("word"), _edits_of(F.length("word"))
    t = words.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(3), own - most), own + most))).withColumn("k", _edits_of(F.col("len"))).withColumn("shift", own - F.col("len"))
    t = _with_segment_ends(t.where(F.abs("shift") <= F.col("k")))
    t = t.withColumns({"lo": F.expr("greatest(0, s - slot, s + shift - (k - slot))"), "hi": F.expr("least(length(word) - (e - s), s + slot, s + shift + k - slot)")}).where("lo <= hi")
    return t.withColumn("at", F.explode(F.sequence("lo", "hi"))).select(F.col("word").alias("probe"), "len", "slot", F.expr("substring(word, at + 1, e - s)").alias("segment"), "letters")


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        most = [min(word_edits(len(x)), word_edits(len(y))) for x, y in zip(b["probe"], b["word"], strict=True)]
        b["edits"] = [edits(x, y, m) for x, y, m in zip(b["probe"], b["word"], most, strict=True)]
        yield b[b["edits"] <= pd.Series(most, index=b.index, dtype="int64")]


def _editable(word: Column) -> Column:
    """Words that may hold typing errors: no digits, no Roman numerals, three letters at least."""
    return word.rlike(r"^\D{3,}$") & ~word.rlike(r"^[ivxlc]+$")


def store_segments(words: DataFrame) -> DataFrame:
    """The index rows of the distinct words of (word) that may be edited, under their segments."""
    return _stored(words.where(_editable(F.col("word"))).select("word").mapInPandas(_lettered, "word string, letters long"))


def probe_segments(words: DataFrame, index: DataFrame, earlier: bool = True) -> DataFrame:
    """(probe, word, edits): the distinct words of (word) and the different stored ones within their edits.

    Of two words that both are probes, as ``index.own`` tells, the shorter one probes, whose partner has the longer,
    rarer segments, and of two as long the lesser one; the pair comes out once, the lesser word first. Without
    ``earlier`` all stored words are such ones.
    """
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few rows that make many: over all tasks, however small they are
    asked = words.where(_editable(F.col("word"))).select("word").repartition(tasks, "word").mapInPandas(_lettered, "word string, letters long")
    asked = _probing(asked)
    if not earlier:
        asked = asked.where(F.col("len") >= F.length("probe"))
    # twice the edits that the pair may have: as many letters may differ
    bound = (2 * F.when(F.least(F.length("probe"), F.col("len")) < 6, 1).otherwise(2)).alias("bound")
    # one number for the place and text of a segment: what meets by chance is verified like all others
    place = F.hash("len", "slot", "segment").alias("place")
    # Spark guesses the size of the probes from that of the words, far less: without a hint it would send them to the driver to be broadcast
    met = asked.select(place, "probe", F.col("letters").alias("bits"), bound).hint("merge").join(index.select(place, "word", "letters", "own"), "place")
    most, own, ahead = F.col("bound") / 2, F.col("own"), F.length("word") - F.length("probe")
    # a transposition is one edit here and two of Levenshtein's, and leaves the letters as they are
    other, far = F.bit_count(F.col("bits").bitwiseXOR(F.col("letters"))), F.levenshtein("probe", "word", 4)
    asks = F.when(own, (ahead > 0) | (ahead == 0) & (F.col("probe") < F.col("word"))).otherwise(F.col("probe") != F.col("word"))
    # nearly all that meet by chance end at their letters, so these come first
    close = (other <= F.col("bound")) & asks & (far >= 0) & ((far <= most) | (F.ceil((far - 1) / 2) + F.ceil(other / 2) <= most))
    first, second = (F.when(own, f("probe", "word")).otherwise(F.col(c)).alias(c) for f, c in ((F.least, "probe"), (F.greatest, "word")))
    return met.where(close).select(first, second).distinct().mapInPandas(_verified, "probe string, word string, edits int")


def paper_id(c: Column) -> Column:
    """The identifier without version, prefix, address or blanks; null if there is none."""
    new = F.regexp_extract(c, r"(\d{4}\.\d{4,6})", 1)
    old = F.regexp_extract(F.lower(c), r"([a-z-]+(?:\.[a-z]{2})?/\d{7})", 1)
    return F.when(new != "", new).when(old != "", old)


def title_table(rows: DataFrame) -> DataFrame:
    """(row_id, batch_no, paper, words) of (row_id, batch_no, paper_id, title)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [title_words(t) if t is not None else [] for t in b["title"].to_pylist()]
            yield pa.RecordBatch.from_pydict({c: b[c] for c in ("row_id", "batch_no", "paper")} | {"words": pa.array(words, pa.list_(pa.string()))})

    title = F.when(~is_missing(F.col("title")), F.col("title")).alias("title")
    slim = rows.select(F.col("row_id").cast("long").alias("row_id"), F.col("batch_no").cast("int").alias("batch_no"), paper_id(F.col("paper_id")).alias("paper"), title)
    return slim.mapInArrow(split, "row_id long, batch_no int, paper string, words array<string>")


def digest(c: Column) -> Column:
    """64 bits of a text: among a thousand million different titles less than a pair is expected to share them."""
    return F.xxhash64(c)


def _bag(words: list[str]) -> int:
    """What :func:`digest` gives for the sorted words."""
    h = xxhash.xxh64_intdigest(" ".join(sorted(words)).encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


_ROWS = "row_id long, batch_no int, paper string, words array<string>, key long"
_TITLES = "key long, words array<string>"
_WORDS = "word string, n long"
_SEGMENTS = f"word string, {_KEY}"
_NEAR = "u string, v string, edits int, nu long, nv long"
_SUBS = "array<struct<u:string,v:string,nu:bigint,nv:bigint>>"
_OPTIONS = "array<struct<v:string,nu:bigint,nv:bigint>>"
_BAGS = f"key long, bag long, sig long, subs {_SUBS}, fixed array<string>, ns array<bigint>"
_LINKS = f"key long, bag long, sig long, subs {_SUBS}"


def _exchanged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bags of each title with up to ``EXCHANGED`` words replaced by near ones."""
    for b in batches:
        rows = []
        for key, bag, words, options in zip(b["key"], b["bag"], b["fixed"], b["options"], strict=True):
            near: dict[int, list] = {}
            for o in options:
                near.setdefault(o["at"], []).append(o)
            for m in range(1, EXCHANGED + 1):
                for at in combinations(sorted(near), m):
                    for to in product(*(near[i] for i in at)):
                        new = list(words)
                        for i, o in zip(at, to, strict=True):
                            new[i] = o["v"]
                        subs = [{"u": words[o["at"]], "v": o["v"], "nu": o["nu"], "nv": o["nv"]} for o in to]
                        rows.append((key, bag, _bag([w for w in new if w not in FUNCTION_WORDS]), subs))
        yield pd.DataFrame(rows, columns=["key", "bag", "sig", "subs"])


class TitleIndex:
    """All accepted rows, in a folder. ``accept`` links a batch to what is stored and stores it; ``papers`` tells the papers.

    Without a path the index stands in the shared folder under a new name; with the path of an index it goes on.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.path = path or scratch_path(spark, "titles")
        self.store = BatchStore(spark, self.path)

    def accept(self, rows: DataFrame) -> None:
        """Stores the rows of (row_id, batch_no, paper_id, title) as the next batch."""
        s = self.store
        later = bool(s.batches)
        s.write("rows", keyed_titles(title_table(rows)))
        titles = s.batch("rows", _ROWS).where("key IS NOT NULL").groupBy("key").agg(F.expr("any_value(words) AS words"))
        if later:
            titles = titles.join(s.before("titles", _TITLES).select("key"), "key", "left_anti")
        s.write("titles", titles)
        titles = s.batch("titles", _TITLES)
        s.write("words", titles.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
        words = s.batch("words", _WORDS)
        new = words.join(s.before("words", _WORDS).select("word").distinct(), "word", "left_anti") if later else words
        s.write("segments", store_segments(new))
        index = s.batch("segments", _SEGMENTS).withColumn("own", F.lit(True))
        if later:
            index = index.unionByName(s.before("segments", _SEGMENTS).withColumn("own", F.lit(False)))
        near = probe_segments(new, index, later)
        counts = self._counts(near.select(F.explode(F.array("probe", "word")).alias("word")).distinct()) if later else words
        near = near.join(counts.select(F.col("word").alias("probe"), F.col("n").alias("n_probe")), "probe").join(counts, "word")
        low, high = (f(F.struct(F.col("n_probe").alias("n"), F.col("probe").alias("w")), F.struct(F.col("n").alias("n"), F.col("word").alias("w"))) for f in (F.least, F.greatest))
        near = near.select(low.alias("x"), high.alias("y"), "edits").select(F.col("x.w").alias("u"), F.col("y.w").alias("v"), "edits", F.col("x.n").alias("nu"), F.col("y.n").alias("nv"))
        s.write("near", near)
        if later:  # older titles one of whose words has a near word now that it may stand for
            gained = s.batch("near", _NEAR).select(F.col("u").alias("word")).distinct()
            again = s.before("titles", _TITLES).select("key", "words", F.explode("words").alias("word")).join(gained, "word", "left_semi").select("key", "words").distinct()
            titles = materialise(titles.unionByName(again))
            counts = materialise(self._counts(titles.select(F.explode("words").alias("word")).distinct()))
        s.write("bags", self._bags(titles, counts if later else words))
        bags = s.all("bags", _BAGS)
        if later:
            bags = bags.join(s.batch("bags", _BAGS).select("sig").distinct(), "sig", "left_semi")
        shared = bags.groupBy("sig").agg(F.min("bag").alias("lo"), F.max("bag").alias("hi")).where("lo < hi").select("sig")
        links = bags.where("sig != bag").join(shared, "sig").select("key", "bag", "sig", "subs")
        if later:  # a title signed anew may have another bag
            fresh = s.batch("bags", _BAGS).where("sig = bag").select("key", F.col("bag").alias("sig"))
            links = links.unionByName(s.before("bags", _BAGS).where("sig = bag").join(fresh, "key").where(F.col("bag") != fresh["sig"]).select("key", "bag", fresh["sig"], F.array().cast(_SUBS).alias("subs")))
        s.write("links", links)
        s.close()

    def _counts(self, words: DataFrame) -> DataFrame:
        """(word, n) of the given words over all batches."""
        return self.store.all("words", _WORDS).join(words, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))

    def _bags(self, titles: DataFrame, counts: DataFrame) -> DataFrame:
        near = self.store.all("near", _NEAR)
        if len(self.store.batches):
            near = near.join(counts.select(F.col("word").alias("u")), "u", "left_semi")
        best = F.min(F.when(F.col("nv") >= CORRECTS_BY * F.col("nu"), F.struct("edits", (-F.col("nv")).alias("rank"), "v"))).alias("best")
        options = F.collect_set(F.struct("v", "nu", "nv")).alias("options")  # bounded by the words within a few edits
        chosen = near.groupBy(F.col("u").alias("word")).agg(best, options)
        vocabulary = counts.join(chosen, "word", "left").select("word", F.coalesce("best.v", "word").alias("to"), F.coalesce(-F.col("best.rank"), F.col("n")).alias("n"), F.when(F.col("best").isNull(), F.col("options")).alias("options"))
        # function words go after correction, since they are mistyped too
        # the words are many times the titles' compressed file, by which Spark would judge them fit for a broadcast
        one = titles.select("key", F.explode("words").alias("word")).hint("merge").join(vocabulary, "word").where(~F.col("to").isin(*sorted(FUNCTION_WORDS)))
        parts = one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("to", "n", "options"))).alias("parts"))  # the words of one title
        near_at = F.transform("parts", lambda p, i: F.transform(F.coalesce(p.options, F.array().cast(_OPTIONS)), lambda o: F.struct(i.alias("at"), o.v.alias("v"), o.nu.alias("nu"), o.nv.alias("nv"))))
        bags = parts.select("key", digest(F.array_join("parts.to", " ")).alias("bag"), F.col("parts.to").alias("fixed"), F.col("parts.n").alias("ns"), F.flatten(near_at).alias("options"), F.exists("parts", lambda p: p.options.isNotNull()).alias("open"))
        open_ = bags.where("open AND size(fixed) > 1").select("key", "bag", "fixed", "options").mapInPandas(_exchanged, f"key long, bag long, sig long, subs {_SUBS}")
        return bags.select("key", "bag", F.col("bag").alias("sig"), F.array().cast(_SUBS).alias("subs"), "fixed", "ns").unionByName(open_, allowMissingColumns=True)

    def rows(self) -> DataFrame:
        """(row_id, batch_no, key, paper) of all accepted rows; ``paper`` is the identifier."""
        return self.store.all("rows", _ROWS).select("row_id", "batch_no", "key", "paper")

    def bag_words(self) -> DataFrame:
        """(key, bag, fixed, ns): each title's corrected words and the number of titles that hold them."""
        own = self.store.all("bags", _BAGS).where("sig = bag")
        if len(self.store.batches) == 1:  # no title is signed twice
            return own.select("key", "bag", "fixed", "ns")
        return own.groupBy("key").agg(F.min_by(F.struct("bag", "fixed", "ns"), "bag").alias("b")).select("key", "b.*")

    def links(self) -> DataFrame:
        """(key, a, b): bags that a title shares, its own and those whose exchanged words, all of them, are one word by their use."""
        # a title that is signed anew repeats its links, but not within a batch
        links = self.store.all("links", _LINKS).withColumn("link", F.xxhash64("key", "bag", "sig", "subs"))
        if len(self.store.batches) > 1:
            links = links.dropDuplicates(["link"])
        plain = links.where("size(subs) = 0").select("key", F.col("bag").alias("a"), F.col("sig").alias("b"))
        one = links.where("size(subs) > 0").select("key", "bag", "sig", "link", F.size("subs").alias("of"), F.explode("subs").alias("x")).select("key", "bag", "sig", "link", "of", F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("x.nu").alias("nu"))
        # the titles of the rarer word that meet the other
        used = one.groupBy("u", "v").agg(F.countDistinct("key").alias("met"), F.max("nu").alias("n")).where(F.col("met") >= EVIDENCE * F.col("n")).select("u", "v")
        held = one.hint("merge").join(used, ["u", "v"]).groupBy("link").agg(F.first("key").alias("key"), F.first("bag").alias("bag"), F.first("sig").alias("sig"), F.count("*").alias("k"), F.first("of").alias("of")).where("k = of")
        return plain.unionByName(held.select("key", F.col("bag").alias("a"), F.col("sig").alias("b")))

    def papers(self, before: int | None = None) -> DataFrame:
        """(row_id, batch_no, key, paper): title key and component of each row (of batch numbers below ``before``); null if it has neither key.

        Nodes are bags of words. An identifier is an edge from each of its bags to the least one, so the
        papers with one bag, nearly all, never enter the search for components.
        """
        rows, links = self.rows(), self.links()
        if before is not None:
            rows = rows.where(F.col("batch_no") < before)
            links = links.join(rows.select("key").distinct(), "key", "left_semi")
        bagged = materialise(rows.join(self.bag_words().select("key", "bag"), "key", "left"))
        of_id = bagged.where("paper IS NOT NULL AND bag IS NOT NULL").select("paper", "bag").distinct()
        least = of_id.groupBy("paper").agg(F.min("bag").alias("least"), F.max("bag").alias("most"))
        several = least.where("least != most").select("paper", "least")
        components = connected_components(links.select("a", "b").unionByName(of_id.join(several, "paper").select(F.col("bag").alias("a"), F.col("least").alias("b"))))
        with_bag = bagged.where("bag IS NOT NULL").withColumn("node", F.col("bag"))
        without = bagged.where("bag IS NULL").join(least.select("paper", "least"), "paper", "left").withColumn("node", F.coalesce("least", F.when(F.col("paper").isNotNull(), F.xxhash64(F.lit("i"), "paper")))).select(*with_bag.columns)
        return with_bag.unionByName(without).join(components, "node", "left").select("row_id", "batch_no", "key", F.coalesce("component", "node").alias("paper"))

    def drop(self) -> None:
        self.store.drop()


def keyed_titles(titles: DataFrame) -> DataFrame:
    """Adds ``key``, the digest of the words; null without words."""
    return titles.withColumn("key", F.when(F.size("words") > 0, digest(F.array_join("words", " "))))


def same_papers(rows: DataFrame, batches_at_once: int | None = None) -> DataFrame:
    """(row_id, batch_no, paper): the component of each row of (row_id, batch_no, paper_id, title); null if it has no key.

    Rows are accepted in the order of ``batch_no``, ``batches_at_once`` numbers at a time (all at once by default).
    """
    index = TitleIndex(rows.sparkSession)
    if batches_at_once is None:
        index.accept(rows)
    else:
        low, high = rows.agg(F.min("batch_no"), F.max("batch_no")).first()
        for at in range(low, high + 1, batches_at_once) if low is not None else ():
            index.accept(rows.where((F.col("batch_no") >= at) & (F.col("batch_no") < at + batches_at_once)))
    return index.papers().select("row_id", "batch_no", "paper")


def duplicates(papers: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): for each row that isn't the first of its paper, the first row."""
    order = F.struct("batch_no", "row_id")
    first = papers.where("paper IS NOT NULL").groupBy("paper").agg(F.min(order).alias("first"))
    return papers.join(first, "paper").where(F.col("row_id") != F.col("first.row_id")).select(F.col("first.row_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))
