"""Long exact spans shared between records (problem 9).

Method: line hashing. Units are digested, digests are grouped globally, the earliest holder of a
unit is kept and offsets stay those of the original text. A verbatim passage of ``SPAN`` characters
may begin and end anywhere and hold no whole line, so units are not cut at line breaks but at places
that the content itself chooses: of every ``WINDOW`` consecutive grams of ``GRAM`` characters the one
with the least hash is a unit (``GRAM + WINDOW - 1 = SPAN``). Two texts with a common passage of
``SPAN`` characters therefore share at least one unit inside it. Nothing is normalised, since the
problem asks for verbatim passages.

Units that stand in one text only drop out by their digests alone. For the others the characters
around the unit decide exactly: two occurrences lie in a common passage if what they share to the
left, the unit, and what they share to the right add up to ``SPAN``. Units in at most ``PAIRS_UP_TO``
texts are compared in pairs. Units in more texts (boilerplate shorter than a passage) are not paired:
each occurrence gives the digests of the passages of exactly ``SPAN`` characters that contain it, and
texts meet only where they share such a passage.

The pieces that passages are made of come from at most ``PAIRS_UP_TO`` comparisons an occurrence, or
from passage digests, so the stretches of each document take work in proportion to the texts; only
:meth:`SharedSpans.pairs` makes pairs, because pairs are what is asked.

Whole lines are the other kind of unit (:func:`line_units`): normalised, digested and grouped globally, with the
earliest occurrence told from the rest, which :func:`kept_lines` removes while offsets stay those of the
original text.

Copies of whole texts are one class each, represented by the row of least id.

Defined results: null, empty and shorter texts share nothing; repeated rows and copies share all of
their text (if it has ``SPAN`` characters); a row id counts once; ties are broken by least id and
offset; other columns are not carried along. Offsets count code points from 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SPAN = 200
GRAM = 100
WINDOW = SPAN - GRAM + 1
PAIRS_UP_TO = 64
LINE = 40
CHUNK_CHARS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.r_[np.uint64(1), np.cumprod(np.full(size, b, dtype=np.uint64))] for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[size]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that begins at each place (wrap-around polynomial, then mixed)."""
    up, down = _power_tables(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``width`` consecutive values, by doubling."""
    best, step, pick = x, 1, np.minimum if least else np.maximum
    while step * 2 <= width:
        best = pick(best[:-step], best[step:])
        step *= 2
    return pick(best[: len(best) - (width - step)], best[width - step :]) if width > step else best


def chosen_grams(texts: list[str], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, offset, hash) of the units of texts that each have ``gram + window - 1`` characters."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    h = gram_hashes(codes, gram)
    least = _slide(h, window, True)  # a window per start; those across texts are blanked
    span = gram + window - 1
    bad = np.concatenate([np.arange(e - span + 1, e) for e in ends])
    least[bad[bad < len(least)]] = 0
    pad = np.zeros(window - 1, dtype=np.uint64)
    at = np.nonzero(h == _slide(np.concatenate([pad, least, pad]), window, False))[0]
    at = at[h[at] != 0]
    which = np.searchsorted(ends, at, side="right")
    return which, at - (ends - sizes)[which], h[at]


def _pieces(texts: list[str], span: int) -> Iterator[list[tuple[int, int, str]]]:
    """Chunks of (text number, offset, piece); long texts are cut with an overlap that loses no window."""
    chunk, chars = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - span + 1, CHUNK_CHARS):
            piece = t if len(t) <= CHUNK_CHARS else t[at : at + CHUNK_CHARS + span - 1]
            if chunk and chars + len(piece) > CHUNK_CHARS:
                yield chunk
                chunk, chars = [], 0
            chunk.append((k, at, piece))
            chars += len(piece)
    if chunk:
        yield chunk


def text_units(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(h, doc_id, pos) of the units of each text of (doc_id, text)."""
    span = gram + window - 1

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for chunk in _pieces(texts, span):
                which, pos, h = chosen_grams([x[2] for x in chunk], gram, window)
                owner, shift = np.array([x[0] for x in chunk])[which], np.array([x[1] for x in chunk])[which]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[owner]), pa.array((pos + shift).astype(np.int32))], names=["h", "doc_id", "pos"])

    return docs.where(F.length("text") >= span).select(F.col("doc_id").cast("long"), "text").mapInArrow(units, "h long, doc_id long, pos int")


def text_classes(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, rep, n_copies, n_chars): the class of equal texts of each text of at least ``span`` characters."""
    keyed = docs.where(F.length("text") >= span).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))
    keyed = keyed.distinct()
    classes = keyed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    return keyed.join(classes, "digest").select("doc_id", "rep", "n_copies", "n_chars")


def _shared(a: str, b: str, most: int) -> int:
    """Length of the common prefix, ``most`` at most."""
    if a == b:
        return min(len(a), most)
    lo, hi = 0, min(len(a), len(b), most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


_LINKS = "doc_id_a long, doc_id_b long, start_a int, start_b int, n_chars int"


class SharedSpans:
    """The spans shared between the texts of (doc_id, text); each result is computed once and kept in the shared folder."""

    def __init__(self, docs: DataFrame, span: int = SPAN, gram: int = GRAM, pairs_up_to: int = PAIRS_UP_TO):
        self.span, self.gram, self.window, self.pairs_up_to = span, gram, span - gram + 1, pairs_up_to
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.classes = materialise(text_classes(self.docs, span))
        occurrences = self._occurrences()
        self.links = materialise(self._verified_pairs(occurrences))
        self._common_passages(occurrences)

    def _occurrences(self) -> DataFrame:
        """(h, doc_id, pos, before, ctx, n): units that stand in two or more classes, with what surrounds them."""
        units = materialise(text_units(self.docs, self.gram, self.window))
        several = units.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
        copies = self.classes.where("doc_id != rep").select("doc_id")
        found = materialise(units.join(several, "h", "left_semi").join(copies, "doc_id", "left_anti"))
        counts = found.groupBy("h").agg(F.count("*").alias("m"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        counts = counts.where("a < b").select("h", "m")
        per_doc = found.join(counts, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos", "m")).alias("units"))  # bounded by the text
        gram, window = self.gram, self.window

        def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for doc, text, units in zip(b["doc_id"], b["text"], b["units"], strict=True):
                    for u in units:
                        start = max(0, u["pos"] - window + 1)
                        rows.append((u["h"], doc, u["pos"], u["pos"] - start, text[start : u["pos"] + gram + window - 1], u["m"]))
                yield pd.DataFrame(rows, columns=["h", "doc_id", "pos", "before", "ctx", "m"])

        with_text = self.docs.join(per_doc, "doc_id").dropDuplicates(["doc_id"])
        return materialise(with_text.select("doc_id", "text", "units").mapInPandas(around, "h long, doc_id long, pos int, before int, ctx string, m long"))

    def _verified_pairs(self, occ: DataFrame) -> DataFrame:
        """Verified pieces of common passages around units of few texts, between class representatives."""
        span, gram, window = self.span, self.gram, self.window
        few = occ.where(F.col("m") <= self.pairs_up_to)
        a, b = (few.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "pos", "before", "ctx"))) for s in "ab")
        pairs = a.join(b, "h").where("doc_id_a < doc_id_b")

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                rows = []
                for da, pa_, na, ca, db, pb, nb, cb in zip(*(x[c] for c in ("doc_id_a", "pos_a", "before_a", "ctx_a", "doc_id_b", "pos_b", "before_b", "ctx_b")), strict=True):
                    right = _shared(ca[na:], cb[nb:], gram + window - 1)
                    if right < gram:
                        continue  # equal hashes of different units
                    left = _shared(ca[:na][::-1], cb[:nb][::-1], window - 1)
                    if left + right >= span:
                        rows.append((da, db, pa_ - left, pb - left, left + right))
                yield pd.DataFrame(rows, columns=["doc_id_a", "doc_id_b", "start_a", "start_b", "n_chars"])

        return pairs.drop("h").mapInPandas(verify, _LINKS).distinct()

    def _common_passages(self, occ: DataFrame) -> None:
        """The passages around units of many texts: ``held`` by (passage, doc_id), ``boilerplate`` as pieces of documents."""
        span, window = self.span, self.window

        def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                rows = []
                for doc, pos, before, ctx in zip(x["doc_id"], x["pos"], x["before"], x["ctx"], strict=True):
                    rows += [(ctx[k : k + span], doc, pos - before + k) for k in range(max(0, before - window + 1), min(before, len(ctx) - span) + 1)]
                yield pd.DataFrame(rows, columns=["passage", "doc_id", "start"])

        many = occ.where(F.col("m") > self.pairs_up_to).select("doc_id", "pos", "before", "ctx").mapInPandas(passages, "passage string, doc_id long, start int")
        many = materialise(many.select(F.sha2("passage", 256).alias("passage"), "doc_id", "start").distinct())
        self.held = many.groupBy("passage", "doc_id").agg(F.min("start").alias("start"))
        first = self.held.groupBy("passage").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        self.boilerplate = many.join(first, "passage").select("doc_id", "start", (F.col("start") + span).alias("end"), (F.col("doc_id") != F.col("first")).alias("later"))

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b) of all rows, copies included, that have a common passage."""
        x, y = (self.held.select("passage", F.col("doc_id").alias(s)) for s in ("ra", "rb"))
        common = x.join(y, "passage").where("ra < rb").select("ra", "rb")
        rep_pairs = self.links.select(F.col("doc_id_a").alias("ra"), F.col("doc_id_b").alias("rb")).unionByName(common).distinct()
        a = self.classes.select(F.col("rep").alias("ra"), F.col("doc_id").alias("a"))
        b = self.classes.select(F.col("rep").alias("rb"), F.col("doc_id").alias("b"))
        across = rep_pairs.join(a, "ra").join(b, "rb").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
        many = self.classes.where("n_copies > 1")
        x, y = (many.select("rep", F.col("doc_id").alias(f"doc_id_{s}")) for s in "ab")
        within = x.join(y, "rep").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
        return across.unionByName(within)

    def passages(self) -> DataFrame:
        """(doc_id, start, n_chars, repeated): maximal stretches that stand in other texts too.

        ``repeated`` is the number of their characters that stand in a text of smaller id: what goes
        if the earliest occurrence alone is kept.
        """
        n = self.classes
        copied = n.where("n_copies > 1").select("doc_id", F.lit(0).alias("start"), F.col("n_chars").alias("end"), (F.col("doc_id") != F.col("rep")).alias("later"))
        one = self.links.select(F.col("doc_id_a").alias("doc_id"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("n_chars")).alias("end"), F.lit(False).alias("later"))
        two = self.links.select(F.col("doc_id_b").alias("doc_id"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("n_chars")).alias("end"), F.lit(True).alias("later"))
        pieces = copied.unionByName(one).unionByName(two).unionByName(self.boilerplate)

        def merged(p: DataFrame) -> DataFrame:
            order = Window.partitionBy("doc_id").orderBy("start", "end")
            far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
            p = p.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
            p = p.withColumn("new", F.coalesce(F.col("start") > far, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(order))
            return p.groupBy("doc_id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")

        all_, late = merged(pieces), merged(pieces.where("later"))
        inside = all_.alias("x").join(late.alias("y"), F.expr("x.doc_id = y.doc_id AND y.start >= x.start AND y.end <= x.end"), "left")
        return inside.groupBy("x.doc_id", "x.start", "x.end").agg(F.coalesce(F.sum(F.expr("y.end - y.start")), F.lit(0)).alias("repeated")).select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_chars"), "repeated")


_UNITS = "doc_id long, start int, n_chars int, digest binary"


def line_units(docs: DataFrame, least: int = LINE) -> DataFrame:
    """(doc_id, start, n_chars, digest, repeated): the lines of (doc_id, text) with ``least`` characters or more once normalised.

    Normalised: case folded, white space collapsed. ``repeated``: an earlier line, by document and offset, has
    the same digest. A line that stands in a third of all texts is counted in every task, and joined back as one row.
    """

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, sizes, digests = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for line in text.split("\n"):
                    plain = " ".join(line.casefold().split())
                    if len(plain) >= least:
                        ids.append(doc), starts.append(at), sizes.append(len(line)), digests.append(hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "start", "n_chars", "digest"])

    found = docs.where(F.length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct().mapInArrow(units, _UNITS)
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("m")).where("m > 1").select("digest", "first")
    marked = found.join(first, "digest", "left")
    return marked.select("doc_id", "start", "n_chars", "digest", F.coalesce(F.struct("doc_id", "start") > F.col("first"), F.lit(False)).alias("repeated"))


def kept_lines(units: DataFrame) -> DataFrame:
    """(doc_id, start, n_chars) of the lines that stay if of equal ones the earliest alone is kept."""
    return units.where("NOT repeated").select("doc_id", "start", "n_chars")
