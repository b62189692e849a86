"""Split packed cells: minimum description length picks the dialect of each cell.

A *dialect* says how the values of one cell are delimited, quoted and wrapped. Every cell gets
the candidate parses its characters allow; a parse is priced by the code lengths of its values
and the cheapest one is taken. The code lengths come from the whole column:

* a value has a dictionary code, ``-log2`` of its share among all values of all candidate parses
  of the distinct cells (each candidate of a cell counts one n-th), plus its share of the bits that
  spell it once in the dictionary, and
* a spelling code: the code of its shape (letters, digits and punctuation classes) plus a fixed
  number of bits a character; the cheaper one is used. Without it two values that occur once
  would cost more than the unsplit cell.

Distinct cells are counted, not occurrences: a packed cell that stands in a third of all rows
is one piece of evidence, while its values recur in other cells.
Both tables are aggregated over all cells; cells with one candidate need no pricing. Each distinct cell is
parsed once: its candidates are kept, priced by joins, and the chosen values are joined back to the rows,
so no row is parsed again. Nothing is collected.

Defined results: a missing cell (null, blank, NA token) gives no rows; empty pieces are dropped and
not counted; repeated values are kept; a cell without a delimiter is one value; ties between
parses go to the dialect enumerated first; columns of the input other than the id and the cell are
not carried along, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..session import materialise

CHAR_BITS = 4.5


@dataclass(frozen=True)
class FieldRules:
    """What may delimit values in a field.

    ``strong``: separators that rule out weaker ones in the same cell when ``exclusive``.
    ``weak``: separators that count only where no strong one occurs (exclusive) or beside others.
    ``conjunctions``: words or signs that separate only before the last value.
    ``blank``: runs of white space may separate. ``numbering``: ``(1) a (2) b`` may separate.
    """

    strong: tuple[str, ...] = (";", "；", "|", "\n")
    weak: tuple[str, ...] = (",",)
    exclusive: bool = True
    conjunctions: tuple[str, ...] = ()
    blank: bool = False
    numbering: bool = False


RULES = {
    "authors": FieldRules(conjunctions=("and", "&")),
    "targeted_capability": FieldRules(),
    "categories": FieldRules(exclusive=False, blank=True),
    "intended_primary_use": FieldRules(strong=(";", "；", "|", "\n", "/", "+", "&"), exclusive=False, conjunctions=("and",), numbering=True),
}

_BULLET = re.compile(r"^\s*[-*•‣▪–]\s+")
_NUMBER = re.compile(r"(?:^|\s)\(\d+\)\s+")
_LIST = re.compile(r"^\s*\[.*\]\s*$", re.S)
_ELEMENT = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\")\s*(?:,|$)", re.S)
_QUOTES = {'"': '"', "“": "”"}
_PROTECTS = re.compile(r'["“(]')


def _fields(cell: str, seps: frozenset[str], quoted: bool, blank: bool) -> list[str]:
    """Split outside quotes and round brackets. An opener without its end protects nothing."""
    if not _PROTECTS.search(cell):
        if blank:
            return re.split(r"[\s" + re.escape("".join(sorted(seps))) + "]", cell)
        if len(seps) == 1:
            return cell.split(*seps)
        return re.split("[" + re.escape("".join(sorted(seps))) + "]", cell) if seps else [cell]
    out, start, i, n = [], 0, 0, len(cell)
    while i < n:
        ch = cell[i]
        if quoted and ch in _QUOTES and not cell[start:i].strip():
            end = cell.find(_QUOTES[ch], i + 1)
            while end >= 0 and cell[end + 1 : end + 2] == ch == '"':  # a doubled quote
                end = cell.find(ch, end + 2)
            if end > 0:
                i = end + 1
                continue
        elif ch == "(":
            end = cell.find(")", i + 1)
            if end > 0:
                i = end + 1
                continue
        if ch in seps or (blank and ch.isspace()):
            out.append(cell[start:i])
            start = i + 1
        i += 1
    out.append(cell[start:])
    return out


def _unquote(x: str) -> str:
    x = x.strip()
    while len(x) > 1 and x[0] in _QUOTES and x[-1] == _QUOTES[x[0]]:
        inner = x[1:-1]
        if x[0] == '"':
            if '"' in inner.replace('""', ""):
                break
            inner = inner.replace('""', '"')
        x = inner.strip()
    return x


def _conjoined(parts: list[str], words: tuple[str, ...]) -> list[str]:
    """Split the last piece at its last conjunction."""
    if not words or not parts:
        return parts
    last = parts[-1]
    for w in words:
        lead = re.match(rf"\s*{re.escape(w)}\s+(?=\S)", last)
        if lead and len(parts) > 1:
            return [*parts[:-1], last[lead.end() :]]
        at = list(re.finditer(rf"(?<=\S)\s+{re.escape(w)}\s+(?=\S)", last))
        if at:
            return [*parts[:-1], last[: at[-1].start()], last[at[-1].end() :]]
    return parts


def _clean(parts: list[str], quoted: bool) -> tuple[str, ...]:
    return tuple(y for x in parts if (y := _unquote(x) if quoted else x.strip()))


def parses(cell: str, rules: FieldRules) -> list[tuple[str, tuple[str, ...]]]:
    """The candidate parses of a cell as (dialect, values), distinct by their values.

    A list in square brackets, bullets and numbering are recognised by their marks, which no
    value holds; for them the wrapped reading comes first. A dialect that leaves every value as
    another one does is not repeated.
    """
    cell = cell.strip()
    found: dict[tuple[str, ...], str] = {}

    def offer(name: str, values: tuple[str, ...]) -> None:
        if values:
            found.setdefault(values, name)

    if _LIST.match(cell):
        inner, at, items = cell[1:-1].strip(), 0, []
        while at < len(inner) and (m := _ELEMENT.match(inner, at)):
            items.append(re.sub(r"\\(['\"])", r"\1", m[1] if m[1] is not None else m[2]))
            at = m.end()
        if items and at >= len(inner):
            return [("list", tuple(y for x in items if (y := x.strip())))]
        cell = inner
    lines = [x for x in cell.split("\n") if x.strip()]
    if lines and all(_BULLET.match(x) for x in lines):
        offer("bullets", _clean([_BULLET.sub("", x) for x in lines], True))
        return [(name, values) for values, name in found.items()]
    if rules.numbering and len(_NUMBER.findall(cell)) > 1 and _NUMBER.match(cell):
        offer("numbered", _clean(_NUMBER.split(cell), True))
        return [(name, values) for values, name in found.items()]

    quoted = any(q in cell for q in _QUOTES)
    modes = (True,) if not quoted or cell.count('"') % 2 == 0 else (False, True)
    for q in modes:
        present = {s for s in (*rules.strong, *rules.weak) if s in cell and len(_fields(cell, frozenset(s), q, False)) > 1}
        strong, weak = present & set(rules.strong), present & set(rules.weak)
        if rules.exclusive:
            sets = [frozenset(s) for s in rules.strong if s in strong] or [frozenset(weak)]
        else:
            sets = [frozenset(present), *(frozenset(s) for s in sorted(present))] if len(present) > 1 else [frozenset(present)]
        for seps in sets:
            parts = _fields(cell, seps, q, False)
            name = "sep " + "".join(sorted(seps))
            offer(name + " and", _clean(_conjoined([x for x in parts if x.strip()], rules.conjunctions), q))
            if rules.conjunctions:
                offer(name, _clean(parts, q))
            if rules.blank:
                offer(name + " blank", _clean(_fields(cell, seps, q, True), q))
        if not rules.exclusive:
            offer("whole", _clean([cell], q))
    return [(name, values) for values, name in found.items()]


def shape(value: str) -> str:
    """Words of a value by class: a for letters (Aa with a capital), 0 for digits, other signs as they are."""
    s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0][0].isupper() else "a", value)
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", s))


def packed_cells(df: DataFrame, field: str, id_col: str, cell_col: str) -> DataFrame:
    """(field_name, rec_id, cell) of the cells that are not missing."""
    c = F.col(f"`{cell_col}`")
    return df.select(F.lit(field).alias("field_name"), F.col(f"`{id_col}`").cast("long").alias("rec_id"), c.alias("cell")).where(~is_missing(c))


_CANDIDATES = "field_name string, cell string, choice int, options int, dialect string, items array<string>, shapes array<string>"


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for field, cell in zip(b["field_name"], b["cell"], strict=True):
            found = parses(cell, RULES[field])
            rows += [(field, cell, k, len(found), name, list(values), [shape(v) for v in values]) for k, (name, values) in enumerate(found)]
        yield pd.DataFrame(rows, columns=["field_name", "cell", "choice", "options", "dialect", "items", "shapes"])


def candidate_parses(cells: DataFrame) -> DataFrame:
    """(field_name, cell, choice, options, dialect, items, shapes): every candidate parse of each distinct cell, kept in the shared folder."""
    return materialise(cells.select("field_name", "cell").distinct().mapInPandas(_candidates, _CANDIDATES))


def priced_parses(candidates: DataFrame) -> DataFrame:
    """(field_name, cell, choice, dialect, bits): the cheapest parse of each distinct ambiguous cell."""

    def coded(column: str, name: str) -> DataFrame:
        w = candidates.select("field_name", F.explode(column).alias(name), (1 / F.col("options")).alias("w")).groupBy("field_name", name).agg(F.sum("w").alias("w"))
        totals = w.groupBy("field_name").agg(F.sum("w").alias("total"))
        return w.join(F.broadcast(totals), "field_name").withColumn("bits", F.log2("total") - F.log2("w"))  # totals: a row a field

    values = coded("items", "item").select("field_name", "item", (F.col("bits") + CHAR_BITS * F.length("item") / F.col("w")).alias("value_bits"))
    shapes = coded("shapes", "shape").select("field_name", "shape", F.col("bits").alias("shape_bits"))
    open_ = candidates.where("options > 1").select("field_name", "cell", "choice", "dialect", F.explode(F.arrays_zip("items", "shapes")).alias("x"))
    priced = (
        open_.select("field_name", "cell", "choice", "dialect", F.col("x.items").alias("item"), F.col("x.shapes").alias("shape"))
        .join(values, ["field_name", "item"])
        .join(shapes, ["field_name", "shape"])
        .withColumn("bits", F.least("value_bits", F.col("shape_bits") + CHAR_BITS * F.length("item")))
    )
    parsed = priced.groupBy("field_name", "cell", "choice", "dialect").agg(F.sum("bits").alias("bits"))
    return parsed.groupBy("field_name", "cell").agg(F.min_by(F.struct("choice", "dialect", "bits"), F.struct("bits", "choice")).alias("best")).select("field_name", "cell", "best.*")


def cheapest_dialects(cells: DataFrame) -> DataFrame:
    """:func:`priced_parses` of the cells' candidates."""
    return priced_parses(candidate_parses(cells))


def split_cells(cells: DataFrame) -> DataFrame:
    """The values of every cell that has any: (field_name, rec_id, items), one row per cell.

    ``cells`` is a union of :func:`packed_cells`.
    """
    candidates = candidate_parses(cells)
    best = priced_parses(candidates).select("field_name", "cell", "choice")
    chosen = candidates.where("options > 1").join(best, ["field_name", "cell", "choice"]).select("field_name", "cell", "items")
    values = candidates.where("options = 1").select("field_name", "cell", "items").unionByName(chosen)
    return cells.join(values, ["field_name", "cell"]).select("field_name", "rec_id", "items")


def split_packed(cells: DataFrame) -> DataFrame:
    """Every value of every cell: (field_name, rec_id, pos, item, n_items).

    ``n_items`` is the number of values of the cell, so that cells with one value can be told apart.
    """
    split = split_cells(cells)
    return split.select("field_name", "rec_id", F.posexplode("items").alias("at", "item"), F.size("items").alias("n_items")).select("field_name", "rec_id", (F.col("at") + 1).alias("pos"), "item", "n_items")
