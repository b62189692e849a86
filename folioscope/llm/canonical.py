"""Mapping free-entered values to a canonical list (problem 1).

Method: prefix-filter set-similarity join. A value and an entry (a canonical value or one of its
aliases) are compared as sets of padded character pairs and numbered letters of a folded key. Tokens
are ordered by their rarity over all keys of the field, only the rare prefixes are joined, the length
and the positional filter cut candidates, and the Jaccard similarity of the rest is computed exactly.
Of the entries at ``JACCARD`` or above, the one with the fewest edits is kept, and only if the edits
are few for its length (``edit_limit``): similarity alone cannot tell a mistyped entry from another
word that shares its pairs. One edit is an insertion, deletion, substitution or transposition. The
similarity bound is low enough to lose no pair within the edit limit.

Keys: compatibility forms, look-alike letters, case, accents, punctuation and white space are folded.
A value has further keys with words turned around, for what stands outside and inside brackets, and without
remarks. Remarks ("mostly", "role:", "the") are learnt from the values: words before or after
that, once removed, leave entries' own keys behind, and of at least ``REMARK_SHARE`` of the field's entries, two or more.
A word that goes with one entry only ("new version, updated release") is no remark. A word that ends at least half of a field's entries ("only") is optional
in that field. A value cut short with a full stop is matched as a prefix of exactly one entry.

Defined results: missing cells (null, blank, NA tokens) give no rows; a value that equals a canonical
value exactly is left out by ``map_values(..., exact=False)``; a value without an entry has canon_id 0;
ties go to the higher similarity, then to the least canon_id; repeated rows are mapped each; an empty
reference list leaves everything unmatched; other columns are not carried along.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_missing
from ..session import materialise

JACCARD = 0.4
MIN_PREFIX = 4
REMARK_WORDS = 3
REMARK_SHARE = 0.1

# Cyrillic letters that look like Latin ones.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h"}
def fold(s: str) -> str:
    """Compatibility forms, case, accents and look-alikes folded."""
    if s.isascii():
        return s.lower()
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).casefold())
    return "".join(LOOK_ALIKES.get(c, c) for c in s if not unicodedata.combining(c))


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", s)


def _turned(words: list[str]) -> set[str]:
    """The words as one key, in their order and turned around."""
    return {"".join(x) for x in (words, words[1:] + words[:1], words[-1:] + words[:-1], words[::-1])} - {""}


def value_keys(value: str) -> set[str]:
    """The keys a typed value may be matched by, letters and digits only."""
    s = " ".join(fold(value).split())
    forms = {s}
    if m := re.match(r"^(.+?)\s*\((.+)\)$", s):
        forms |= {m[1], m[2]}
    return {k for f in forms for k in _turned(_words(f))}


def affixes(value: str) -> list[tuple[str, str, list[str]]]:
    """(words before, words after, words left) for up to ``REMARK_WORDS`` words on either side."""
    w = _words(fold(value))
    return [(" ".join(w[:i]), " ".join(w[len(w) - j :]), w[i : len(w) - j]) for i in range(REMARK_WORDS + 1) for j in range(REMARK_WORDS + 1) if i + j and i + j < len(w)]


def key_tokens(key: str) -> list[str]:
    """Padded character pairs and letters, the n-th occurrence of each told apart."""
    padded = f"^{key}$"
    seen: Counter = Counter()
    out = []
    for t in [*(padded[i : i + 2] for i in range(len(padded) - 1)), *key]:
        seen[t] += 1
        out.append(f"{t}{seen[t]}")
    return out


def edit_limit(n: int) -> int:
    """A fifth of the entry's length, two at most; one for words of four letters, none for shorter ones."""
    return 0 if n < 4 else min(2, max(1, n // 5))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most + 1`` if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin or end with costs nothing
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    end = 0
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(field_name, l, r, jaccard) of the keys of (field_name, key, tokens) at ``threshold`` or above.

    Both sides hold each key of a field once.
    """
    both = left.select("field_name", "key", "tokens").unionByName(right.select("field_name", "key", "tokens")).distinct()
    exploded = both.select("field_name", "key", F.explode("tokens").alias("token"))
    rarity = exploded.groupBy("field_name", "token").agg(F.count("*").alias("n"))
    ordered = exploded.join(rarity, ["field_name", "token"]).groupBy("field_name", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x.token).alias("tokens"))
    ordered = ordered.withColumn("size", F.size("tokens"))

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        mine = side.select("field_name", "key").join(ordered, ["field_name", "key"])
        length = (F.col("size") - F.ceil(F.col("size") * F.lit(threshold)) + 1).cast("int")
        return mine.select("field_name", F.col("key").alias(name), F.col("tokens").alias(f"{name}_tokens"), F.col("size").alias(f"{name}_size"), F.posexplode(F.slice("tokens", F.lit(1), length)).alias(f"{name}_pos", "token"))

    x, y = prefixes(left, "l"), prefixes(right, "r")
    overlap = F.ceil((F.col("l_size") + F.col("r_size")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    most = F.least(F.col("l_size") - F.col("l_pos"), F.col("r_size") - F.col("r_pos"))  # if this is the first common token
    close = (F.col("r_size") >= F.col("l_size") * threshold) & (F.col("l_size") >= F.col("r_size") * threshold) & (most >= overlap)
    met = x.join(y, ["field_name", "token"]).where(close)
    common = F.size(F.array_intersect("l_tokens", "r_tokens"))
    jaccard = common / (F.col("l_size") + F.col("r_size") - common)
    # a pair meets once for each shared prefix token: only the first of them in the left order is verified
    first = F.element_at(F.array_intersect("l_tokens", "r_tokens"), 1) == F.col("token")
    return met.where(first).select("field_name", "l", "r", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


_KEYS = "field_name string, value string, key string, cut boolean, tokens array<string>"
_ENTRIES = "field_name string, canon_id int, key string, tokens array<string>"


def _value_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, v, k, v.rstrip().endswith("."), key_tokens(k)) for f, v in zip(b["field_name"], b["value"], strict=True) for k in value_keys(v)]
        yield pd.DataFrame(rows, columns=["field_name", "value", "key", "cut", "tokens"])


_AFFIXED = "field_name string, value string, before string, after string, key string, words array<string>"


def _affixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, v, x, y, "".join(w), w) for f, v in zip(b["field_name"], b["value"], strict=True) for x, y, w in affixes(v)]
        yield pd.DataFrame(rows, columns=["field_name", "value", "before", "after", "key", "words"])


def _bare_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, v, k, v.rstrip().endswith("."), key_tokens(k)) for f, v, w in zip(b["field_name"], b["value"], b["words"], strict=True) for k in _turned(list(w))]
        yield pd.DataFrame(rows, columns=["field_name", "value", "key", "cut", "tokens"])


def remarkless_keys(values: DataFrame, entries: DataFrame) -> DataFrame:
    """Keys of the distinct values of (field_name, value) without the remarks around them.

    What stands before, after or around is a remark by the number of different entries whose exact keys it stands beside.
    """
    affixed = values.mapInPandas(_affixed, _AFFIXED)
    around = ["field_name", "before", "after"]
    beside = affixed.join(entries.select("field_name", "key", "canon_id").distinct(), ["field_name", "key"]).groupBy(*around).agg(F.countDistinct("canon_id").alias("n"))
    sizes = entries.groupBy("field_name").agg(F.countDistinct("canon_id").alias("of"))
    remarks = materialise(beside.join(sizes, "field_name").where(F.col("n") >= F.greatest(F.lit(2.0), REMARK_SHARE * F.col("of"))).select(*around))
    first, last = remarks.where("after = ''").drop("after"), remarks.where("before = ''").drop("before")
    both = affixed.where("before != '' AND after != ''").join(first, around[:2]).join(last, ["field_name", "after"])
    bare = affixed.join(remarks, around).unionByName(both).select("field_name", "value", "words").distinct()
    return bare.mapInPandas(_bare_keys, _KEYS)


def _entry_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for f, c, names, tail in zip(b["field_name"], b["canon_id"], b["names"], b["tail"], strict=True):
            keys = set()
            for n in names:
                w = _words(fold(n or ""))
                keys.add("".join(w))
                if tail and len(w) > 1 and w[-1] == tail:
                    keys.add("".join(w[:-1]))
            rows += [(f, c, k, key_tokens(k)) for k in keys - {""}]
        yield pd.DataFrame(rows, columns=["field_name", "canon_id", "key", "tokens"])


def canonical_entries(canonical: DataFrame) -> DataFrame:
    """(field_name, canon_id, key, tokens) of the names of each entry."""
    names = F.concat(F.array("canon_value"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = canonical.select("field_name", F.col("canon_id").cast("int").alias("canon_id"), names.alias("names"), F.lower(F.element_at(F.split("canon_value", r"[\s-]+"), -1)).alias("last"))
    tails = rows.groupBy("field_name", "last").agg(F.count("*").alias("n")).join(rows.groupBy("field_name").agg(F.count("*").alias("of")), "field_name").where("n * 2 >= of AND n > 1").select("field_name", F.col("last").alias("tail"))
    return rows.join(tails, "field_name", "left").mapInPandas(_entry_keys, _ENTRIES)


def map_values(cells: DataFrame, canonical: DataFrame, exact: bool = True) -> DataFrame:
    """(rec_id, field_name, value, canon_id, edits, jaccard) for every cell of (rec_id, field_name, value)."""
    cells = cells.where(~is_missing(F.col("value")))
    if not exact:
        known = canonical.select("field_name", F.col("canon_value").alias("value")).distinct()
        cells = cells.join(known, ["field_name", "value"], "left_anti")
    values, entries = materialise(cells.select("field_name", "value").distinct()), materialise(canonical_entries(canonical))
    keys = materialise(values.mapInPandas(_value_keys, _KEYS).unionByName(remarkless_keys(values, entries)))
    named = entries.groupBy("field_name", "key").agg(F.min("canon_id").alias("canon_id"))
    tokens = "any_value(tokens) AS tokens"
    pairs = set_similarity_join(keys.groupBy("field_name", "key").agg(F.expr(tokens)), entries.groupBy("field_name", "key").agg(F.expr(tokens)), JACCARD)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [edit_limit(len(entry)) for entry in b["r"]]
            b["edits"] = [edits(x, y, m) for x, y, m in zip(b["l"], b["r"], most, strict=True)]
            yield b[b["edits"] <= pd.Series(most, index=b.index, dtype="int64")]

    scored = pairs.mapInPandas(verify, "field_name string, l string, r string, jaccard double, edits int")
    similar = keys.select("field_name", "value", "key").join(scored, [keys.field_name == scored.field_name, keys.key == scored.l]).select(keys.field_name, "value", F.col("r").alias("key"), "edits", "jaccard").join(named, ["field_name", "key"])
    similar = similar.select("field_name", "value", "canon_id", "edits", "jaccard")

    starts = named.select("field_name", "canon_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.struct(n.alias("n"), F.substring("key", F.lit(1), n).alias("key")))).alias("p")).where(F.col("p.n") >= MIN_PREFIX)
    unique = starts.groupBy("field_name", F.col("p.key").alias("key")).agg(F.min("canon_id").alias("canon_id"), F.max("canon_id").alias("other")).where("canon_id = other")
    cut = keys.where("cut").join(unique, ["field_name", "key"]).select("field_name", "value", "canon_id", F.lit(0).alias("edits"), F.lit(0.0).alias("jaccard"))
    best = similar.unionByName(cut).groupBy("field_name", "value").agg(F.min(F.struct("edits", (-F.col("jaccard")).alias("far"), "canon_id")).alias("best"))
    found = best.select("field_name", "value", "best.canon_id", "best.edits", (-F.col("best.far")).alias("jaccard"))
    return cells.join(found, ["field_name", "value"], "left").select("rec_id", "field_name", "value", F.coalesce("canon_id", F.lit(0)).alias("canon_id"), "edits", "jaccard")


def typed_cells(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(rec_id, field_name, value): the named columns one below the other."""
    return reduce(DataFrame.unionByName, [df.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields])
