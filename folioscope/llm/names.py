"""Variant spellings of persons and bodies (problem 5).

Method: suffix blocking. The suffixes of a name's distinguishing word (a surname, the place in a body's
name), from ``MIN_SUFFIX`` letters to the whole word, are index keys. A suffix that more than ``COMMON``
spellings share is not dropped but refined with the other fields, step by step: a person's first initial,
then more of the given name; a body's kind and field. What is still common after the last step is compared
all the same. Only spellings that agree in every compared field are linked as a star; the least of them
stands for all in the blocks. Within a block, pairs are compared
by the ratio of their longest common subsequence. A second family of keys, the suffixes of the given name
with the beginning of the surname, finds surnames that are mistyped at their end.

A finer key need not be shared by all true pairs, so names under common keys also meet exactly: words
within the edits of each other share what is left after deletions, the rarer word goes with the more
frequent one, and persons are joined by whole surname and given name (initials: by whole surname and first
letter), bodies by kind and whole place.

Persons: a spelling is read as given names, middle initial and surname, whatever its order, case, accents,
particles and punctuation. Which of two words is the surname is told by where it stands in the other
spellings. Nicknames stand for their full names. Two words that are both frequent are two names, not one
and its misspelling, unless one is ``CORRECTS_BY`` times as frequent: misspellings of a name grow with it. Initials are resolved last: they belong to the one person of the surname whose names
begin with them; if there are several, to none.

Bodies: units, countries, legal forms and acronyms are set aside; what is compared is the kind of body,
its field ("for ...") and its place. Bodies of different kinds or fields in one place stay apart.

Defined results: null and blank names are dropped; a spelling occurs once however often it is repeated;
a spelling that resembles none has no pairs; ties do not occur, since components don't depend on order;
empty tables give no rows; other columns are not carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .canonical import edits, fold
from .components import connected_components
from .history import probes, segments

MIN_SUFFIX = 4
COMMON = 200
RATIO = 0.8
DELETIONS_UP_TO = 16
ESTABLISHED = 4
CORRECTS_BY = 10

# Particles of surnames.
PARTICLES = frozenset("al bin da de del den der di du el ibn la le ten ter van von zu".split())
# Nicknames and the names they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alexandra", "andy": "andrew", "annie": "anne", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bernie": "bernard",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine katherine", "charlie": "charles",
    "chris": "christopher christina", "chuck": "charles", "dan": "daniel", "danny": "daniel", "dave": "david", "dick": "richard", "dima": "dmitry", "don": "donald", "drew": "andrew",
    "ed": "edward", "eddie": "edward", "enzo": "vincenzo lorenzo", "fran": "francisco frances", "frank": "francis francisco", "fred": "frederick", "gabi": "gabriela", "gabe": "gabriel", "geoff": "geoffrey",
    "greg": "gregory", "hannes": "johannes", "hans": "johannes", "harry": "henry harold", "hank": "henry", "henk": "hendrik", "jack": "john", "jake": "jacob", "jim": "james",
    "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "joe": "joseph", "john": "jonathan", "johnny": "john", "jon": "jonathan", "josh": "joshua", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "katya": "yekaterina", "ken": "kenneth", "kenny": "kenneth", "larry": "lawrence", "leo": "leonardo", "liz": "elizabeth",
    "lizzie": "elizabeth", "lupe": "guadalupe", "maggie": "margaret", "matt": "matthew", "meg": "margaret", "mia": "maria", "mike": "michael", "mick": "michael", "mina": "wilhelmina",
    "nanda": "fernanda", "nate": "nathan nathaniel", "ned": "edward", "nick": "nicholas", "nico": "nicholas", "ollie": "oliver", "paco": "francisco", "pancho": "francisco",
    "pat": "patricia patrick", "patty": "patricia", "peggy": "margaret", "pete": "peter", "pepe": "jose", "phil": "philip", "pippa": "philippa", "ray": "raymond", "rich": "richard",
    "rick": "richard", "rob": "robert", "ron": "ronald", "sam": "samuel samantha", "sandy": "alexandra", "sasha": "alexander alexandra", "steve": "stephen steven", "sue": "susan",
    "susie": "susan", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "trish": "patricia", "vince": "vincenzo vincent",
    "vicky": "victoria", "vitya": "viktor", "will": "william", "willa": "wilhelmina", "zach": "zachary", "zack": "zachary", "zak": "zachary",
}
# Words of bodies' names, by the kind they tell; abbreviations and other languages included.
KINDS = {
    "university": "university universities univ u universitat universitaet universite universidad universita universiteit universidade college",
    "technology": "technology technol tech technical polytechnic",
    "institute": "institute inst institut instituto",
    "hospital": "hospital hosp clinic",
    "center": "center centre ctr",
    "labs": "labs lab laboratories laboratory research",
}
# Other words of bodies' names that tell nothing about which body it is.
BODY_FILLERS = frozenset("national natl nat natnl general gen of the de di da der and at inc incorporated ltd llc corp corporation co gmbh".split())
# What a unit's name begins or ends with.
UNIT = re.compile(r"^(?:department|dept|school|faculty|division|div|chair|section|unit|program|programme)\b|\b(?:group|team|unit|department|division)$")


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if a == b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            above = row[j]
            row[j] = diagonal + 1 if x == y else max(above, row[j - 1])
            diagonal = above
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def name_words(name: str) -> tuple[list[str], list[str]]:
    """(words before, words after) a comma that turns the name around; without one all are before."""
    s = fold(name.replace("\\xa0", " ")).replace("’", "'").replace("ʼ", "'")
    head, _, tail = s.partition(",")

    def words(part: str) -> list[str]:
        if "'" in part:
            part = re.sub(r"\bo'\s*(?=\w)", "", part).replace("'", "")
        return [w for w in re.findall(r"[^\W\d_]+", part) if w not in PARTICLES]

    return words(head), words(tail)


def _plain(word: str) -> str:
    """Spelled-out umlauts as accents fold."""
    return re.sub(r"(?<=[aou])e(?=[^aeiou])", "", word)


def _split_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for n in b["name"]:
            head, tail = name_words(n)
            long = [w for w in head if len(w) > 1]
            turned = bool(tail)
            rows.append((n, head, tail, turned, None if turned or len(long) < 2 else long[0], None if turned or len(long) < 2 else long[-1]))
        yield pd.DataFrame(rows, columns=["name", "head", "tail", "turned", "first", "last"])


_SPLIT = "name string, head array<string>, tail array<string>, turned boolean, first string, last string"
_PERSON = "name string, surname string, given string, middle string, initials string, formal string"


def _persons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """surname; given (joined words) or initials; middle initial; full names behind a nickname."""
    for b in batches:
        rows = []
        for n, head, tail, turned, swap in zip(b["name"], b["head"], b["tail"], b["turned"], b["swap"], strict=True):
            head, tail = list(head), list(tail)
            if turned:
                surname, rest = "".join(head), tail
            else:
                at = [i for i, w in enumerate(head) if len(w) > 1]
                if not at:
                    continue
                k = at[0] if swap else at[-1]
                surname, rest = head[k], head[:k] + head[k + 1 :]
            full = [w for w in rest if len(w) > 1]
            single = [w for w in rest if len(w) == 1]
            given = "".join(full)
            # the letters of hyphened given names and the middle initial both follow the first
            initials = "" if given else "".join(single)
            middle = single[0] if given and single else ""
            formal = " ".join(sorted({f for w in full[:1] for f in (NICKNAMES.get(w) or given).split()}))
            rows.append((n, surname, given, middle, initials, formal))
        yield pd.DataFrame(rows, columns=["name", "surname", "given", "middle", "initials", "formal"])


def read_persons(names: DataFrame) -> DataFrame:
    """(name, surname, given, middle, initials, formal, n_given, n_surname) of distinct spellings.

    ``n_given`` and ``n_surname`` count the distinct partners of the two words.
    """
    split = materialise(names.mapInPandas(_split_names, _SPLIT))
    firsts = split.where("first IS NOT NULL").groupBy(F.col("first").alias("w")).agg(F.countDistinct("last").alias("as_first"))
    lasts = split.where("last IS NOT NULL").groupBy(F.col("last").alias("w")).agg(F.countDistinct("first").alias("as_last"))
    places = materialise(firsts.join(lasts, "w", "full").select("w", F.coalesce("as_first", F.lit(0)).alias("as_first"), F.coalesce("as_last", F.lit(0)).alias("as_last")))
    f = places.select(F.col("w").alias("first"), ((F.col("as_last") + 0.5) / (F.col("as_first") + 0.5)).alias("f_odds"))
    la = places.select(F.col("w").alias("last"), ((F.col("as_first") + 0.5) / (F.col("as_last") + 0.5)).alias("l_odds"))
    odds = F.coalesce("f_odds", F.lit(1.0)) * F.coalesce("l_odds", F.lit(1.0))
    turned = split.join(f, "first", "left").join(la, "last", "left").withColumn("swap", odds > 2)
    persons = materialise(turned.select("name", "head", "tail", "turned", "swap").mapInPandas(_persons, _PERSON))
    given = persons.where("given != ''").groupBy("given").agg(F.countDistinct("surname").alias("n_given"))
    surname = persons.where("given != ''").groupBy("surname").agg(F.countDistinct("given").alias("n_surname"))
    return materialise(persons.join(given, "given", "left").join(surname, "surname", "left").na.fill(0, ["n_given", "n_surname"]))


def _body_word(w: str) -> str:
    for kind, words in KINDS.items():
        if w in words.split():
            return kind
    if len(w) > 2 and w not in BODY_FILLERS:
        for kind, words in KINDS.items():
            if any(len(x) > 3 and edits(w, x, 1) <= 1 for x in words.split()):
                return kind
        for x in BODY_FILLERS:
            if len(x) > 5 and edits(w, x, 1) <= 1:
                return x
    return w


def read_body(name: str) -> tuple[str, str, str]:
    """(kind, field, place) of a body's name."""
    s = fold(name).replace("'", "").replace("’", "")
    pieces = [p.strip() for p in re.split(r"[,()/]| - ", s) if p.strip()]
    kept = [p for p in pieces if not UNIT.search(p)] or pieces
    kinds: set[str] = set()
    field: list[str] = []
    beside, elsewhere = [], []
    for p in kept:
        main, _, about = p.partition(" for ")
        words = [_body_word(w) for w in re.findall(r"[^\W_]+", main)]
        topic = re.findall(r"[^\W_]+", about)
        if len(topic) == 1 and _body_word(topic[0]) in KINDS:  # institute for technology
            words.append(_body_word(topic[0]))
        else:
            field += [w for w in topic if w not in BODY_FILLERS]
        here = {w for w in words if w in KINDS}
        unknown = [w for w in words if w not in KINDS and w not in BODY_FILLERS]
        kinds |= here
        (beside if here else elsewhere).append(unknown)
    if "technology" in kinds and "institute" in kinds:
        kind = "institute of technology"
    else:
        kind = next((k for k in ("hospital", "university", "center", "institute", "technology", "labs") if k in kinds), "")
    places = [w for w in beside if w] or [w for w in elsewhere if w]
    return kind, " ".join(field), "".join(places[0]) if places else ""


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(n, *read_body(n)) for n in b["name"]], columns=["name", "kind", "field", "place"])


def _suffixes(word: str) -> list[str]:
    return [word[-n:] for n in range(MIN_SUFFIX, len(word) + 1)] or ([word] if word else [])


_KEYED = "name string, level0 string, level1 string, level2 string, level3 string"


def _person_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = set()
        for n, surname, given, initials, formal in zip(b["name"], b["surname"], b["given"], b["initials"], b["formal"], strict=True):
            names = {given, *formal.split()} if given else {initials}
            for s in {*_suffixes(surname), *_suffixes(_plain(surname))}:
                for g in names:
                    rows.add((n, f"s {s}", f"s {s} {g[:1]}", f"s {s} {g[:2]}", f"s {s} {''.join(sorted(g))}"))
            for g in names if given else ():
                for x in [g[-k:] for k in range(3, len(g) + 1)]:
                    rows.add((n, f"g {x} {surname[:3]}", f"g {x} {surname[:4]}", f"g {x} {surname[:5]}", f"g {x} {''.join(sorted(surname))}"))
        yield pd.DataFrame(sorted(rows), columns=["name", "level0", "level1", "level2", "level3"])


def _body_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = set()
        for n, kind, field, place in zip(b["name"], b["kind"], b["field"], b["place"], strict=True):
            for s in _suffixes(place):
                rows.add((n, s, f"{s} {kind}", f"{s} {kind} {field[:4]}", f"{s} {kind} {field} {place[:3]}"))
            if len(place) > 5:  # mistyped at its end
                rows.add((n, f"^{place[:5]}", f"^{place[:5]} {kind}", f"^{place[:6]} {kind} {field[:4]}", f"^{place[:7]} {kind} {field}"))
        yield pd.DataFrame(sorted(rows), columns=["name", "level0", "level1", "level2", "level3"])


def distinct_forms(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms, star): one row for the names that agree in every field, under the least of them; (a, b) links the others to it.

    ``spellings`` counts the names of a form.
    """
    fields = [c for c in features.columns if c != "name"]
    forms = materialise(features.groupBy(*fields).agg(F.min("name").alias("name"), F.count("*").alias("spellings")))
    star = features.join(forms.where("spellings > 1").withColumnRenamed("name", "b"), fields).select(F.col("name").alias("a"), "b").where("a != b")
    return forms, star


def blocked_pairs(keyed: DataFrame, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """((name_a, name_b), (a, b)), both to compare: keys too common are replaced by finer ones; (a, b) are of keys that stay too common."""
    todo = materialise(keyed)
    blocks = None
    for level in ("level0", "level1", "level2", "level3"):
        sized = todo.groupBy(F.col(level).alias("key")).agg(F.countDistinct("name").alias("n"))
        small = todo.join(sized.where((F.col("n") > 1) & (F.col("n") <= common)).select(F.col("key").alias(level)), level).select(F.concat(F.lit(level), F.col(level)).alias("key"), "name").distinct()
        blocks = small if blocks is None else blocks.unionByName(small)
        todo = todo.join(sized.where(F.col("n") > common).select(F.col("key").alias(level)), level, "left_semi")

    def pairs(t: DataFrame, a: str, b: str) -> DataFrame:
        x, y = t.select("key", F.col("name").alias(a)), t.select("key", F.col("name").alias(b))
        return x.join(y, "key").where(F.col(a) < F.col(b)).select(a, b).distinct()

    rest = todo.select(F.col("level3").alias("key"), "name").distinct()
    return pairs(materialise(blocks), "name_a", "name_b"), pairs(rest, "a", "b")


def both_established(n: int, m: int) -> bool:
    """Whether words with so many partners are two names: fewer than ``ESTABLISHED`` tell nothing, beyond that the ratio does."""
    return min(n, m) >= ESTABLISHED and max(n, m) < CORRECTS_BY * min(n, m)


def same_given(a: str, b: str, formal_a: str, formal_b: str, established: bool) -> bool:
    """Equal, one the nickname of the other, or one the misspelling of the other."""
    if a == b or set(formal_a.split()) & set(formal_b.split()):
        return True
    if established or min(len(a), len(b)) < 3:
        return False
    return edits(a, b, 1) <= 1 and lcs_ratio(a, b) >= 0.74 or (min(len(a), len(b)) > 7 and lcs_ratio(a, b) >= RATIO and edits(a, b, 2) <= 2)


def same_surname(a: str, b: str, established: bool) -> bool:
    """Equal but for spelled-out umlauts, or one the misspelling of the other."""
    return a == b or _plain(a) == _plain(b) or (not established and min(len(a), len(b)) > 3 and lcs_ratio(a, b) >= RATIO and edits(a, b, 2) <= (1 if min(len(a), len(b)) < 8 else 2))


def initials_fit(initials: str, given: str, middle: str) -> bool:
    """The first initial is the given name's; a second one is the middle initial, or of a second given name."""
    if not initials or initials[0] != given[:1]:
        return False
    return len(initials) == 1 or not middle or middle in initials[1:]


def _compare_persons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind: same (one person), initials (a's or b's initials may stand for the other)."""
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            if not same_surname(r.surname_a, r.surname_b, both_established(r.n_surname_a, r.n_surname_b)):
                continue
            if r.given_a and r.given_b:
                if r.middle_a and r.middle_b and r.middle_a != r.middle_b:
                    continue
                twice = r.surname_a != r.surname_b and r.given_a != r.given_b and not set(r.formal_a.split()) & set(r.formal_b.split())
                if twice and lcs_ratio(r.given_a + r.surname_a, r.given_b + r.surname_b) < 0.85:
                    continue
                if same_given(r.given_a, r.given_b, r.formal_a, r.formal_b, both_established(r.n_given_a, r.n_given_b)):
                    rows.append((r.name_a, r.name_b, "same"))
            elif r.initials_a and r.initials_b:
                if r.initials_a[0] == r.initials_b[0] and (min(len(r.initials_a), len(r.initials_b)) == 1 or r.initials_a[1:] == r.initials_b[1:] or len(r.initials_a) != len(r.initials_b) and set(r.initials_a) & set(r.initials_b)):
                    rows.append((r.name_a, r.name_b, "same"))
            elif r.initials_a and r.given_b:
                if any(initials_fit(r.initials_a, g, r.middle_b) for g in r.formal_b.split()):
                    rows.append((r.name_a, r.name_b, "initials"))
            elif r.initials_b and r.given_a and any(initials_fit(r.initials_b, g, r.middle_a) for g in r.formal_a.split()):
                rows.append((r.name_b, r.name_a, "initials"))
        yield pd.DataFrame(rows, columns=["a", "b", "kind"])


def _compare_bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            if r.kind_a != r.kind_b:
                continue
            if r.field_a != r.field_b and lcs_ratio(r.field_a, r.field_b) < 0.88:
                continue
            if same_place(r.place_a, r.place_b):
                rows.append((r.name_a, r.name_b))
        yield pd.DataFrame(rows, columns=["a", "b"])


def same_place(a: str, b: str) -> bool:
    """Equal, or one the misspelling of the other."""
    return a == b or (min(len(a), len(b)) > 4 and lcs_ratio(a, b) >= RATIO and edits(a, b, 2) <= 2)


def _meeting_keys(word: str, part: str, stored: bool) -> set[str]:
    """Keys of which two words within the edits share one, a stored one of one and a probed one of the other."""
    keys = {f"p {_plain(word)}"} if part == "surname" else set()
    if len(word) <= DELETIONS_UP_TO:
        cut = {word}
        for _ in range(2 if len(word) > (4 if part == "place" else 7) else 1):
            cut |= {w[:i] + w[i + 1 :] for w in cut for i in range(len(w))}
        keys |= {f"d {w}" for w in cut}
    if len(word) > DELETIONS_UP_TO - 2:  # longer words have too many deletions, but telling segments
        keys |= {f"{len(word)} {i} {x}" for i, x in segments(word, 2)} if stored else {f"{n} {i} {x}" for n, i, x in probes(word)}
    return keys


def near_words(words: DataFrame, part: str) -> DataFrame:
    """(word, to): each of the distinct words (word, n) with itself and with the more frequent words it may be a misspelling of."""
    fits = {"surname": lambda a, b, e: same_surname(a, b, e), "given": lambda a, b, e: same_given(a, b, a, b, e), "place": lambda a, b, e: same_place(a, b)}[part]

    def keyed(stored: bool):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(k, w, n) for w, n in zip(b["word"], b["n"], strict=True) for k in _meeting_keys(w, part, stored)], columns=["key", "word", "n"])

        return words.mapInPandas(rows, "key string, word string, n long")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, t) for w, n, t, m in zip(b["word"], b["n"], b["to"], b["m"], strict=True) if fits(w, t, part != "place" and both_established(n, m))]
            yield pd.DataFrame(rows, columns=["word", "to"])

    met = keyed(False).join(keyed(True).select("key", F.col("word").alias("to"), F.col("n").alias("m")), "key")
    met = met.where(F.struct("n", "word") < F.struct(F.col("m").alias("n"), F.col("to").alias("word"))).select("word", "n", "to", "m").distinct()
    return materialise(met.mapInPandas(verified, "word string, to string").unionByName(words.select("word", F.col("word").alias("to"))))


def _meeting(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    """(name_a, name_b) of two tables of names that meet."""
    met = x.withColumnRenamed("name", "x").join(y.withColumnRenamed("name", "y"), on).where("x != y")
    return met.select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b")).distinct()


def names_under_common_keys(keyed: DataFrame, common: int = COMMON) -> DataFrame:
    """The names that have a key of the first level which is refined."""
    hot = keyed.groupBy("level0").agg(F.countDistinct("name").alias("n")).where(F.col("n") > common).select("level0")
    return keyed.join(hot, "level0", "left_semi").select("name").distinct()


def person_pairs(forms: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair that _compare_persons may accept, however common its parts are."""
    forms = materialise(forms)
    surnames = near_words(forms.groupBy(F.col("surname").alias("word")).agg(F.max("n_surname").alias("n")), "surname").select(F.col("word").alias("surname"), F.col("to").alias("s"))
    givens = near_words(forms.where("given != ''").groupBy(F.col("given").alias("word")).agg(F.max("n_given").alias("n")), "given").select(F.col("word").alias("given"), F.col("to").alias("g"))
    full, short = forms.where("given != ''"), forms.where("given = ''")
    formal = full.select("name", "surname", F.explode(F.split("formal", " ")).alias("g"))
    called = full.join(givens, "given").select("name", "surname", "g").unionByName(formal).distinct().join(surnames, "surname").select("name", "s", "g")
    letters = formal.select("name", "surname", F.substring("g", 1, 1).alias("letter")).distinct().join(surnames, "surname").select("name", "s", "letter")
    initials = short.select("name", "surname", F.substring("initials", 1, 1).alias("letter")).join(surnames, "surname").select("name", "s", "letter")
    return _meeting(called, called, ["s", "g"]).unionByName(_meeting(initials, letters, ["s", "letter"])).unionByName(_meeting(initials, initials, ["s", "letter"])).distinct()


def body_pairs(forms: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair that _compare_bodies may accept, however common its parts are."""
    forms = materialise(forms)
    places = near_words(forms.select(F.col("place").alias("word"), F.lit(0).cast("long").alias("n")).distinct(), "place").select(F.col("word").alias("place"), F.col("to").alias("p"))
    placed = forms.join(places, "place").select("name", "kind", "p")
    return _meeting(placed, placed, ["kind", "p"])


def _with_features(pairs: DataFrame, features: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(features.select(*(F.col(c).alias(f"{c}_{side}") for c in features.columns)), f"name_{side}")
    return pairs


def person_entities(names: DataFrame) -> DataFrame:
    """(name, entity) of each spelling of (name) that has another one."""
    persons = read_persons(names)
    forms, star = distinct_forms(persons.where("given != '' OR initials != ''"))
    keyed = materialise(forms.mapInPandas(_person_keys, _KEYED))
    pairs, _ = blocked_pairs(keyed)
    exact = person_pairs(forms.join(names_under_common_keys(keyed), "name", "left_semi"))
    compared = materialise(_with_features(pairs.unionByName(exact).distinct(), forms).mapInPandas(_compare_persons, "a string, b string, kind string"))
    clusters = connected_components(compared.where("kind = 'same'").select("a", "b").unionByName(star))
    whole = F.coalesce("component", "name")

    def cluster_of(side: str, name: str) -> DataFrame:
        return persons.select("name").join(clusters.withColumnRenamed("node", "name"), "name", "left").select(F.col("name").alias(side), whole.alias(name))

    fits = compared.where("kind = 'initials'").join(cluster_of("a", "ca"), "a").join(cluster_of("b", "cb"), "b")
    # written initials of one surname are one person: they go where exactly one person fits them all
    fits = fits.select("ca", "cb", "a").distinct().join(forms.select(F.col("name").alias("a"), "spellings"), "a").groupBy("ca", "cb").agg(F.sum("spellings").alias("n"))
    best = fits.groupBy("ca").agg(F.max("n").alias("most"))
    unique = fits.join(best, "ca").where("n = most").groupBy("ca").agg(F.min("cb").alias("x"), F.max("cb").alias("y")).where("x = y")
    edges = clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(unique.select(F.col("ca").alias("a"), F.col("x").alias("b")))
    return connected_components(edges).select(F.col("node").alias("name"), F.col("component").alias("entity"))


def body_entities(names: DataFrame) -> DataFrame:
    """(name, entity) of each spelling of (name) that has another one."""
    bodies = materialise(names.mapInPandas(_bodies, "name string, kind string, field string, place string"))
    forms, star = distinct_forms(bodies.where("place != ''"))
    keyed = materialise(forms.mapInPandas(_body_keys, _KEYED))
    pairs, _ = blocked_pairs(keyed)
    exact = body_pairs(forms.join(names_under_common_keys(keyed), "name", "left_semi"))
    linked = _with_features(pairs.unionByName(exact).distinct(), forms).mapInPandas(_compare_bodies, "a string, b string")
    return connected_components(linked.unionByName(star)).select(F.col("node").alias("name"), F.col("component").alias("entity"))


def entity_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b): the spellings of each entity in pairs, as the problem's result wants them."""
    a, b = entities.select("entity", F.col("name").alias("name_a")), entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def distinct_names(names: DataFrame) -> DataFrame:
    """The distinct spellings of (name) that are not blank."""
    return names.where(F.col("name").rlike(r"[\p{L}]")).select("name").distinct()
