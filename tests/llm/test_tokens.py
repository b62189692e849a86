"""Token ids against the public library's own encoder; packing against its invariants."""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import containers, tokens

if not os.path.exists(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"):
    pytest.skip("no vocabulary files", allow_module_level=True)

TEXTS = [None, "", " ", "\n\n", "Hello world", "it's we'll  two   blanks ", "naïve 東京 ２０２４ ½ Ⅷ", "<|endoftext|>", "-" * 700, "ab" * 400 + " x" * 400, "é" * 300, "word " * 20000, "퟿\U0001f600"]


@pytest.fixture(scope="module")
def bpe():
    return tokens.ByteBpe(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")


@pytest.fixture(scope="module")
def public():
    tiktoken = pytest.importorskip("tiktoken")
    with open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encode(bpe, texts):
    sizes, ids = bpe.encode(texts)
    out, at = [], 0
    for n in sizes:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_ids_are_the_public_encoders(bpe, public):
    assert encode(bpe, TEXTS) == [public(t or "") for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_any_text(bpe, public, texts):
    assert encode(bpe, texts) == [public(t) for t in texts]
    assert bpe.encode(texts, ids=False)[0].tolist() == [len(public(t)) for t in texts]


def test_long_words_merge_as_short_ones(bpe):
    word = ("ing" * 60 + "tion" * 40).encode()
    [ids] = bpe.merge([word[:250]])
    assert bpe._merge_long(word[:250]) == ids.tolist()


def test_table_overflow_changes_nothing(bpe, monkeypatch):
    want = encode(bpe, ["some words here", "other words there"])
    monkeypatch.setattr(tokens, "TABLE_WORDS", 1)
    assert [encode(bpe, [t])[0] for t in ("some words here", "other words there")] == want


def test_rows_of_a_table(spark, bpe):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")  # clashing names
    got = tokens.token_ids(df).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got) == sorted((r[0], len(x)) for r, x in zip(rows, encode(bpe, [r[1] for r in rows]), strict=True))
    assert {r.doc_id: r.ids for r in got}[0] == [] == {r.doc_id: r.ids for r in got}[1]
    assert tokens.token_counts(df).count() == len(rows)
    assert tokens.token_ids(df.limit(0)).count() == 0


def check_packing(items: dict[tuple, int], rows, capacity: int) -> int:
    """Every token of every item once, nothing overlaps, nothing is split that fits; number of containers."""
    pieces = defaultdict(list)
    room = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.n_tokens))
        room[r.container_id].append((r.place, r.n_tokens))
    for (doc,), n in items.items():
        got = sorted(pieces.pop(doc, []))
        assert sum(x for _, x in got) == n and all(a == sum(x for _, x in got[:k]) for k, (a, _) in enumerate(got))
        assert len(got) == max(0, -(-n // capacity))
    assert not pieces
    for parts in room.values():
        end = 0
        for place, n in sorted(parts):
            assert place == end
            end += n
        assert end <= capacity
    return len(room)


def test_packing(spark, rng):
    capacity = 64
    sizes = {(i,): rng.choice([0, 1, 2, 5, 13, 31, 33, 63, 64, 65, 200]) for i in range(3000)} | {(-1,): 64 * 50 + 7}
    sizes |= {(i,): 20 for i in range(3000, 4500)}  # one length has a third of all
    df = spark.createDataFrame([(k[0], n) for k, n in sizes.items()], "doc_id long, n_tokens long")
    used = check_packing(sizes, containers.pack_items(df, capacity, group_rows=100).collect(), capacity)
    total = sum(sizes.values())
    assert used <= 1.02 * -(-total // capacity)
    assert containers.pack_items(df.limit(0), capacity).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_histogram_patterns(histogram):
    placed = Counter()
    for count, pattern in containers.pack_histogram(histogram, 40):
        assert count > 0 and sum(k * n for k, n in pattern.items()) <= 40
        for k, n in pattern.items():
            placed[k] += count * n
    assert placed == Counter(histogram)
