"""The word kernel against plain splitting."""

import re
import string

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from provenspark.llm import words as W

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def shingles(text, n=5):
    w = plain(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


TEXT = st.text(alphabet=st.sampled_from("aAbB é\t\n zß"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.sampled_from([7, 50, 1 << 20]))
def test_hashes_follow_words(texts, block):
    before, W.BLOCK = W.BLOCK, block
    try:
        column = pa.array(texts, pa.string())
        hashes, first = W.word_hashes(column)
        everything = [w for t in texts for w in plain(t)]
        assert len(hashes) == len(everything)
        assert len(set(hashes.tolist())) == len(set(everything))
        assert [b - a for a, b in zip(first, first[1:], strict=False)] == [len(plain(t)) for t in texts]
        assert [len(s) for s in W.shingle_sets(column)] == [len(shingles(t)) for t in texts]
    finally:
        W.BLOCK = before


def test_one_long_text_is_hashed_in_blocks():
    text = " ".join(f"w{i % 997}" for i in range(400_000))
    short = W.word_hashes(pa.array([text[:1000]]))[0]
    hashes, first = W.word_hashes(pa.array(["x", text, ""]))
    assert len(hashes) == 400_001 and first.tolist() == [0, 1, 400_001, 400_001]
    assert hashes[1 : 1 + len(short) - 1].tolist() == short[:-1].tolist()


def test_prefixes_and_bare_words():
    hashes, _ = W.word_hashes(pa.array(["idiot, idiotic idiot"]), prefixes=(0, 5))
    assert hashes[1][0] == hashes[1][2] != hashes[1][1]
    assert len(set(hashes[2].tolist())) == 1
    assert hashes.dtype == np.uint64


def _thue_morse(a, b, doublings=10):
    bits = [0]
    for _ in range(doublings):
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits)


def test_words_built_to_collide_under_polynomial_hashes():
    one, other = _thue_morse("a", "b"), _thue_morse("b", "a")
    hashes, _ = W.word_hashes(pa.array([f"{one} {other} {one.upper()}"]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    sets = list(W.shingle_sets(pa.array([f"{one} x", f"{other} x"])))
    assert len(set(sets[0]) & set(sets[1])) == 0


@given(st.lists(st.text(alphabet="aAb", min_size=1, max_size=300), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_spans_compare_like_bytes(found):
    raw = np.frombuffer(" ".join(found).encode(), np.uint8)
    folded = W.Folded(raw)
    length = np.array([len(w) for w in found])
    starts = np.cumsum(length + 1) - length - 1
    hashes = W.span_hashes(folded, starts, starts + length)
    for i, w in enumerate(found):
        assert [h == hashes[i] for h in hashes] == [w.lower() == x.lower() for x in found]
        same = W.same_spans(folded, starts, folded, np.full(len(found), starts[i]), np.minimum(length, length[i]))
        assert same.tolist() == [w.lower()[: len(x)] == x.lower()[: len(w)] for x in found]
