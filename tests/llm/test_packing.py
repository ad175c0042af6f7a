"""Packing: whole ids, places without gaps, little padding."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provenspark.llm import packing as P
from provenspark.llm.tokens import default_tokenizer


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_shortest_pack_first_places_all(histogram):
    fill, taken = {}, {}
    for length, rank, sequence, offset in sorted(P.shortest_pack_first(histogram, 64), key=lambda x: x[2]):
        taken.setdefault(length, []).append(rank)
    placed = P.shortest_pack_first(histogram, 64)
    by_length = {}
    for k, row in enumerate(placed):
        by_length.setdefault(row[0], []).append((row[1], k))
    for length, starts in by_length.items():
        starts.sort()
        for (rank, k), end in zip(starts, [s[0] for s in starts[1:]] + [histogram[length]], strict=True):
            _, _, sequence, offset = placed[k]
            for i in range(end - rank):
                assert fill.get(sequence + i, 0) == offset
                fill[sequence + i] = offset + length
    assert sum(fill.values()) == sum(k * v for k, v in histogram.items())
    assert max(fill.values(), default=0) <= 64


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


def check(rows, texts, tokenizer, size):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return places


def test_documents(docs, tokenizer):
    rows = P.pack(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    places = check(rows, texts, tokenizer, 4096)
    total = sum(r.length for r in rows)
    assert len(places) * 4096 - total < 0.05 * total + 4096


def test_edges(make, tokenizer):
    texts = {1: None, 2: "", 3: "don't <|endoftext|> İstanbul ΣΑΣ naïve\x1cx 12345 'S", 4: "word " * 9000, 5: "퟿" * 3}
    df = make(list(texts.items()))
    rows = P.pack(df, with_ids=True).collect()
    check(rows, texts, tokenizer, 4096)
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert P.pack(df.limit(0)).count() == 0
    assert P.pack(make([(7, "a b"), (7, "a b"), (None, "c")])).count() == 3
    whole = {r.sequence_id: len(r.ids) for r in P.sequences(P.pack(df, with_ids=True)).collect()}
    assert sum(whole.values()) == sum(r.length for r in rows)


def test_long_table_is_joined(make, monkeypatch, tokenizer):
    texts = {i: "w " * (i * 7 % 900) for i in range(60)}
    df = make(list(texts.items()))
    monkeypatch.setattr(P, "TABLE_ROWS", 0)
    check(P.pack(df).collect(), texts, tokenizer, 4096)


def test_words_of_equal_hashes_keep_their_own_ids(monkeypatch):
    """Every word of one length hashes alike here; the bytes decide."""
    from provenspark.llm import tokens, words

    plain = tokens.WordIds(tokens.default_tokenizer())
    monkeypatch.setattr(words, "span_hashes", lambda folded, starts, ends, seed=0: words.mix((ends - starts).astype(np.uint64)))
    cache = tokens.WordIds(tokens.default_tokenizer())
    for texts in (["alpha gamma", "hello"], ["world"], ["alpha alpha", "", None]):
        ids, first = cache.encode(pa.array(texts, pa.string()))
        want, cuts = plain._whole(pa.array(texts, pa.string()))
        assert ids.tolist() == want.tolist() and first.tolist() == cuts.tolist()
