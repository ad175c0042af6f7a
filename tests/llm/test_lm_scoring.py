"""Language model: base against counts, gradients, normalisation, edges."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from test_words import plain

from provenspark.llm import gru, lm_scoring


def base(texts):
    tok = {i: plain(t) + ["\0"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tok.items()}


@pytest.mark.parametrize("frequent", [400_000, 300])
def test_base_equals_counts(docs, monkeypatch, frequent):
    """With few frequent words the hash join gives the rest."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "TOKENS", 20_000)
    want = base({r.doc_id: r.text for r in docs.collect()})
    rows = lm_scoring.score(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, b = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(b, rel=1e-9)
    own = [r for r in rows if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_edges(make):
    df = make([(1, None), (2, ""), (3, "a b " * 40_000), (None, "x"), (3, "a b"), (4, "a c"), (5, "a d")])
    rows = lm_scoring.score(df).collect()
    assert len(rows) == 7 and all(math.isfinite(r.score) and r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert lm_scoring.score(df.limit(0)).count() == 0


def test_gradients(monkeypatch):
    monkeypatch.setattr(gru, "STATE", 4)
    p = {k: v.astype(np.float64) * 3 for k, v in gru.fresh().items()}
    r = np.random.default_rng(0)
    x, y, opens = r.integers(0, gru.WORDS, (5, 3)), r.integers(0, 200, (5, 3)), np.zeros((5, 3), bool)
    y[2] = 0
    y[3:, 1] = -1
    opens[2, 0] = True
    state = r.normal(size=(3, 4))
    _, g, read, _ = gru.gradients(p, x, y, opens, state)
    assert read.tolist() == sorted(set(x.ravel().tolist()))
    embed = np.zeros_like(p["embed"])
    embed[read] = g["embed"]
    g["embed"] = embed
    for name in gru.NAMES:
        at = tuple(np.argwhere(np.abs(g[name]) == np.abs(g[name]).max())[0])
        keep, eps = p[name][at], 1e-5
        p[name][at] = keep + eps
        up = gru.gradients(p, x, y, opens, state)[0]
        p[name][at] = keep - eps
        down = gru.gradients(p, x, y, opens, state)[0]
        p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=2e-3)


def test_lanes_hold_every_token_after_its_own():
    r = np.random.default_rng(4)
    documents = [r.integers(0, 50, n) for n in (1, 700, 3, 40, 1)]
    inputs, targets, opens = (a.T.ravel() for a in gru.lanes(documents))
    n = sum(map(len, documents))
    assert targets[:n].tolist() == np.concatenate(documents).tolist() and (targets[n:] == -1).all()
    assert opens[:n].sum() == 5 and (inputs[:n][opens[:n]] == gru.WORDS).all()
    assert (inputs[1:n][~opens[1:n]] == targets[: n - 1][~opens[1:n]]).all()


def test_state_is_carried_and_words_sum_to_one():
    p = gru.fresh()
    p["b_in"] += np.float32(0.1)
    ids = np.random.default_rng(2).integers(0, gru.WORDS, 200).astype(np.int16)
    together = gru.score(p, ids, np.array([0, 150, 150, 200]))
    assert together[1] == 0
    state, before, total = np.zeros((1, gru.STATE), np.float32), gru.WORDS, 0.0
    q = p | {"embed": p["embed"] + p["b_in"]}
    for t in ids[:150]:
        state = gru.step(q, np.array([before]), state)
        total += gru.output(q, state, np.array([int(t)]))[0]
        before = int(t)
    assert together[0] == pytest.approx(total, rel=1e-4)
    every = gru.output(p, np.repeat(state, gru.WORDS, 0), np.arange(gru.WORDS))
    assert np.exp(every).sum() == pytest.approx(1, rel=1e-3)


def test_every_training_token_is_fitted(docs, monkeypatch):
    """The tokens of all rounds are all training tokens, in however many shards; nothing is sampled or broken off."""
    seen, fitted = [], lm_scoring.fitted

    def watched(shards, counts, most):
        params, tokens = fitted(shards, counts, most)
        seen.append((tokens, shards.select("turn", "shard").distinct().count()))
        return params, tokens

    monkeypatch.setattr(lm_scoring, "fitted", watched)
    monkeypatch.setattr(lm_scoring, "TOKENS", 20_000)
    total = lm_scoring.score(docs).first().train_tokens
    assert seen[0][0] == total and seen[0][1] > 1
