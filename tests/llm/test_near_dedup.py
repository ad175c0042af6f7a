"""Near duplicates against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_words import plain, shingles

from provenspark.llm import near_dedup as N
from provenspark.llm.components import connected_components


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * union:
                p, q = sorted((find(a), find(b)))
                least[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(seed, groups=12, size=12, edits=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdef", k=r.randint(1, 5)))
    common, out = [word() for _ in range(60)], []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 6, 9, 40, 200]))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = common + w
            out.append(" ".join(w))
    r.shuffle(out)
    return list(enumerate(out))


def compare(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(make, seed):
    rows = texts(seed)
    compare(make(rows), rows)


def test_long_lists_are_finished_in_blocks(make, monkeypatch):
    """With short lists of two members only, stars and blocks do the work.

    Blocks run in workers, which read the unpatched module; the driver's plan is what changes."""
    monkeypatch.setattr(N, "SHORT", 2)
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = texts(3, groups=5, size=30, edits=12)
    compare(make(rows), rows)


def test_edges(make):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (None, "one two"), (7, "a " * 50_000), (8, "a " * 40_000), (4, "one two")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(make(rows)).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True), (7, 1, 7, True), (8, 1, 7, False)}
    assert N.near_duplicates(make([]).limit(0)).count() == 0
    assert {r.doc_id for r in N.survivors(make(rows)).collect()} == {1, 2, 3, 4, 6, 7, None}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 90), (5, 5), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}
    assert connected_components(edges.limit(0)).count() == 0


def test_words_as_in_contract():
    assert plain("A\x0bB c\x1cd") == ["a", "b c\x1cd"]


def test_rows_that_repeat_an_id_with_other_texts(make):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base), (1, "x y z u v w"), (2, "x y z u v w"), (3, base + " more"), (9, base), (9, base)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(make(rows)).collect())
    assert got == [(1, 2, 1), (1, 36, 1), (2, 2, 1), (3, 37, 1), (9, 36, 1), (9, 36, 1)]
    assert sorted((r.doc_id, len(r.text.split())) for r in N.survivors(make(rows)).collect()) == [(1, 6), (1, 40)]
    again = [(5, base), (5, base), (6, "q"), (6, "q"), (None, "q"), (None, "q")]
    assert sorted(str(r.doc_id) for r in N.survivors(make(again)).collect()) == ["5", "6", "None", "None"]


@pytest.mark.parametrize("n", [30, 60, 200, 2000])
def test_linked_sets_share_a_list_and_pass_the_estimate(n):
    """Pairs of sets at 75 % exactly, the hardest ones: none may be lost."""
    r = np.random.default_rng(n)
    lost = 0
    for _ in range(3000):
        both = -(-3 * n // 4)
        union = r.integers(0, 1 << 64, n, dtype=np.uint64)
        cut = both + r.integers(0, n - both + 1)
        x, y = np.sort(np.concatenate([union[:both], union[both:cut]]))[: N.K], np.sort(np.concatenate([union[:both], union[cut:]]))[: N.K]
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([n, n]), pa.array([x.tobytes(), y.tobytes()])], names=["rep", "n", "sketch"])
        keys = next(iter(N._keys(iter([batch]))))
        lists = [set(k.as_py() for k, o in zip(keys.column("key"), keys.column("rep"), strict=True) if o.as_py() == w) for w in (0, 1)]
        short = next(iter(N._short(iter([batch])))).column("sk").to_pylist()
        sa, sb = (np.frombuffer(b, np.uint32).reshape(1, -1) for b in short)
        lost += not (lists[0] & lists[1]) or N.estimated(sa, sb)[0] < N.LEAST
    assert lost == 0


def test_hubs_are_hung_without_gathering(spark):
    """A hub with most edges, whether its id is the least or the greatest."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(10_000, i) for i in range(1_000, 1_400)] + [(5_000, 5_001)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(400)}, **{i: 1_000 for i in [*range(1_000, 1_400), 10_000]}, 5_000: 5_000, 5_001: 5_000}
