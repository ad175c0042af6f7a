"""Graph search against exact search."""

import numpy as np
import pyarrow as pa
import pytest

from provenspark.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, v string, score double, node int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.0, 1) for i, v in rows], SCHEMA)


def exact(rows, i, top=20):
    own = dict(rows)
    scores = [(-float(np.dot(np.asarray(own[i], np.float64), np.asarray(v, np.float64))), j) for j, v in own.items() if j != i]
    return [(j, -s) for s, j in sorted(scores)[:top]]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, scale):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    x = x * r.uniform(0.5, 2, (3000, 1)).astype(np.float32) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = table(spark, rows)
    got = {}
    for q in A.search(A.index(df, shard_rows=1100), df.where("vec_id % 20 = 0")).collect():
        got.setdefault(q.query_id, []).append(q)
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for i, found in got.items():
        found.sort(key=lambda q: q["rank"])
        assert [q["rank"] for q in found] == list(range(1, 21))
        assert [(-q.score, q.vec_id) for q in found] == sorted((-q.score, q.vec_id) for q in found)
        want = dict(exact(rows, i))
        hits += sum(q.vec_id in want for q in found)
        assert all(q.score == pytest.approx(float(np.dot(x[i].astype(np.float64), x[q.vec_id].astype(np.float64))), rel=1e-12) for q in found)
    assert hits / (20 * len(got)) >= 0.9


def test_edges(spark):
    good = [(i, [float(np.cos(i)), float(np.sin(i)), 0.5]) for i in range(1, 9)]
    odd = [(20, None), (21, [0.0, 0.0, 0.0]), (22, [float("nan"), 1.0, 1.0]), (23, [float("inf"), 1.0, 1.0]), (24, [None, 1.0, 1.0]), (25, []), (None, [1.0, 1.0, 1.0]), (40, [1.0, 2.0])]
    df = table(spark, good + odd + [(3, good[2][1])])
    rows = A.search(A.index(df), df).collect()
    own = {}
    for q in rows:
        own.setdefault(q.query_id, []).append(q)
    assert sorted(own) == list(range(1, 9)) and all(len(v) == 7 for v in own.values())
    assert [(q.vec_id, pytest.approx(q.score)) for q in sorted(own[1], key=lambda q: q["rank"])] == [(j, pytest.approx(s)) for j, s in exact(good, 1)]
    assert A.search(A.index(df.limit(0)), df).count() == 0
    assert A.search(A.index(df), df.limit(0)).count() == 0


def test_copies_tie_to_smaller_ids(spark):
    df = table(spark, [(i, [1.0, 0.0]) for i in range(100, 0, -1)] + [(200, [0.0, 1.0])])
    got = sorted((q["rank"], q.vec_id) for q in A.search(A.index(df), df.where("vec_id = 20")).collect())
    assert [v for _, v in got] == [i for i in range(1, 22) if i != 20]


def unit(r, n, d):
    x = r.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def found(x, step=20, top=20):
    """(ids found, ids wanted by exact search) of every step-th row, over one shard without a session."""
    n = len(x)
    table = pa.table({"shard": np.zeros(n, np.int32), "vec_id": np.arange(n), "v": pa.array(list(np.asarray(x, np.float64)), pa.list_(pa.float64()))})
    graph = pa.Table.from_batches(list(A._graphs(iter(table.to_batches()))))
    got = {}
    result = A._searcher(top, A.SEARCH)(graph, table.take(np.arange(0, n, step)))
    for q, i in zip(result.column("query_id").to_pylist(), result.column("vec_id").to_pylist(), strict=True):
        got.setdefault(q, []).append(i)
    want = {}
    for q in range(0, n, step):
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.nan_to_num(np.einsum("d,nd->n", x[q], x), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        want[q] = [i for i in np.lexsort((np.arange(n), -score)).tolist() if i != q][:top]
    return got, want


def recall(x, **more):
    got, want = found(x, **more)
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("spread", [0.25, 0.5, 1.0])
def test_recall_on_uneven_lengths(spread):
    r = np.random.default_rng(2)
    assert recall(unit(r, 3000, 32) * np.exp(spread * r.normal(size=(3000, 1)))) >= 0.95


@pytest.mark.parametrize("size", [1e4, 1e160, 1e-170])
def test_one_odd_length_spoils_nothing(size):
    x = unit(np.random.default_rng(3), 1500, 24)
    x[7] *= size
    assert recall(x) >= 0.95


def test_vectors_of_tiny_length_take_part():
    got, _ = found(unit(np.random.default_rng(4), 200, 8) * 1e-170)
    assert sorted(got) == list(range(0, 200, 20)) and all(len(v) == 20 for v in got.values())


def test_ties_go_to_smaller_ids_beyond_the_beam():
    r = np.random.default_rng(5)
    x = (r.random((1500, 16)) < 0.3).astype(float)
    x[:, 0] = 1
    got, want = found(x)
    assert got == want
    got, want = found(np.eye(64), step=1)
    assert got == want


def test_every_node_can_be_reached():
    edges, start = A.build(np.eye(300, dtype=np.float32))
    seen = np.zeros(300, bool)
    A._reached(np.vstack([edges, np.full(edges.shape[1], -1)]), start, seen)
    assert seen.all()
