"""What keeps large tables within their limits, each against a plain form."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from provenspark.functions import fixed, text
from provenspark.operators import ledger, retrieval, sequences
from provenspark.sources.store import Store


def segmented(surprises):
    """Boundaries by a plain fold."""
    past, since, out = [], 0, []
    for s in surprises:
        n = len(past)
        mean = sum(past) / n if n else 0.0
        sd = (sum((x - mean) ** 2 for x in past) / n) ** 0.5 if n else 0.0
        cut = since >= 2 and n >= 3 and sd >= 1e-6 and (s - mean) / sd > 1.0
        past, since = [*past, s][-64:], 0 if cut else since + 1
        out.append(cut)
    return out


def test_episodes_equal_a_plain_fold(spark):
    dice = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(p, i, " ".join(dice.choices(words[: 3 + i % 17 * 2], k=6))) for p in "ab" for i in range(400)]
    found = sequences.episodes(spark.createDataFrame(rows, "part string, seq int, content string"), "part", "seq").orderBy("part", "seq").collect()
    for p in "ab":
        own = [r for r in found if r.part == p]
        want = segmented([r.surprise for r in own])
        assert [r.boundary for r in own] == want and sum(want) > 20
        assert [r.episode for r in own] == [sum(want[: i + 1]) for i in range(len(want))]


def test_a_batch_is_segmented_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"Depot {i} holds fuel", "field", "conv:a") for i in range(5)], "content string, partition string, source_ref string")
    for name, table in ledger.observe(Store(spark, f"file://{tmp_path}"), rows, 1.7e9).items():
        assert "Window" not in table._jdf.queryExecution().optimizedPlan().toString(), name


@pytest.mark.parametrize("per_group, groups", [(2, 3), (2, 60), (1, 9), (9, 2)])
def test_contenders_are_all_that_may_be_shown(spark, per_group, groups):
    dice = random.Random(groups)
    rows = [(q, n, dice.choice([0.1, 0.2, 0.3, 0.5, 0.9]) if q % 2 else dice.random(), f"t{dice.randrange(5)}", f"g{dice.randrange(groups)}") for q in range(6) for n in range(120)]
    scored = spark.createDataFrame(rows, "query_id int, node int, score double, content string, g string")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "content", "node")
    shown = lambda df: sorted(tuple(r) for r in retrieval.group_cap(df.withColumn("rank", F.row_number().over(order)), "g", per_group, 7).select("query_id", "place", "node", "rank").where("place <= 7").collect())
    few = retrieval.contenders(scored, "g", per_group, 7)
    assert [r[:3] for r in shown(few)] == [r[:3] for r in shown(scored)]
    assert {r for r in shown(few) if r[3] == 1} == {r for r in shown(scored) if r[3] == 1}
    assert few.count() < 720


def test_texts_do_not_go_with_scored_rows(spark, small, monkeypatch):
    from provenspark.plans import catalogue

    wrote, step = {}, retrieval.step
    monkeypatch.setattr(retrieval, "step", lambda df, name="step": wrote.setdefault(name, df.columns) and step(df, name))
    catalogue.queries()["recall_results"](spark, small)
    assert "content" not in wrote["scored"]


def test_shapes_weigh_as_affinity(spark):
    kinds = [*fixed.ANSWER_SHAPES, "other", None]
    rows = spark.createDataFrame([(t, k) for t in ("12 litres at 9:30", "Ahmed went to the depot", "", "on Monday 3 May 2021") for k in kinds], "t string, k string")
    one, two = text.affinity(F.col("t"), F.col("k")), text.fitting(text.shapes(F.col("t")), F.col("k"))
    assert rows.where(~one.eqNullSafe(two)).isEmpty()


def test_pairs_within_groups(spark):
    """Every pair once with the product that dot gives, copies included, also where blocks are small; no query joins rows with rows."""
    from provenspark.operators import vectors

    dice = random.Random(5)
    base = [[dice.gauss(0, 0.3) for _ in range(7)] for _ in range(40)]
    rows = [(i, base[i % 25], i % 3) for i in range(90)] + [(90, [1.0, 2.0], 0), (91, [0.5, 0.25], 0), (92, base[0], None)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int").repartition(5)
    a, b = df.select(F.col("id").alias("a"), F.col("v").alias("va"), "label"), df.select(F.col("id").alias("b"), F.col("v").alias("vb"), "label")
    plain = a.join(b, "label").where("a < b and size(va) = size(vb)").select("a", "b", vectors.dot(F.col("va"), F.col("vb")).alias("sim"))
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, vectors.pairs_within(df, "label").collect())) == want
    assert sorted(map(tuple, vectors.pairs_within(df, "label", 0.2).collect())) == [w for w in want if w[2] >= 0.2]
    near, mean, k = vectors.quantile_within(df, "label", 0.95)
    sims = sorted(w[2] for w in want)
    assert sorted(r.sim for r in near.collect())[k - 1] == sims[min(len(sims), int(0.95 * len(sims)) + 1) - 1]
    assert abs(mean - sum(sims) / len(sims)) < 1e-12


def test_pairs_of_large_groups(spark, monkeypatch):
    """Groups of more rows than their parts and tiles hold, products on the edges of bins, and vectors that are empty or hold no numbers; rows for Python are single vectors."""
    import numpy as np

    from provenspark.operators import vectors

    monkeypatch.setattr(vectors, "PART", 700)
    monkeypatch.setattr(vectors, "PARTS", 2)
    dice = np.random.default_rng(3)
    base = np.concatenate([dice.normal(size=(1400, 3)) * 0.4, dice.choice([-0.5, 0.0, 0.5], size=(200, 3))]).tolist()
    rows = [(i, v, 0 if i % 8 else 1) for i, v in enumerate(base)] + [(i, v, 2) for i, v in ((2000, []), (2001, []), (2002, [1e200]), (2003, [2.0]))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)
    a, b = df.select(F.col("id").alias("a"), F.col("v").alias("va"), "label"), df.select(F.col("id").alias("b"), F.col("v").alias("vb"), "label")
    plain = a.join(b, "label").where("a < b and size(va) = size(vb)").select("a", "b", vectors.dot(F.col("va"), F.col("vb")).alias("sim"))
    want = sorted(map(tuple, plain.where("sim >= 0.25").collect()))
    found = vectors.pairs_within(df, "label", 0.25)
    assert sorted(map(tuple, found.collect())) == want and {w[2] for w in want} >= {0.25, 0.5, 2e200}
    assert "matrix" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert vectors.pairs_within(df, "label").count() == plain.count()
    sims = np.sort(plain.select("sim").toPandas()["sim"].to_numpy())
    for share in (0.1, 0.5, 0.95, 0.9999999):
        near, _, k = vectors.quantile_within(df, "label", share)
        assert sorted(r.sim for r in near.collect())[k - 1] == sims[min(len(sims), int(share * len(sims)) + 1) - 1]
    bad = spark.createDataFrame([(i, [float("nan") if i == 3 else 0.5, 0.5], 0) for i in range(5)], "id long, v array<double>, label int")
    near, mean, k = vectors.quantile_within(bad, "label", 0.95)
    assert np.isnan(mean) and np.isnan(sorted(r.sim for r in near.collect())[k - 1])


def test_fusion_of_hubs_takes_few_rounds(spark, monkeypatch):
    """A plain walk over the pairs in order gives the duplicates; a node of many pairs does not take a round for each of them."""
    from provenspark.operators import graph

    dice = random.Random(17)
    pairs = [(0, i, 0.99 - i / 1000) for i in range(1, 40)] + [(200, 201, 0.9), (201, 202, 0.95), (202, 203, 0.93), (100, 201, 0.91), (201, 204, 0.9)]
    pairs += [(a, b, dice.choice([0.86, 0.9, 0.95])) for a, b in sorted({tuple(sorted(dice.sample(range(50, 90), 2))) for _ in range(150)})]
    want = {}
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in want and b not in want:
            want[b] = a
    wrote, step = [], graph.step
    monkeypatch.setattr(graph, "step", lambda df, name="step": wrote.append(name) or step(df, name))
    found = graph.fusion_plan(spark.createDataFrame(pairs + pairs[:3], "a long, b long, sim double"))
    rows = [(r.node, r.target) for r in found.where("role = 'duplicate'").collect()]
    assert dict(rows) == want and len(rows) == len(want) > 60
    assert wrote.count("sure") < 12


def test_counter_evidence_holds_kinds_against_kinds(spark):
    """Pairs of rows are multiplied out at the end; they are not shuffled to be counted or summed up."""
    asked = spark.createDataFrame([(i, "the pump is working at site") for i in range(4)], "query_id int, query string")
    notes = spark.createDataFrame([(i, "pump is broken at site" if i % 2 else "pump at site") for i in range(6)], "node int, content string")
    found = retrieval.counter_evidence(asked, notes)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted({(r.query_id, r.node) for r in found.collect()}) == [(q, n) for q in range(4) for n in (1, 3, 5)]
    again = retrieval.counter_evidence(asked.union(asked), notes)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_sweep_equals_probing(spark, monkeypatch):
    """Recall by number of lists as plain probing and exact search give it, copies included, where queries meet every vector once and in blocks."""
    import numpy as np

    from provenspark.operators import vectors

    dice = random.Random(7)
    base = [[dice.gauss(0, 1) for _ in range(6)] for _ in range(120)]
    rows = [(i, base[i % 120 if i < 150 else i % 3]) for i in range(300)] + [(300, [1.0, 2.0]), (301, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    asked = df.where("id % 10 = 0 and id < 300")
    monkeypatch.setattr(vectors, "inverted_lists", lambda *a, made=vectors.inverted_lists(df, 5): made)
    told = vectors.sweep(df, asked, 4, 5, (1, 2, 5))
    assert "zip_with" not in told._jdf.queryExecution().optimizedPlan().toString()  # products are not taken row by row
    centroids, held = (x.collect() for x in vectors.inverted_lists())
    assert len({r.list for r in held}) > 2
    of = {r.id: (np.array(r.v), r.list) for r in held if r.v is not None and len(r.v) == 6}

    def dotted(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            total += x * y
        return total

    for r in told.collect():
        share, first = [], []
        for q in range(0, 300, 10):
            v = of[q][0]
            order = sorted(((-dotted(v, w), i, at) for i, (w, at) in of.items() if i != q))
            near = {c.list for c in sorted((c for c in centroids if len(c.c) == 6), key=lambda c: (-float(np.dot(v, c.c)), -c.list))[: r.nprobe]}
            exact, found = [i for _, i, _ in order[:4]], [i for _, i, at in order if at in near][:4]
            share.append(len(set(exact) & set(found)) / 4)
            first.append(exact[0] == found[0])
        assert abs(r.recall - np.mean(share)) < 1e-12 and abs(r.top1 - np.mean(first)) < 1e-12, r.nprobe
    assert {r.nprobe: r.recall for r in told.collect()}[5] == 1.0


def test_means_of_lists_as_aggregates(spark):
    """Lists and centroids as aggregates over single components give them; vectors that cannot be placed move no centroid."""
    import numpy as np

    from provenspark.operators import vectors

    dice = np.random.default_rng(11)
    rows = [(i, v) for i, v in enumerate(dice.normal(size=(80, 5)).tolist())]
    df = spark.createDataFrame(rows + [(80, [0.5, None, 1.0, 0.0, 0.0]), (81, None), (82, [1.0])], "id long, v array<double>").repartition(3)
    one, lists = vectors.inverted_lists(df.where("id < 80"), 4, iterations=3)
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    first = [r.id for r in df.where("id < 80").orderBy(F.xxhash64("id"), "id").limit(4).collect()]
    centres = np.array([units[i] for i in first])
    for _ in range(3):
        at = {i: int(np.argmax(centres @ v)) for i, v in units.items()}
        centres = np.array([np.mean([units[i] for i in units if at[i] == c], axis=0) for c in range(4)])
        centres /= np.linalg.norm(centres, axis=1)[:, None]
    assert np.allclose(centres, [r.c for r in one.orderBy("list").collect()])
    assert {r.id: r.list for r in lists.collect()} == {i: int(np.argmax(centres @ v)) for i, v in units.items()}
    more, lists = vectors.inverted_lists(df, 4, iterations=3)
    assert lists.count() == 83 and np.isfinite([x for r in more.collect() for x in r.c]).all()


def test_bridge_multiplies_rows_out_at_the_end(spark):
    """The larger score of each query and node as one aggregate over all of them gives it; found pairs are not shuffled."""
    dice = random.Random(9)
    cands = [(q, n, dice.random()) for q in [*range(12), None] for n in [*dice.sample(range(40), 9), None]] + [(3, 5, 0.9), (3, 5, 0.95), (4, 6, None)]
    mentioned = [(q, e) for q in range(14) for e in (q % 3, q % 4 + 2)] + [(5, 1), (6, None), (None, 2), (2, 2)]
    mention = [(e, n) for e in range(8) for n in dice.sample(range(40), 15)] + [(1, None), (1, 3), (1, 3), (None, 7)]
    relation = [(0, 1), (1, 0), (2, 6), (7, 3), (4, 4), (None, 2)]
    link = [*relation, *((b, a) for a, b in relation)]
    want = {}
    for q, n, s in cands:
        want.setdefault((q, n), []).append(s)
    for q, e in mentioned:
        for other, w in [(e, 0.55), *((b, 0.55 * 0.7) for a, b in link if a == e)]:
            for m, n in mention:
                if e is not None and m == other and m is not None:
                    want.setdefault((q, n), []).append(w)
    want = {at: max((s for s in some if s is not None), default=None) for at, some in want.items()}
    found = retrieval.bridge(*(spark.createDataFrame(rows, f"{names}").repartition(3) for rows, names in ((cands, "query_id int, node int, score double"), (mentioned, "query_id int, entity_id int"), (mention, "entity_id int, node_id int"), (relation, "src int, dst int"))))
    rows = [((r.query_id, r.node), r.score) for r in found.collect()]
    assert dict(rows) == want and len(rows) == len(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_recent_entities_fold_once(spark):
    """The newest mentions as a join of every row with all earlier ones gives them, without such a join."""
    from provenspark.operators import record

    dice = random.Random(13)
    mention = [(dice.randrange(9), dice.randrange(30), dice.choice("ab"), float(dice.randrange(25))) for _ in range(160)] + [(None, 3, "a", 4.0), (2, None, "a", 5.0), (3, 4, "a", None), (4, 5, None, 1.0), (5, 6, "b", float("nan")), (1, 7, "b", float("nan"))]
    rows = [(i, dice.choice("abc"), float(dice.randrange(25))) for i in range(60)] + [(7, "a", 24.0), (61, "a", None), (62, None, 3.0), (None, "a", 3.0), (63, "b", float("nan")), (64, "a", -1.0)]
    m, r = spark.createDataFrame(mention, "entity_id int, node_id int, partition string, at double"), spark.createDataFrame(rows, "id int, partition string, at double")
    entity = spark.createDataFrame([(e, f"e{e}", "k") for e in range(8)], "id int, name string, kind string")
    met = r.select("id", "partition", F.col("at").alias("t")).join(m, "partition").where("at <= t and node_id != id")
    last = met.groupBy("id", "entity_id").agg(F.max("at").alias("last"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("last").desc(), "entity_id"))
    for most in (1, 3):
        want = {}
        for x in last.withColumn("rn", rank).where(F.col("rn") <= most).orderBy("id", "rn").collect():
            if x.entity_id is not None and x.entity_id < 8:
                want.setdefault(x.id, []).append(f"e{x.entity_id}")
        found = record.recent_entities(r, m, entity, most)
        assert {x.id: [c.name for c in x.candidates] for x in found.collect()} == want and len(want) > 30
        assert "<= t" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1


def test_recent_entities_of_the_first_keys(spark, tmp_path):
    """Customer 0 is no node of supplier 0: keys from 0 on give what the oracle gives."""
    import duckdb

    from provenspark.plans import catalogue

    con = duckdb.connect()
    con.execute("CREATE TABLE nation AS SELECT i::INT AS n_nationkey, 'n' || i AS n_name FROM range(25) AS r(i)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, (i * 7 % 25)::INT AS c_nationkey FROM range(60) AS r(i)")
    con.execute("CREATE TABLE supplier AS SELECT i AS s_suppkey, (i * 5 % 25)::INT AS s_nationkey FROM range(5) AS r(i)")
    for t in ("nation", "customer", "supplier"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = {r.id: list(r.names) for r in catalogue.queries()["recent_entities"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(catalogue.oracle_sql()["recent_entities"]).fetchall()) and 0 in found
