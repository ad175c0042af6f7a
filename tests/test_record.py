"""Records end to end on a store: partitions, claims, promises, decisions, revaluation, views; caches, sidecar, role vectors."""

import json

import pytest
from pyspark.sql import functions as F

from provenspark.operators import caches, context, ledger, record, vectors
from provenspark.operators.diagnostics import key_permissions
from provenspark.sources import sidecar
from provenspark.sources.store import PartitionError, Store, commitments, conclusions, decisions, impacts, intentions, nodes

NOW = 1.7e9


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, "file://" + str(tmp_path_factory.mktemp("records")))
    s.write(record.declare(s, "field", NOW))
    s.write(record.declare(s, "vault", NOW, sealed=True))
    rows = [("Depot north holds 4000 litres of fuel", "conv:a:1"), ("Bridge east is open today", "conv:b:1"), ("Clinic has twelve beds", "conv:c:1")]
    s.write(ledger.observe(s, spark.createDataFrame([(c, "field", r, "document") for c, r in rows], "content string, partition string, source_ref string, origin string"), NOW))
    return s


def node(store, like):
    return store.read("observation").where(f"content like '{like}%'").first()["id"]


def test_partitions_refuse_what_is_sealed(store):
    with pytest.raises(PartitionError):
        record.declare(store, "vault", NOW, flows_to=["field"])
    with pytest.raises(PartitionError):
        record.declare(store, "desk", NOW, summary_reads_from=["vault"])
    tables = record.declare(store, "desk", NOW, reads_from=["field"])
    assert [tuple(r) for r in tables["partition_flow"].collect()] == [("field", "desk", "full")]


def test_claims_promises_and_learned_grades(spark, store):
    depot = node(store, "Depot")
    said = spark.createDataFrame([("Dr. Sara Lund", "person", "field", f"claim {w}", depot) for w in ("alpha", "beta", "gamma")], "who string, kind string, partition string, proposition string, node_id string")
    store.write(record.claimed(said, NOW))
    ids = [r["id"] for r in store.read("claim").collect()]
    assert store.read("claimant").count() == 1
    store.write(record.claim_outcomes(spark.createDataFrame([(i, k < 2) for k, i in enumerate(sorted(ids))], "claim_id string, confirmed boolean"), NOW))
    promise = spark.createDataFrame([("sara lund", "field", "bring the pump", depot, NOW + 10.0)], "who string, partition string, statement string, node_id string, due_at double")
    store.write(record.committed(promise, NOW))
    assert store.one("intention")["action"] == "check: bring the pump"
    cid = store.one("commitment")["id"]
    store.write(record.commitment_outcomes(store, spark.createDataFrame([(cid, True, "done")], "commitment_id string, kept boolean, note string"), NOW + 20))
    assert commitments(store).first()["status"] == "kept" and intentions(store).first()["status"] == "done"
    store.write(record.revalue_claimants(store, NOW + 30))
    assert store.one("source_assessment", source_ref="conv:a:1")["reliability"] == "C"  # three of four kept or confirmed: 4 / 6
    who = record.who_claims(store, spark.createDataFrame([("claim beta",)], "proposition string")).collect()
    assert [r.name for r in who] == ["Dr. Sara Lund"] and record.people(store).count() == 1


def test_decisions_and_revaluation(spark, store):
    depot, bridge = node(store, "Depot"), node(store, "Bridge")
    shape = "content string, parents array<string>, kind string, producer string, confidence double, epistemic string, falsifier string"
    made, _ = ledger.derive(store, spark.createDataFrame([("fuel is not a constraint", [depot], "inference", "m", 0.9, "inferred", None)], shape), NOW)
    store.write(made)
    der = store.one("derived")["id"]
    asked = [("send the convoy", [der, bridge]), ("wait", []), ("turn back", ["obs_none"])]
    tables, refused = record.decided(store, spark.createDataFrame([(s, b, "field", "user", None) for s, b in asked], "statement string, because array<string>, partition string, by string, reversible_until double"), NOW)
    assert {(r.statement, r.refused) for r in refused.collect()} == {("wait", "no basis"), ("turn back", "unknown basis")}
    store.write(tables)
    roots = spark.createDataFrame([(depot,)], "node string")
    found = record.radius(store, roots)
    assert [r.node for r in found["derived"].collect()] == [der] and found["decisions"].count() == 1
    tables, plan = record.discredited(store, roots, "misread gauge", NOW + 5)
    store.write(tables)
    assert plan.count() == 1 and conclusions(store).first()["confidence"] == pytest.approx(0.18)
    assert store.one("absence")["query"] == f"discredited:{depot}"
    impact = impacts(store).first()
    assert impact["cause"] == "discredited" and impact["severity"] > 0 and impact["acknowledged_at"] is None
    assert record.urgent(impacts(store), decisions(store), NOW).count() == int(impact["severity"] >= 0.5)
    again, _ = record.discredited(store, roots, "again", NOW + 6)
    assert again["decision_impact"].count() == 0
    prefix = [r.content for r in record.session_prefix(store, "field", NOW + 50).collect()]
    assert prefix == ["discredited: send the convoy"]
    store.write(record.acknowledged(store, spark.createDataFrame([(impact["id"], "reaffirmed", "still right")], "impact_id string, status string, outcome string"), NOW + 7))
    assert impacts(store).first()["acknowledged_at"] == NOW + 7 and decisions(store).first()["status"] == "reaffirmed"
    store.write(record.executed(spark.createDataFrame([(decisions(store).first()["id"], "arrived")], "decision_id string, outcome string"), NOW + 8))
    assert decisions(store).first()["status"] == "executed"
    store.write(record.recompute_criticality(store, NOW + 9))
    assert store.read("criticality").where("node_id like 'dec_%'").count() == 0


def test_corrections_views_and_predictions(spark, store):
    clinic = node(store, "Clinic")
    known = nodes(store).select("id", "content", "partition", "claim_class", "at")
    store.write(record.corrected(spark.createDataFrame([(clinic, "Clinic has ten beds", "lena", "recount")], "node_id string, corrected string, by string, reason string"), known, NOW + 3))
    view = {r.node_id: r for r in record.ledger_view(store, "field").collect()}
    assert view[clinic].corrected and "[corrected]" in view[clinic].line
    text = record.ledger_text(record.ledger_view(store, "field"), "field")
    assert "## Told or shown" in text and "not fact" in text
    assert store.one("exposure", who="lena")["depth"] == 1.6
    store.write(record.predicted(spark.createDataFrame([(clinic, 0.8, None)], "node_id string, confidence double, claim_kind string"), nodes(store), NOW))
    pid = store.one("calibration")["id"]
    store.write(record.prediction_outcomes(spark.createDataFrame([(pid, True)], "id string, correct boolean"), NOW + 1))
    by, curve = record.calibration(store)
    assert by.first()["verdict"] == "insufficient" and curve.where("n > 0").count() == 1
    store.write(record.suppressed(spark.createDataFrame([(clinic, "old")], "node_id string, reason string"), NOW))
    assert clinic not in {r.node_id for r in record.ledger_view(store, "field").collect()}


def test_receipts_absences_failures_vectors(spark, store):
    asked = spark.createDataFrame([(1, "fuel depot north litres", "field")], "query_id int, query string, viewer string")
    answers, results = ledger.recall(store, asked, NOW + 60)
    told = answers.first()
    assert told["degraded"] and not told["provisional"] and not told["full_strength"] and told["informative"]
    store.write(record.receipts(asked, answers, results, NOW + 60))
    receipt = record.receipts_for(store, "depot").first()
    assert json.loads(receipt["returned"][0])["n"].startswith("obs_")
    store.write(record.absences(spark.createDataFrame([("diesel bardera", "field", None, "asked all", 100.0)], "query string, partition string, scope string, reason string, expires_in double"), NOW))
    again, _ = ledger.recall(store, spark.createDataFrame([(1, "diesel bardera", "field")], asked.schema), NOW + 60)
    assert again.first()["state"] == "searched_and_absent"
    store.write(record.failed(spark.createDataFrame([("dig by hand", "frost", "", "field", None)] * 2, "approach string, reason string, context string, partition string, node_id string"), NOW))
    assert store.one("failure")["recurrence"] == 2
    waiting = record.without_vector(store, "m").count()
    embed = lambda rows: rows.select("node_id", "partition", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    store.write(record.reindex(store, embed, "m"))
    assert store.count("vector") == waiting > 0 and record.without_vector(store, "m").count() == 0
    held = caches.vectors_of(store, "m")
    assert held.count() == waiting
    held.unpersist()
    store.write({"embed_queue": spark.createDataFrame([("x", "field", 0), ("y", "field", 3)], "node_id string, partition string, attempts int")})
    assert [tuple(r) for r in record.queue_depth(store).collect()] == [("field", 1, 1)]


def test_answer_cache(spark, store, monkeypatch):
    cache = caches.AnswerCache(entries=1)
    one, two = cache.key("q", "field", NOW, 1, most_affect=0.2), cache.key("q", "field", NOW, 1, most_affect=0.9)
    assert one != two and cache.key("q", "field", NOW, 2) != cache.key("q", "field", NOW, 1)
    cache.put(one, "a")
    assert cache.get(one) == "a" and cache.get(two) is None and (cache.hits, cache.misses) == (1, 1)
    cache.put(two, "b")
    assert cache.get(one) is None and cache.get(two) == "b"
    cache.invalidate()
    assert cache.get(two) is None
    empty = caches.AnswerCache(entries=0)
    empty.put(one, "a")
    assert empty.get(one) is None


def test_vocabulary_filters(spark):
    post = spark.createDataFrame([(f"t{i}", i % 7, "p" if i % 2 else "q") for i in range(400)], "term string, node int, partition string")
    filters = caches.vocabulary_filters(post)
    asked = spark.createDataFrame([(1, "t1", "p"), (1, "t2", "p"), (2, "nothing", "p"), (3, "t1", "none")], "query_id int, term string, owner string")
    got = {(r.query_id, r.term): r.possible for r in caches.possible(asked, filters).collect()}
    assert got[(1, "t1")] and not got[(2, "nothing")] and not got[(3, "t1")]
    assert {r.query_id: r.unknown for r in caches.definitely_unknown(asked, filters).collect()} == {1: False, 2: True, 3: True}
    more = caches.vocabulary_filters(spark.createDataFrame([("nothing", 1, "p")], post.schema))
    assert caches.possible(asked, caches.merge_filters(filters, more)).where("term = 'nothing'").first()["possible"]
    assert spark.range(1).select(caches.false_positive_rate(F.lit(1000), F.lit(65536))).first()[0] < 0.001


def test_sidecar_and_key(tmp_path):
    model = tmp_path / "m.gguf"
    made = sidecar.derived("m", [0.5, 0.7], [0.2, 0.3], [0.2], [0.1], (0.2, 0.3), (0.4, 0.5), 0.99, NOW)
    assert made.separator == "level" and made.ceiling == 0.7
    sidecar.save(made, model)
    assert sidecar.load(model) == made and sidecar.load(tmp_path / "none") is None
    path = tmp_path / f"m.gguf{sidecar.SUFFIX}"
    old = {k: v for k, v in json.loads(path.read_text()).items() if k not in ("ceiling", "doc_anisotropy")}
    path.write_text(json.dumps(old | {"unheard": 1}))
    back = sidecar.load(model)
    assert back.ceiling == 0.7 and back.anisotropy == 0.0 and len(back.notes) == 2
    path.write_text("{")
    assert sidecar.load(model) is None
    assert sidecar.conventions("bert", "e5-large")["doc_prefix"] == "passage: " and sidecar.conventions("qwen3", "x", causal=True)["pooling"] == "last"
    key = tmp_path / "key"
    key.write_text("k")
    key.chmod(0o644)
    assert key_permissions(str(key)) and key_permissions(str(tmp_path / "nokey"))
    key.chmod(0o600)
    assert not key_permissions(str(key))


def test_role_vectors(spark):
    roles = spark.createDataFrame([(n, r, f) for n, rf in {"n1": {"actor": "ahmed", "place": "depot", "object": "fuel"}, "n2": {"actor": "sara", "place": "clinic", "object": "beds"}, "n3": {"actor": "lena", "place": "depot", "object": "rope"}}.items() for r, f in rf.items()], "node string, role string, filler string")
    traces = vectors.traces(roles, 1024).persist()
    got = {r.node: r.filler for r in vectors.fillers(traces, roles, "actor", {"place": "depot"}).collect()}
    assert got == {"n1": "ahmed", "n3": "lena"}
    told = vectors.crosstalk(traces, roles).first()
    assert told["pairs"] == 2 and told["shared"] == 1 and told["healthy"]
    traces.unpersist()


def test_fusion_levels_and_communities(spark, store):
    known = spark.createDataFrame([("a", "pump one runs", "field", 0.9, 1.0, "status", "trusted"), ("b", "pump one is running", "field", 0.7, 2.0, "status", "trusted"), ("c", "bed count 12", "field", 0.8, 3.0, "verbatim", "trusted")], "id string, content string, partition string, confidence double, at double, claim_class string, trust string")
    pairs = lambda rows: rows.sparkSession.createDataFrame([("a", "b", 0.8), ("b", "c", 0.8)] if "c" in {r.id for r in rows.collect()} else [], "a string, b string, sim double")
    levels = record.fuse(pairs, known, NOW)
    first = levels[0][1].collect()
    assert [(r.content, r.confidence, r.members) for r in first] == [("pump one runs", 0.7, ["a", "b"])]
    found = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c")], "community string, node string")
    store.write(record.communities(store, found, "field"))
    assert record.communities(store, found, "field")["community"].count() == 0
    grown = record.communities(store, found.union(spark.createDataFrame([("x", "d")], found.schema)), "field")["community"].first()
    assert grown["generation"] == 2 and len(grown["lineage"]) == 1


def test_standalone_copies(spark):
    rows = spark.createDataFrame([("1", "He said it opens tomorrow", 0.0, [("Omar", "person")], "field", 0.8), ("2", "Depot is full", 0.0, [], "field", 0.8)], "id string, content string, at double, candidates array<struct<name:string,kind:string>>, partition string, confidence double")
    told = context.expand(rows)
    got = {r.id: (r.content, r.unresolved) for r in told.collect()}
    assert got["1"] == ("Omar said it opens tomorrow (1970-01-02)", ["it"]) and got["2"] == ("Depot is full", [])
    made = context.decontexted(rows, told, NOW)
    assert made["derived"].first()["confidence"] == pytest.approx(0.72) and made["derivation_edge"].first()["parent_id"] == "1"


def test_reasoner(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert [r.answer for r in context.reasoned(rows, lambda: lambda texts: [t.upper() for t in texts]).collect()] == ["A", "B"]

    def broken():
        def complete(texts):
            raise RuntimeError

        return complete

    assert context.reasoned(rows, broken).where("answer is null").count() == 2


def test_model_header(tmp_path):
    import struct

    word = lambda x: struct.pack("<Q", len(x)) + x.encode()
    entries = [("general.architecture", 8, word("bert")), ("general.name", 8, word("small")), ("bert.embedding_length", 4, struct.pack("<I", 384)), ("bert.pooling_type", 4, struct.pack("<I", 2)), ("tokens", 9, struct.pack("<IQ", 4, 100) + b"\0" * 400), ("names", 9, struct.pack("<IQ", 8, 2) + word("a") + word("b")), ("bert.block_count", 4, struct.pack("<I", 6))]
    path = tmp_path / "m.gguf"
    path.write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 0, len(entries)) + b"".join(word(k) + struct.pack("<I", t) + v for k, t, v in entries))
    assert sidecar.model_header(path) == sidecar.Model("bert", "small", "cls", 384, 0, 6)
    (tmp_path / "no").write_bytes(b"GGML")
    with pytest.raises(ValueError):
        sidecar.model_header(tmp_path / "no")
    (tmp_path / "cut").write_bytes(path.read_bytes()[:40])
    with pytest.raises(ValueError):
        sidecar.model_header(tmp_path / "cut")


def test_sealed_lifecycle(spark, tmp_path):
    from provenspark.sources import sealed

    key, path, work = bytes(range(32)), "file://" + str(tmp_path / "sealed"), "file://" + str(tmp_path / "work")
    row = lambda who: spark.createDataFrame([(who, "n", NOW, "briefing", 0.5)], "who string, node_id string, at double, channel string, depth double")
    with sealed.opened(spark, path, key, work) as s:
        s.append("exposure", row("a"))
    assert not list((tmp_path / "work").glob("plain-*"))
    with sealed.opened(spark, path, key, work) as s:
        assert s.count("exposure") == 1
        s.append("exposure", row("b"))
    with pytest.raises(RuntimeError), sealed.opened(spark, path, key, work) as s:
        s.append("exposure", row("c"))
        raise RuntimeError
    with sealed.opened(spark, path, key, work) as s:
        assert {r.who for r in s.read("exposure").collect()} == {"a", "b"}
    with pytest.raises(sealed.SealError), sealed.opened(spark, path, bytes(32), work):
        pass
