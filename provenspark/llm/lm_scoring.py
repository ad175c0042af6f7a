"""Language-model scores of whole documents: a smoothed unigram base and a gated recurrent model.

1. One pass counts the words of all training documents (hashes; counts are
   summed in the worker, then by one shuffle).  The table goes to the shared
   folder and grows with the corpus.
2. The ``WORDS`` - 2 most frequent words get model ids; the recurrent model is
   fitted on every training document, whole, in one pass.  Documents are dealt
   by hash into shards of about ``TOKENS`` tokens, and shards into rounds; the
   shards of a round are passed over from the same parameters, the results are
   averaged by tokens, and the next round goes on from there.
3. One pass scores every document: counts of up to ``FREQUENT`` words go out
   with the tasks, every other word of a document is listed beside its row.
4. Listed words meet the count table in a hash join, are summed by document
   and joined to its row.  No vocabulary, however large, is held in one place.

A word without a model id has the class of other words; within it, its
probability is its smoothed share of their counts, from the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenspark.llm import gru
from provenspark.llm.shared import cut, held_out, numbers, parts
from provenspark.llm.words import U64, mix, slices, word_hashes

#: Training tokens of a shard, about; words whose counts go out with the tasks at most.
TOKENS, FREQUENT = 400_000, 400_000
#: Sums of a round's states that reach the driver.
ADDERS = 4
#: Distinct words that a counting task holds before it passes them on.
HELD = 1_500_000
END = mix(np.array([0x5EED], dtype=U64))[0]


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    texts, more = 0, 0

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts += batch.num_rows
        held.append(np.unique(word_hashes(batch.column("text"))[0], return_counts=True))
        more += len(held[-1][0])
        if more > HELD:
            held = [_merged(held)]
            more = 0
            if len(held[0][0]) > HELD:
                yield out(*held[0])
                held = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    keys, counts = _merged(held)
    if texts:
        keys, counts = np.concatenate([keys, [END]]).astype(U64), np.concatenate([counts, [texts]])
    for at in range(0, len(keys), 100_000):
        yield out(keys[at : at + 100_000], counts[at : at + 100_000])


class Frequent:
    """Sorted hashes of the most frequent words with their counts and model ids (0: none)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.counts, self.ids = keys[order], counts[order], ids[order].astype(np.int16)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, count, model id) of each hash."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int16)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return known, np.where(known, self.counts[at], 0), np.where(known, self.ids[at], 0).astype(np.int16)


def _ids(table: Frequent):
    """Model ids of whole training documents, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            hashes, first = word_hashes(batch.column("text"))
            ids = table.find(hashes)[2]
            out = [np.append(ids[lo:hi], gru.WORDS - 1).astype(np.int16).tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("shard"), pa.array(out, pa.binary())], names=["turn", "shard", "ids"])

    return run


STATES = "tokens long, done long, state binary"


def _states(tokens: int, done: int, row: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([done], pa.int64()), pa.array([row.astype(np.float32).tobytes()], pa.binary())], names=["tokens", "done", "state"])


def _pass(state: dict, turn: int):
    """The token-weighted mean of the states after a pass over each shard of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[bytes]] = {}
        for batch in batches:
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                shards.setdefault(shard, []).append(ids)
        tokens, done, total = 0, 0, 0.0
        for shard in sorted(shards):
            after, n = gru.train(state, [np.frombuffer(b, np.int16).astype(np.int64) for b in sorted(shards.pop(shard))], turn)
            tokens, done, total = tokens + n, max(done, after["done"]), total + gru.flat(after) * n
        if tokens:
            yield _states(tokens, done, total / tokens)

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token-weighted mean of a task's states."""
    tokens, done, total = 0, 0, 0.0
    for batch in batches:
        for t, d, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens, done, total = tokens + t, max(done, d), total + np.frombuffer(row, np.float32).astype(np.float64) * t
    if tokens:
        yield _states(tokens, done, total / tokens)


def fitted(shards: DataFrame, counts: np.ndarray, most: int) -> tuple[dict, int]:
    """(parameters, tokens) after ROUNDS rounds over shards (turn, shard, ids); most: shards of a round at most."""
    state, tokens = gru.start(counts), 0
    tasks = min(most, 2 * parts(shards.sparkSession))  # a task passes over its shards in turn and hands on one state
    for turn in range(gru.ROUNDS):
        of_turn = shards.where(F.col("turn") == turn).select("shard", "ids").repartitionById(tasks, "shard")
        means = of_turn.mapInArrow(_pass(state, turn), STATES).repartition(max(ADDERS, int(tasks**0.5))).mapInArrow(_mean, STATES)
        found = means.repartition(ADDERS).mapInArrow(_mean, STATES).collect()  # at most ADDERS rows
        if found:
            own = sum(r["tokens"] for r in found)
            tokens += own
            state = gru.shaped(sum(np.frombuffer(bytes(r["state"]), np.float32).astype(np.float64) * r["tokens"] for r in found) / own, max(r["done"] for r in found))
    return state["p"], tokens


ROWS = "row long, doc_id long, n_tokens long, known long, logs double, other_logs double, others long, model double, hashes array<long>, counts array<int>"


def _rows(table: Frequent, end_count: int, params: dict):
    """One row per document; hashes and counts: its words that are not in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_end = np.log10(end_count + 1.0)
        keyed = np.random.default_rng()
        for whole in batches:
            ids, lengths, columns = [], [], []
            for batch in slices(whole, "text"):
                hashes, first = word_hashes(batch.column("text"))
                n, words = batch.num_rows, np.diff(first)
                doc = np.repeat(np.arange(n), words)
                distinct, at = np.unique(hashes, return_inverse=True)
                known, count, ident = table.find(distinct)
                logs = np.log10(count + 1.0)
                other = ident == 0
                known_t, other_t = known[at], other[at]
                listed = np.flatnonzero(~known_t)
                pair, times = np.unique(doc[listed] * np.int64(len(distinct)) + at[listed], return_counts=True) if len(listed) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                owner = pair // max(1, len(distinct))
                cuts = np.searchsorted(owner, np.arange(n + 1))
                unknown = distinct[pair % max(1, len(distinct))].view(np.int64)
                columns.append(
                    (
                        batch.column("doc_id"),
                        words + 1,
                        np.bincount(doc, known_t, n).astype(np.int64) + (end_count > 0),
                        np.bincount(doc, logs[at], n).astype(np.float64) + log_end,
                        np.bincount(doc, np.where(other_t, logs[at], 0), n).astype(np.float64),
                        np.bincount(doc, other_t, n).astype(np.int64),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(unknown)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(times.astype(np.int32))),
                    )
                )
                flat = np.full(len(hashes) + n, gru.WORDS - 1, np.int16)
                flat[np.arange(len(hashes)) + doc] = ident[at]
                ids.append(flat)
                lengths.append(words + 1)
            if not columns:
                continue
            first = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            model = gru.score(params, np.concatenate(ids), first) / np.log(10)
            done = 0
            for doc_id, tokens, known, logs, other_logs, others, unknown, times in columns:
                n = len(tokens)
                keys = keyed.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), doc_id, pa.array(tokens), pa.array(known), pa.array(logs), pa.array(other_logs), pa.array(others), pa.array(model[done : done + n]), unknown, times],
                    names=[f.split()[0] for f in ROWS.split(", ")],
                )
                done += n

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    A null or empty text is its end token alone.  Null and repeated ids are
    scored row for row; other columns are not read; without training documents
    every count is zero; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    training = rows.where(~held_out(F.col("doc_id"), folds, fold))
    counted = cut(training.select("text").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "word-counts")
    n, v = (x or 0 for x in counted.agg(F.sum("c"), F.count("*")).first())
    end = int(END.view(np.int64))
    words = counted.where(F.col("h") != end)
    end_count = next((r["c"] for r in counted.where(F.col("h") == end).collect()), 0)  # one row

    # the lowest count at which the words of that count and more are at most FREQUENT; counts by at most 1,024 logarithmic bins
    bins = {r["bin"]: (r["least"], r["n"]) for r in words.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect()}
    least, total = 1 << 62, 0
    for b in sorted(bins, reverse=True):
        total += bins[b][1]
        if total > FREQUENT:
            break
        least = bins[b][0]
    keys, counts = numbers(words.where(F.col("c") >= least).select("h", "c"))  # at most FREQUENT rows of two numbers
    keys = keys.view(U64)
    order = np.lexsort((keys, -counts))[: gru.WORDS - 2]
    ids = np.zeros(len(keys), np.int64)
    ids[order] = np.arange(1, len(order) + 1)
    table = Frequent(keys, counts, ids)

    most = max(1, -(-n // (TOKENS * gru.ROUNDS)))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(most * gru.ROUNDS))
    dealt = training.select(F.pmod(place, F.lit(gru.ROUNDS)).cast("int").alias("turn"), F.floor(place / gru.ROUNDS).cast("int").alias("shard"), "text")
    shards = cut(dealt.mapInArrow(_ids(Frequent(keys[order], counts[order], ids[order])), "turn int, shard int, ids binary"), "model-ids", by="turn")
    by_id = np.zeros(gru.WORDS, np.int64)
    by_id[ids[order]] = counts[order]
    by_id[gru.WORDS - 1] = end_count
    other_tokens, other_words = n - int(by_id.sum()), v - len(order) - (end_count > 0)
    by_id[0] = max(1, other_tokens)
    params, _ = fitted(shards, by_id, most)

    main = cut(rows.mapInArrow(_rows(table, end_count, params), ROWS), "scored")
    listed = main.select("row", F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select("row", F.col("x.hashes").alias("h"), F.col("x.counts").alias("k"))
    met = listed.join(words.where(F.col("c") < least), "h")
    sums = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("more_known"))
    base = np.log10(n + v + 1.0)
    other = np.log10(other_tokens + other_words + 1.0)
    more = F.coalesce("more", F.lit(0.0))
    return main.join(sums, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(base))).alias("base_score"),
        (F.col("model") + F.col("other_logs") + more - F.col("others") * F.lit(float(other))).alias("score"),
    )
