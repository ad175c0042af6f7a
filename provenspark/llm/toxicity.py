"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are a document's words, bare and as written, and word beginnings, as
64-bit hashes with counts.  Severity is ordered: 0 for documents labelled not
toxic; toxic ones get 1 to ``GRADES`` by quantiles of the density of words that
the labels mark (smoothed log odds).  One weight vector serves every threshold:
P(grade <= k) = sigmoid(theta_k - w.x), and the expected severity is the sum
over k of P(grade > k).  Scoring is a narrow stage: hashes are searched among
the kept features, whole texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenspark.llm.shared import held_out, numbers
from provenspark.llm.words import U64, slices, word_hashes

#: Labelled rows of each class that a fit uses at most, those of the smallest id hashes.
SAMPLE = 3_000
#: Word forms (0: without punctuation at the end; else beginnings in bytes), documents of the sample a kept feature is in at least, its deviation from the sample's share at least, grades above 0.
PREFIXES, LEAST, DEVIATION, GRADES = (0, 4, 5, 6, 7), 6, 4.5, 3
EPOCHS, RATE, L2, TOXIC = 60, 0.5, 1e-5, 0.25
#: Bits that tell most hashes apart from the kept ones before they are searched.
TABLE = 1 << 20


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, counts, words) of each text."""
    hashes, first = word_hashes(column, prefixes=PREFIXES)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h, c = np.unique(hashes[:, lo:hi], return_counts=True)
        yield h, c, hi - lo


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents by feature, summed for each slice."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        toxic = batch.column("y").to_numpy()
        lists = [h for h, _, _ in features(batch.column("text"))]
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        seen = np.bincount(at, minlength=len(keys))
        bad = np.bincount(at, np.repeat(toxic, [len(x) for x in lists]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(seen), pa.array(bad)], names=["h", "seen", "bad"])


def _gather(kept: np.ndarray):
    """Each document's kept features (sorted hashes) and their counts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            h, c, n = [], [], []
            for hashes, counts, words in features(batch.column("text")):
                own = np.isin(hashes, kept)
                h.append(hashes[own].tobytes())
                c.append(counts[own].astype(np.int64).tobytes())
                n.append(words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(h, pa.binary()), pa.array(c, pa.binary()), pa.array(n, pa.int64())], names=["id", "y", "h", "c", "n"])

    return run


def values(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature's value: its log count, and more where it is a large part of the text."""
    return np.log1p(counts) + 50.0 * counts / (words + 50.0)


class Model:
    """Kept features' sorted hashes and weights, and the thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.weights, self.theta = keys[order], weights[order], theta
        self.maybe = np.zeros(TABLE, bool)  # most features fail here, before the search
        self.maybe[(self.keys & U64(TABLE - 1)).astype(np.int64)] = True

    def margins(self, column: pa.Array) -> np.ndarray:
        hashes, first = word_hashes(column, prefixes=PREFIXES)
        n = len(first) - 1
        words = np.diff(first)
        if not len(self.keys) or not hashes.size:
            return np.zeros(n)
        doc = np.broadcast_to(np.repeat(np.arange(n), words), hashes.shape)
        likely = self.maybe[(hashes & U64(TABLE - 1)).astype(np.int64)]
        hashes, doc = hashes[likely], doc[likely].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        pair, count = np.unique((doc[hit] << 32) | at[hit], return_counts=True)
        own, feature = pair >> 32, pair & 0xFFFFFFFF
        return np.bincount(own, self.weights[feature] * values(count, words[own]), n)

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - margins[:, None], -60, 60)))


def grades(toxic: np.ndarray, lists: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """0 for label 0; 1 to GRADES for label 1 by quantiles of the density of marked words."""
    out = toxic.astype(np.int64)
    if not 0 < out.sum() < len(out):
        return out
    keys, at = np.unique(np.concatenate(lists), return_inverse=True)
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    bad = np.bincount(at, toxic[who], len(keys))
    seen = np.bincount(at, minlength=len(keys))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((seen - bad + 0.5) / ((1 - toxic).sum() + 1))
    marked = (odds > 2.5) & (seen >= LEAST)
    density = np.bincount(who, np.concatenate(counts) * marked[at], len(lists)) / (words + 20.0)
    own = density[toxic == 1]
    out[toxic == 1] = 1 + np.searchsorted(np.quantile(own, np.arange(1, GRADES) / GRADES), own, "left")
    return out


def fit(lists: list[np.ndarray], counts: list[np.ndarray], words: np.ndarray, grade: np.ndarray, share: float, seed: int = 11) -> Model:
    """Stochastic gradient descent with a rate per feature; share: of toxic documents among all labelled ones, for the first threshold."""
    none = np.zeros(0, U64)
    if not 0 < (grade > 0).sum() < len(grade):
        p = np.clip(((grade > 0).sum() + 1) / (len(grade) + 2), 1e-3, 1 - 1e-3)
        return Model(none, np.zeros(0), np.log((1 - p) / p) + np.arange(GRADES) * 2.0)
    keys, at = np.unique(np.concatenate(lists), return_inverse=True)
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flag = (grade > 0).astype(float)
    seen, bad = np.bincount(at, minlength=len(keys)), np.bincount(at, flag[who], len(keys))
    # the features whose documents differ most from the sample's share
    z = np.where(seen >= LEAST, np.abs(bad - seen * flag.mean()) / np.sqrt(seen * flag.mean() * (1 - flag.mean()) + 1e-9), -1)
    keep = np.flatnonzero(z >= DEVIATION)
    place = np.full(len(keys), -1)
    place[keep] = np.arange(len(keep))
    feature = place[at]
    used = feature >= 0
    who, feature = who[used], feature[used]
    value = values(np.concatenate(counts)[used].astype(float), words[who])
    start = np.searchsorted(who, np.arange(len(lists) + 1))
    w, g2 = np.zeros(len(keep)), np.full(len(keep), 1e-6)
    theta, t2 = np.arange(GRADES) * 1.0, np.full(GRADES, 1e-6)
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = random.permutation(len(lists))
        for lo in range(0, len(order), 32):
            docs = order[lo : lo + 32]
            index = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), start[docs + 1] - start[docs])
            f, v = feature[index], value[index]
            margin = np.bincount(own, w[f] * v, len(docs))
            upper = np.concatenate([theta, [np.inf]])
            lower = np.concatenate([[-np.inf], theta])
            y = grade[docs]
            sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
            hi, low = sigmoid(upper[y] - margin), sigmoid(lower[y] - margin)
            dense = np.maximum(hi - low, 1e-9)
            dh, dl = hi * (1 - hi) / dense, low * (1 - low) / dense
            slope = dh - dl  # of -log P(y) by the margin
            grad = np.bincount(f, slope[own] * v, len(w)) / len(docs) + L2 * w
            touched = np.unique(f)
            g2[touched] += grad[touched] ** 2
            w[touched] -= RATE * grad[touched] / np.sqrt(g2[touched])
            gt = np.zeros(GRADES)
            np.add.at(gt, np.minimum(y, GRADES - 1), np.where(y < GRADES, -dh, 0))
            np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, dl, 0))
            gt /= len(docs)
            t2 += gt**2
            theta = np.maximum.accumulate(theta - 0.1 * gt / np.sqrt(t2) + np.arange(GRADES) * 1e-6)
    sample = flag.mean()
    shift = np.log(sample / (1 - sample)) - np.log(share / (1 - share))  # the sample holds more toxic documents than the labels do
    return Model(keys[keep], w, theta + 0.5 * max(0.0, shift))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE, folds: int = 5, fold: int = 0) -> Model:
    """The model of the documents' labels; at most `most` rows of each class, none of the held-out fold."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id"), folds, fold))
    n, k = usable.agg(F.count("*"), F.sum("y")).first()
    pick = [usable.where(f"y = {c}").orderBy(F.xxhash64("id"), "id").limit(most) for c in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = pick[0].unionByName(pick[1])
    sample = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")  # two times `most` rows
    share = min(0.999, max(0.001, (k or 0) / n)) if n else 0.5
    p = min(k or 0, most) / max(1, min(k or 0, most) + min(n - (k or 0), most))
    far = F.abs(F.col("bad") - F.col("seen") * p) / F.sqrt(F.col("seen") * p * (1 - p) + 1e-9)
    tally = sample.mapInArrow(_tally, "h long, seen long, bad long").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    kept = numbers(tally.where((F.col("seen") >= LEAST) & (far >= DEVIATION)).select("h"))[0]  # features of a sample of two times `most` rows
    rows = sample.mapInArrow(_gather(np.sort(kept.view(U64))), "id long, y int, h binary, c binary, n long").toPandas()
    rows = rows.sort_values(["id", "y", "n"], kind="stable")
    lists = [np.frombuffer(b, U64) for b in rows["h"]]
    counts = [np.frombuffer(b, np.int64) for b in rows["c"]]
    toxic, words = rows["y"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    return fit(lists, counts, words, grades(toxic, lists, counts, words), share)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                above = model.above(model.margins(batch.column("text")))
                exact = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array((above[:, 0] >= TOXIC).astype(np.int32))],
                    names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
                )

    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for every row: expected severity, likeliest grade, P(grade > 0), flag.

    Null and empty texts have no feature and get the thresholds' grades; null
    and repeated ids are returned row for row; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, severity double, grade int, p_toxic double, toxic int")
