"""Quality scores by a sparse rule ensemble.

Statistics of whole texts are built-in column expressions.  On a bounded sample
of labelled rows, small boosted trees are grown in numpy; every path from a
root to a node is a conjunctive rule; a logistic model with an L1 penalty
weights the rules and drops most; the kept rules are compiled to one Spark
column.  Scoring is a narrow stage without Python, shuffle or model broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenspark.llm.shared import held_out

#: Labelled rows that a fit uses at most, those of the smallest id hashes; trees, their depth, bins of a statistic.
SAMPLE, TREES, DEPTH, BINS = 20_000, 24, 3, 32
#: Penalty on a rule's weight (mean log-loss scale), steps of the fit, and the score from which a text is kept.
LASSO, STEPS, KEEP = 2e-3, 400, 0.3

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Doubles by name; null and empty texts give zeros."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")
    some = F.greatest(chars, F.lit(1.0))

    def part(pattern: str) -> Column:
        return (chars - F.length(F.regexp_replace(t, pattern, ""))) / some

    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    return {
        "chars": chars,
        "words": n_words,
        "word_length": chars / F.greatest(n_words, F.lit(1.0)),
        "upper": part(r"[A-ZÀ-Þ]+"),
        "digit": part(r"[0-9]+"),
        "bang": part(r"[!?]+"),
        "stop": part(r"[.,;:]+"),
        "symbol": part(r"[#$%&*@~^<>{}=+\\_]+"),
        "bar": part(r"\|+"),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1.0)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(n_lines, F.lit(1.0)),
        "line_words": n_words / F.greatest(n_lines, F.lit(1.0)),
    }


def sampled(labels: DataFrame, id_col: str, label_col: str, most: int, folds: int, fold: int) -> DataFrame:
    """At most `most` labelled ids outside the held-out fold, those of the smallest hashes."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    return usable.where(~held_out(F.col("id"), folds, fold)).orderBy(F.xxhash64("id"), "id", "y").limit(most)


def _tree(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, shrink: float, out: np.ndarray, rows: np.ndarray, path: tuple, found: list) -> None:
    """Grows one tree over binned statistics; adds every node's path to found and its leaf values to out."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best, gain = None, 1e-6
    if depth and len(rows) >= 20:
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gs = np.cumsum(np.bincount(b, gradient[rows], BINS + 1))[:-1]
            hs = np.cumsum(np.bincount(b, hessian[rows], BINS + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=BINS + 1))[:-1]
            score = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            score[(ns < 10) | (len(rows) - ns < 10)] = -1
            k = int(score.argmax())
            if score[k] > gain:
                best, gain = (f, k), score[k]
    if best is None:
        out[rows] -= shrink * g / (h + 1)
        return
    f, k = best
    for side, pick in (("<=", bins[rows, f] <= k), (">", bins[rows, f] > k)):
        step = (*path, (f, side, k))
        found.append(step)
        _tree(bins, gradient, hessian, depth - 1, shrink, out, rows[pick], step, found)


def _merged(path: tuple) -> tuple:
    """A path with one bound for each statistic and side."""
    bounds: dict[tuple[int, str], int] = {}
    for f, side, k in path:
        bounds[f, side] = min(k, bounds.get((f, side), k)) if side == "<=" else max(k, bounds.get((f, side), k))
    return tuple(sorted((f, side, k) for (f, side), k in bounds.items()))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]); without both classes, or rows enough to split, the intercept alone, from smoothed counts."""
    n, k = len(y), float(y.sum())
    prior = math.log((k + 1) / (n - k + 1))
    if not 0 < k < n:
        return prior, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    random, margin, paths = np.random.default_rng(seed), np.full(n, prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(random.random(n) < 0.7)
        _tree(bins, p - y, p * (1 - p), DEPTH, 0.3, margin, rows, (), paths)
    rules = sorted({_merged(p) for p in paths})
    if not rules:
        return prior, []
    holds = np.stack([np.logical_and.reduce([(bins[:, f] <= c) if side == "<=" else (bins[:, f] > c) for f, side, c in r]) for r in rules], axis=1)
    _, keep = np.unique(holds, axis=1, return_index=True)  # rules that hold for the same rows count once
    keep = sorted(keep.tolist())
    holds, rules = holds[:, keep].astype(np.float32), [rules[i] for i in keep]
    # accelerated proximal gradient for the L1-penalised logistic loss
    weights = moved = np.zeros(len(rules), np.float32)
    bias, t = prior, 1.0
    rate = 4.0 / max(1e-6, float(np.linalg.norm(holds, 2) ** 2) / n + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(holds @ moved + bias)))
        step = moved - rate * (holds.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * LASSO, 0)
        bias -= rate * float((p - y).mean())
        faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
        moved = new + (t - 1) / faster * (new - weights)
        weights, t = new.astype(np.float32), faster
    named = [tuple((names[f], side, float(cuts[f][c])) for f, side, c in r) for r in rules]
    return bias, [(float(w), r) for w, r in zip(weights, named, strict=True) if abs(w) > 1e-6]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE, folds: int = 5, fold: int = 0):
    """The rule ensemble of the documents' labels; at most `most` labelled rows, none of the held-out fold."""
    chosen = sampled(labels, id_col, label_col, most, folds, fold)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = statistics(F.col("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("y", *[c.alias(k) for k, c in stats.items()]).toPandas()  # `most` rows bound both the broadcast and the result
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return fit(rows[list(stats)].to_numpy(np.float64), rows["y"].to_numpy(np.float64), list(stats))


def compiled(model) -> Column:
    """The ensemble as a column over columns named as the statistics."""
    bias, rules = model
    margin = F.lit(bias)
    for weight, rule in rules:
        holds = None
        for name, side, bound in rule:
            test = F.col(name) <= bound if side == "<=" else F.col(name) > bound
            holds = test if holds is None else holds & test
        margin = margin + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-margin))


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null and empty texts have zeros as statistics and are scored like others;
    null and repeated ids are returned row for row; other columns are not read.
    """
    stats = statistics(F.col("_text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).select("doc_id", *[c.alias(k) for k, c in stats.items()])
    out = rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), compiled(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score KEEP or more, with their columns."""
    stats = statistics(F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("_row"), *[c.alias(k) for k, c in stats.items()])
    return rows.where(compiled(model) >= KEEP).select("_row.*")
