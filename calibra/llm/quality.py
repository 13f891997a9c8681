"""A quality classifier of naive Bayes support vectors.

Features are hashed indicators of n-grams: words, word pairs, and the same over word shapes (classes of characters).
Each is scaled by the log ratio of its frequency in either class; a linear hinge-loss model over these is fitted by
dual coordinate descent, mixed with the plain ratios, and its margins are mapped to probabilities by a logistic fit
on held-out thirds. The fit takes at most MAX_ROWS labelled rows, those with the least hash of their id, in one task.
Null and empty texts have no features and score as the model's offset does; without labels of both classes every
score is the share of label 1 (0.5 if there are none). Repeated rows score alike; texts are never cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import SMALL_STEP, coded, crc32_text, hashed, lean, mixed, pieces, word_lists

#: Labelled rows of a fit at most; buckets of the feature hash.
MAX_ROWS, DIMS = 6000, 1 << 18
#: How far the weights go from their mean size to the fitted ones.
MIX = 0.75
THRESHOLD = 0.7


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    out = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (document, feature) pairs."""
    words, starts = word_lists(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    distinct, codes = coded(words)
    out = []
    same_doc = doc[1:] == doc[:-1]
    for k, names in enumerate(([w.lower() for w in distinct], [shape(w) for w in distinct])):
        h = hashed(names) if names else np.empty(0, np.uint64)
        h = mixed(h + np.uint64(k))[codes]
        pair = mixed(h[:-1] * np.uint64(31) + h[1:] + np.uint64(7))[same_doc]
        out += [(doc, h), (doc[1:][same_doc], pair)]
    again = same_doc & (codes[1:] == codes[:-1])
    out.append((doc[1:][again], np.full(int(again.sum()), 1, np.uint64)))
    key = np.unique(np.concatenate([d.astype(np.int64) * DIMS + (h % np.uint64(DIMS)).astype(np.int64) for d, h in out]))
    return key // DIMS, key % DIMS


def hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float, epochs: int, seed: int) -> np.ndarray:
    """Weights (the last one an offset) of the L2-regularised hinge loss, by dual coordinate descent."""
    w, alpha, rng = np.zeros(DIMS + 1), np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + w[DIMS]) - 1
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == c and g <= 0):
                continue
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                w[DIMS] += step
                alpha[i] = new
                worst = max(worst, abs(g))
        if worst < 1e-3:
            break
    return w


def _weights(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    count = lambda s: np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == s]), minlength=DIMS) + 1.0
    p, q = count(1), count(-1)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w = hinge(rows, [ratio[r] for r in rows], y, 0.1, 12, 0)
    return np.append(ratio * ((1 - MIX) * np.abs(w[:DIMS]).mean() + MIX * w[:DIMS]), w[DIMS])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """A model from rows of feature numbers and labels 0 or 1."""
    if not len(labels) or labels.min() == labels.max():
        p = float(labels.mean()) if len(labels) else 0.5
        return {"w": None, "p": p}
    y = np.where(labels == 1, 1.0, -1.0)
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(np.unique(y[train])) < 2:
            continue
        w = _weights([rows[i] for i in train], y[train])
        margins[test] = [w[rows[i]].sum() + w[DIMS] for i in test]
    a, b = 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        x, s, e = np.stack([margins, np.ones_like(margins)]), np.maximum(p * (1 - p), 1e-9), p - target
        step = np.linalg.solve((x * s) @ x.T + 1e-6 * np.eye(2), x @ e)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return {"w": _weights(rows, y).astype(np.float32), "a": max(float(a), 1e-6), "b": float(b)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> bytes:
    """Fits on the labelled rows, at most max_rows; one task holds them."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    # at most max_rows ids and labels
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # repeated rows of an id count once (that of the least text), before any of them is sent
    rows = docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, ids = [], [], []
        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                d, f = features(part.column("text"))
                x += np.split(f, np.searchsorted(d, np.arange(1, part.num_rows)))
                y += part.column("label").to_pylist()
                ids += part.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows([x[i] for i in order], np.array([y[i] for i in order], float)))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0].model) if found else pickle.dumps(fit_rows([], np.empty(0)))


@lru_cache(maxsize=2)
def _model(raw: bytes) -> dict:
    return pickle.loads(raw)


def scores(texts: pa.Array, model: dict) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(texts), model["p"])
    d, f = features(texts)
    margin = np.bincount(d, weights=model["w"][f].astype(float), minlength=len(texts)) + float(model["w"][DIMS])
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))


def scored(docs: DataFrame, model: Broadcast) -> DataFrame:
    """docs with a column `score`, which an input column of that name gives way to."""
    names = [c for c in docs.columns if c.lower() != "score"]
    schema = docs.select(*names).schema.add("score", "double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores(part.column("text"), m))], [*names, "score"])

    return docs.select(*names).mapInArrow(run, schema)


def filtered(docs: DataFrame, model: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score as well as the threshold or better, with all their columns."""
    names = docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for batch in batches:
            for part in pieces(batch, "text", SMALL_STEP):
                yield part.filter(pa.array(scores(part.column("text"), m) >= threshold)).select(names)

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    """Rows that a fit never sees."""
    return F.coalesce(crc32_text(column) % 4 == 2, F.lit(False))
