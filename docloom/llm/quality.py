"""Quality: ordinal cumulative-link regression on graded ratings over hashed text features, fitted in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import sampling, textbytes as tb
from docloom.llm.common import lean, ship

U = np.uint64
#: Texts per batch of the fit.
BATCH = 32


def features(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word and each pair of words that follow one another, offsets by text, shape columns by text).

    The shape columns: log of words, distinct share of words, mean length of words, share of bytes that are punctuation, share that are
    digits, lines to words.
    """
    low = tb.LOWER[data]
    starts, ends, own = tb.words(low, at, tb.SPACE)
    h, n = tb.word_hashes(low, starts, ends), np.diff(own)
    pairs, pair_at = tb.shingles(h, own, 2)
    count = n + np.diff(pair_at)
    offsets = np.concatenate([[0], np.cumsum(count)])
    ids = np.empty(offsets[-1], np.int64)
    is_word = np.arange(len(ids)) - np.repeat(offsets[:-1], count) < np.repeat(n, count)
    ids[is_word], ids[~is_word] = (h & U(buckets - 1)).astype(np.int64), (pairs & U(buckets - 1)).astype(np.int64)
    size = np.maximum(np.diff(at), 1)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(own[:-1], own[1:])]) if len(n) else np.zeros(0)
    many = lambda mask: tb.sum_by(mask.astype(np.int64), at)
    shape = np.stack([
        np.log1p(n) / 5, distinct / np.maximum(n, 1), tb.sum_by(ends - starts, own) / np.maximum(n, 1) / 8,
        4 * many(tb.NOT_ALNUM[low] & ~tb.SPACE[low]) / size, 4 * many((low >= 48) & (low <= 57)) / size, 4 * many(low == 10) / np.maximum(n, 1),
    ], 1) if len(n) else np.zeros((0, 6))
    return ids, offsets, shape


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    shape: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def latent(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        for i, j, part, own in tb.pieces(data, at):
            ids, offsets, shape = features(part, own, len(self.weights))
            out[i:j] = tb.sum_by(self.weights[ids], offsets) / np.sqrt(np.maximum(np.diff(offsets), 1)) + shape @ self.shape
        return out

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k: non-increasing along a row, as the thresholds ascend."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -30, 30)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(np.array(self.grades)) if self.grades else np.zeros(len(tails))


def fit(texts: list[str], grades: list[float], buckets: int = 1 << 16, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> OrdinalModel:
    """SGD on the likelihood of P(y <= k) = logistic(threshold_k - w.x); thresholds are the first plus exponentials of gaps, so they stay ordered."""
    rng, values = np.random.default_rng(seed), sorted(set(grades))
    if len(values) < 2:
        return OrdinalModel(values, np.zeros(buckets), np.zeros(6), np.zeros(max(0, len(values) - 1)))
    y, rows = np.array([values.index(g) for g in grades]), []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _, shape = features(raw, np.array([0, len(raw)], np.int64), buckets)
        ids, n = np.unique(ids, return_counts=True)
        rows.append((ids, n / np.sqrt(max(n.sum(), 1)), shape[0]))
    share = np.clip(np.array([(y <= k).mean() for k in range(len(values) - 1)]), 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))
    w, s, sq, ss = np.zeros(buckets), np.zeros(6), np.full(buckets, 1e-3), np.full(6, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            dt, dw, ds = np.zeros(len(theta)), {}, np.zeros(6)
            for i in order[a : a + BATCH]:
                ids, x, shape = rows[i]
                eta = w[ids] @ x + s @ shape
                c = 1 / (1 + np.exp(-np.clip(theta - eta, -30, 30)))
                up, down = (c[y[i]] if y[i] < len(theta) else 1.0), (c[y[i] - 1] if y[i] else 0.0)
                p, du, dd = max(up - down, 1e-9), up * (1 - up), down * (1 - down)
                if y[i] < len(theta):
                    dt[y[i]] -= du / p
                if y[i]:
                    dt[y[i] - 1] += dd / p
                g = (du - dd) / p
                for_ids = g * x
                sq[ids] += for_ids**2
                w[ids] -= rate * (for_ids + decay * w[ids]) / np.sqrt(sq[ids])
                ds += g * shape
            m = min(BATCH, len(y) - a)
            ss += (ds / m) ** 2
            s -= rate * (ds / m) / np.sqrt(ss)
            dt /= m
            first -= rate * dt.sum()
            gaps -= rate * np.array([dt[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
    return OrdinalModel(values, w, s, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def fit_on(docs: DataFrame, ratings: DataFrame, per_grade: int = 1200, **how) -> OrdinalModel:
    """Fits on about per_grade rows of each grade of ratings(doc_id, grade), chosen by a hash of doc_id; the only bound. The thresholds are
    then set for the true shares of the grades by weighting them back: an intercept for each."""
    known = ratings.where("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    sizes = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    chosen = sampling.stratified(known, "grade", F.col("doc_id").cast("string"), per_grade)
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = found.groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min("text").alias("text")).collect()  # at most 2 * per_grade rows a grade
    got.sort(key=lambda r: (str(r["doc_id"]), r["text"]))
    model = fit([r["text"] for r in got], [r["grade"] for r in got], **how)
    drawn = {g: sum(r["grade"] == g for r in got) for g in model.grades}
    total, n = sum(sizes.get(g, 0) for g in model.grades), max(1, len(got))
    for k in range(len(model.thresholds)):
        here, true = sum(drawn[g] for g in model.grades[: k + 1]) / n, sum(sizes[g] for g in model.grades[: k + 1]) / max(1, total)
        logit = lambda p: np.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3)))
        model.thresholds[k] += logit(true) - logit(here)
    model.thresholds = np.maximum.accumulate(model.thresholds)
    return model


def grade(docs: DataFrame, model: OrdinalModel, select_from: int = 1, min_tail: float = 0.5) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, expected_grade, tails array<double> (P(grade > k) for each threshold),
    tail (P of at least the select_from-th grade, counted from 0), kept (tail >= min_tail).

    Null and empty texts have no features: they get the grade of the thresholds alone. Without grades nothing is known: expected 0,
    tail 0. A map over Arrow batches, without a shuffle; repeated rows and ids stay; an empty table gives no rows; other columns are left out.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            tails = m.tails(m.latent(*tb.strings(batch.column("text"))))
            tail = tails[:, select_from - 1] if 0 < select_from <= tails.shape[1] else np.full(len(tails), float(bool(m.grades) and select_from <= 0))
            at = np.arange(len(tails) + 1) * tails.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(m.expected(tails)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tails.ravel())),
                pa.array(tail), pa.array(tail >= min_tail),
            ], ["doc_id", "expected_grade", "tails", "tail", "kept"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, expected_grade double, tails array<double>, tail double, kept boolean")
