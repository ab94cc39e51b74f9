"""Language identification: averaged hashed subword embeddings and a linear softmax, fitted by SGD in numpy."""

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
#: Subwords are runs of these many bytes, spaces included, in lower case.
GRAMS = (2, 3, 4)


def subwords(data: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: bucket of the subword at every byte (``buckets`` where it would leave its text), and how many each text has."""
    data = np.where(tb.SPACE[data], np.uint8(32), tb.LOWER[data]).astype(np.uint32)
    n, length = len(data), np.diff(at)
    left = np.repeat(at[1:], length) - np.arange(n)
    for g in GRAMS:
        h = np.full(n, g, np.uint32)
        for j in range(g):
            h *= np.uint32(0x01000193)
            h[: n - j] ^= data[j:]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - int(buckets).bit_length() + 1)
        h[left < g] = buckets
        yield h, np.maximum(length - g + 1, 0)


@dataclass
class LangModel:
    classes: list[str]
    table: np.ndarray  # (buckets + 1, classes): embedding times weights, the last row 0
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, count, buckets = np.zeros((len(at) - 1, len(self.classes))), np.zeros(len(at) - 1), len(self.table) - 1
        for g in GRAMS:
            count += np.maximum(np.diff(at) - g + 1, 0)
        for a in range(0, len(data), tb.SEGMENT):  # a longer text than a segment comes alone; its subwords run on behind a segment's end
            b = min(len(data), a + tb.SEGMENT)
            more = min(len(data), b + max(GRAMS) - 1)
            own = np.clip(at - a, 0, more - a)
            for h, _ in subwords(data[a:more], own, buckets):
                total += tb.sum_by(np.take(self.table, h[: b - a], axis=0), np.minimum(own, b - a))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, calibrated probability) of each text."""
        best, p = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
        for i, j, part, own in tb.pieces(data, at):
            z = self.logits(part, own) / self.temperature
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            best[i:j], p[i:j] = z.argmax(1), z.max(1)
        return best, p


def fit(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 12, rate: float = 0.5, reject_share: float = 0.01, seed: int = 3) -> LangModel:
    """SGD over whole texts, in a new order each epoch; a fifth is held back for the temperature and for reject_below, the probability under which
    reject_share of those rightly predicted fall. Without any label there are no classes."""
    rng, classes = np.random.default_rng(seed), sorted(set(labels))
    if not classes:
        return LangModel([], np.zeros((buckets + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    y, bags = np.array([classes.index(x) for x in labels]), []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        at = np.array([0, len(raw)], np.int64)
        ids = np.concatenate([h[h < buckets] for h, _ in subwords(raw, at, buckets)]) if len(raw) else np.zeros(0, np.uint32)
        ids, n = np.unique(ids, return_counts=True)
        bags.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5) if len(y) > 4 * len(classes) else 0
    held, train = order[:cut], order[cut:]
    E = rng.normal(0, 0.1, (buckets + 1, dim)).astype(np.float32)
    W, b = rng.normal(0, 0.1, (dim, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.01
        train = rng.permutation(train)
        for first in range(0, len(train), 16):
            batch = train[first : first + 16]
            H = np.stack([bags[i][1] @ E[bags[i][0]] for i in batch])
            z = H @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            G = p @ W.T
            W -= step * H.T @ p
            b -= step * p.mean(0)
            for i, g in zip(batch, G):
                E[bags[i][0]] -= (20 * step * bags[i][1])[:, None] * g
    table = (E @ W).astype(np.float32)
    table[-1] = 0
    model = LangModel(classes, table, b.astype(np.float64), 1.0, 0.0)
    z = np.stack([bags[i][1] @ table[bags[i][0]] + b for i in (held if cut else train)])
    target, best = y[held if cut else train], (np.inf, 1.0)
    for temperature in np.geomspace(0.05, 8, 40):
        q = z / temperature
        q = q - q.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), target]))
        best = min(best, (loss, float(temperature)))
    model.temperature = best[1]
    q = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    q /= q.sum(1, keepdims=True)
    right = q.max(1)[q.argmax(1) == target]
    model.reject_below = float(np.quantile(right, reject_share)) if len(right) else 1.0
    return model


def fit_on(rows: DataFrame, per_class: int = 500, **how) -> LangModel:
    """Fits on about per_class rows(doc_id, text, lang) of each language, chosen by a hash of doc_id and text; the only bound."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    got = sampling.stratified(known, "lang", F.concat_ws(" ", F.col("doc_id").cast("string"), F.md5("text")), per_class).collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["text"]))
    return fit([r["text"] for r in got], [r["lang"] for r in got], **how)


def identify(docs: DataFrame, model: LangModel, reject: bool = True) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, lang_pred, score, accepted.

    ``und`` with score 0 where text is null or has no letter; with reject also where score is under the model's reject_below.
    accepted says whether the score reaches it, either way. A map over Arrow batches, without a shuffle; repeated rows and
    ids stay; an empty table gives no rows; other columns are left out.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.classes, "und"], dtype=object)
        for batch in batches:
            best, p = m.predict(*tb.strings(batch.column("text"))) if m.classes else (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows))
            none = ~np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool) | (not m.classes)
            p = np.where(none, 0.0, p)
            ok = ~none & (p >= m.reject_below)
            best = np.where(none | (~ok & reject), len(m.classes), best)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(p), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(lean(run), schema)
