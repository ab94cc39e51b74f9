"""Toxicity: a convolutional text classifier over hashed word embeddings, fitted in numpy, with thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import langid, sampling, textbytes as tb
from docloom.llm.common import lean, ship

U = np.uint64
WIDTHS = (1, 2, 3)
#: With fewer rows of either label nothing is learned: every text scores next to 0.
LEAST_ROWS = 4
#: Words whose embeddings a worker holds at once.
SEGMENT = 1 << 17
#: Every language's threshold is moved to this score.
DECIDE = 0.3


#: A word's embedding is the sum of those of the word and of its first bytes: inflected forms share their stem.
STEMS = (4, 6)


def word_ids(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word (letters and digits, lower case) and of its stems, a row for each; the word offsets of each text."""
    data = tb.LOWER[data]
    starts, ends, own = tb.words(data, at, tb.NOT_ALNUM)
    hashes = [tb.word_hashes(data, starts, ends), *(tb.mix(tb.word_hashes(data, starts, np.minimum(ends, starts + k)) + U(k)) for k in STEMS)]
    return (np.stack(hashes) & U(buckets - 1)).astype(np.int64), own


def pooled(feature: np.ndarray, n: np.ndarray, at: np.ndarray, width: int, floor: float = 0.0) -> np.ndarray:
    """Max over the windows of each text; feature has a row for each word, those whose window leaves the text are not seen. Texts of
    fewer words have floor, the value of a rectified filter that finds nothing."""
    out = np.full((len(n), feature.shape[1]), floor, feature.dtype)
    inside = np.arange(len(feature)) + width <= np.repeat(at[1:], n)
    rows = feature[inside]
    count = np.maximum(n - width + 1, 0)
    full = np.flatnonzero(count)
    if len(full):
        first = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        out[full] = np.maximum.reduceat(rows, first, axis=0)
    return np.maximum(out, floor)


def embedded(E: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.take(E, ids[0], axis=0)
    for more in ids[1:]:
        out += np.take(E, more, axis=0)
    return out


def convolved(X: np.ndarray, kernel: np.ndarray, offset: np.ndarray) -> np.ndarray:
    f = X @ kernel[0]
    for j in range(1, min(len(kernel), len(X))):
        f[: len(f) - j] += X[j:] @ kernel[j]
    f += offset
    return f


@dataclass
class ToxicModel:
    embeddings: np.ndarray
    kernels: dict[int, np.ndarray]  # by width: place in window x dimensions x filters
    offsets: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float
    thresholds: np.ndarray  # raw score at which a text of each language (the last: unknown) is toxic
    languages: langid.LangModel

    def raw(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        ids, own = word_ids(data, at, len(self.embeddings))
        maxima = np.zeros((len(at) - 1, len(WIDTHS) * len(self.offsets[WIDTHS[0]])), np.float32)
        for a in range(0, ids.shape[1], SEGMENT):  # windows run on behind a segment's end
            here = np.clip(own - a, 0, SEGMENT + max(WIDTHS) - 1)
            n, X = np.diff(here), embedded(self.embeddings, ids[:, a : a + SEGMENT + max(WIDTHS) - 1])
            np.maximum(maxima, np.concatenate([pooled(convolved(X, self.kernels[w], self.offsets[w]), n, here, w) for w in WIDTHS], 1), out=maxima)
        return maxima.astype(np.float64) @ self.weights + self.bias

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        for i, j, part, own in tb.pieces(data, at):
            z, lang = self.raw(part, own), np.full(j - i, len(self.thresholds) - 1)
            if len(self.languages.classes):
                best, p = self.languages.predict(part, own)
                lang = np.where(p >= self.languages.reject_below, best, lang)
            out[i:j] = 1 / (1 + np.exp(-np.clip(self.slope * (z - self.thresholds[lang]) + np.log(DECIDE / (1 - DECIDE)), -30, 30)))
        return out


def best_threshold(z: np.ndarray, y: np.ndarray, weight: float, default: float, least: int = 8) -> float:
    """The raw score with the best F1, midway to the next, rows of label 0 counting ``weight`` times; default with fewer than least of either kind."""
    if y.sum() < least or (1 - y).sum() < least:
        return default
    order = np.argsort(-z)
    hit, false = np.cumsum(y[order]), weight * np.cumsum(1 - y[order])
    k = int(np.argmax(2 * hit / (hit + false + y.sum())))
    return float((z[order][k] + z[order][min(k + 1, len(z) - 1)]) / 2)


def fit(texts: list[str], y: np.ndarray, langs: list[str | None], buckets: int = 1 << 15, dim: int = 12, filters: int = 6, epochs: int = 14, updates: int = 1000, seed: int = 7, share: float | None = None) -> ToxicModel:
    """Adam over mini-batches; max pooling sends a gradient to one window of each text and filter; at least epochs, and about updates steps. A quarter is held back for slope
    and thresholds. share: the true share of label 1, to which the held-back rows are weighted."""
    rng = np.random.default_rng(seed)
    rows = [word_ids(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())], np.int64), buckets)[0] for t in texts]
    order = rng.permutation(len(y))
    cut = len(y) // 4
    held, train = order[:cut], order[cut:]
    E = rng.normal(0, 0.3, (buckets, dim)).astype(np.float32)
    K = {w: rng.normal(0, 0.5 / w, (w, dim, filters)).astype(np.float32) for w in WIDTHS}
    o = {w: np.zeros(filters, np.float32) for w in WIDTHS}
    v, b = rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32), 0.0
    params = {"v": v, **{f"K{w}": K[w] for w in WIDTHS}, **{f"o{w}": o[w] for w in WIDTHS}}
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in params.items()}
    seen, t = np.zeros(buckets, np.float32), 0
    rate = 0.01
    # Both labels weigh the same in all; few rows are gone through more often.
    balance = np.where(y > 0, 0.5 / max(y[train].mean(), 1e-6), 0.5 / max(1 - y[train].mean(), 1e-6)).astype(np.float32) if len(train) else y
    enough = min(y.sum(), (1 - y).sum()) >= LEAST_ROWS
    for epoch in range(int(np.clip(updates * 32 / len(train), epochs, 10 * epochs)) if len(train) and enough else 0):
        train = rng.permutation(train)
        for first in range(0, len(train), 32):
            batch = train[first : first + 32]
            ids = np.concatenate([rows[i] for i in batch], 1)
            n = np.array([rows[i].shape[1] for i in batch])
            at = np.concatenate([[0], np.cumsum(n)])
            X, tops, places = embedded(E, ids), [], []
            for w in WIDTHS:
                f = convolved(X, K[w], o[w])
                top = pooled(f, n, at, w)
                place = np.full(top.shape, -1)
                for d in range(len(batch)):
                    if n[d] >= w:
                        place[d] = at[d] + f[at[d] : at[d + 1] - w + 1].argmax(0)
                place[top <= 0] = -1
                tops.append(top)
                places.append(place)
            H = np.concatenate(tops, 1)
            g = (1 / (1 + np.exp(-np.clip(H @ v + b, -30, 30))) - y[batch]).astype(np.float32) * balance[batch] / len(batch)
            grads = {"v": H.T @ g + 1e-4 * v}
            b -= rate * 10 * float(g.sum())
            dH, touched = np.outer(g, v), []
            for m, w in enumerate(WIDTHS):
                d, f = np.nonzero(places[m] >= 0)
                p, up = places[m][d, f], dH[d, m * filters + f]
                grads[f"o{w}"] = np.bincount(f, up, filters).astype(np.float32)
                dK = np.zeros_like(K[w])
                for j in range(w):
                    np.add.at(dK[j].T, f, up[:, None] * X[p + j])
                    change = up[:, None] * K[w][j][:, f].T
                    touched.extend((row[p + j], change) for row in ids)
                grads[f"K{w}"] = dK
            t += 1
            for k, x in params.items():
                m1, m2 = state[k]
                m1 *= 0.9
                m1 += 0.1 * grads[k]
                m2 *= 0.999
                m2 += 0.001 * grads[k] ** 2
                x -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
            where, what = np.concatenate([a for a, _ in touched]), np.concatenate([a for _, a in touched])
            if len(where):
                u, back = np.unique(where, return_inverse=True)
                G = np.zeros((len(u), dim), np.float32)
                np.add.at(G, back, what)
                seen[u] += (G**2).mean(1)
                E[u] -= 0.05 * G / (np.sqrt(seen[u]) + 1e-6)[:, None]
    if not enough:
        return ToxicModel(E, K, o, v.astype(np.float64), float(b), 1.0, np.full(1, np.inf), langid.fit([], []))
    langs_ok = [(x, g) for x, g in zip(texts, langs) if g is not None]
    languages = langid.fit([x for x, _ in langs_ok], [g for _, g in langs_ok], epochs=6)
    model = ToxicModel(E, K, o, v.astype(np.float64), float(b), 1.0, np.zeros(len(languages.classes) + 1), languages)
    use = held if len(held) else order
    if not len(use):
        return model
    raw = [texts[i].encode() for i in use]
    z = model.raw(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    target = y[use].astype(np.float64)
    true = float(np.clip(share if share else target.mean(), 1e-6, 1 - 1e-6))
    # Rows of label 0 count as often as in the whole; with too few of label 1 to tell, no such row is to reach the threshold.
    zeros = (1 - true) / true * target.sum() / max((1 - target).sum(), 1)
    clean = z[target == 0]
    everywhere = best_threshold(z, target, zeros, float(clean.max() + 0.5 * clean.std() + 1e-6) if len(clean) else float(z.min()))
    known = np.array([languages.classes.index(langs[i]) if langs[i] in languages.classes else -1 for i in use])
    model.thresholds[:] = everywhere
    for k in range(len(languages.classes)):
        own = best_threshold(z[known == k], target[known == k], zeros, everywhere)
        n = target[known == k].sum()
        model.thresholds[k] = (n * own + 20 * everywhere) / (n + 20)  # drawn to the common one where a language has few
    weight = np.where(target > 0, 1.0, zeros)
    shift, loss = np.log(DECIDE / (1 - DECIDE)), []
    for slope in np.geomspace(0.1, 10, 30):
        q = 1 / (1 + np.exp(-np.clip(slope * (z - everywhere) + shift, -30, 30)))
        loss.append((float(-(weight * (target * np.log(q + 1e-12) + (1 - target) * np.log(1 - q + 1e-12))).mean()), slope))
    model.slope = float(min(loss)[1])
    return model


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = 2000, **how) -> ToxicModel:
    """Fits on about per_class rows of each value of labels(doc_id, toxic), chosen by a hash of doc_id before their texts are fetched;
    the only bound. docs(doc_id, text, lang)."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = sampling.stratified(known, "toxic", F.col("doc_id").cast("string"), per_class)
    found = docs.where("text IS NOT NULL").select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    got = found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("t")).select("doc_id", "toxic", "t.*").collect()  # at most 4 * per_class rows
    got.sort(key=lambda r: (str(r["doc_id"]), r["text"]))
    return fit([r["text"] for r in got], np.array([r["toxic"] for r in got], np.float32), [r["lang"] for r in got], share=share, **how)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, score.

    At DECIDE a text reaches the threshold of the language that its text shows. Null and empty texts have no word, so no filter
    fires: they get the score of that. A map over Arrow batches, without a shuffle; repeated rows and ids stay; an empty table gives
    no rows; other columns are left out.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(*tb.strings(batch.column("text"))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: ToxicModel, reject_from: float = DECIDE) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose text scores under reject_from; null and empty texts as in ``score``, repeated
    rows alike; an empty table gives no rows. A map, without a shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(*tb.strings(batch.column("text"))) < reject_from))

    return docs.mapInArrow(lean(run), docs.schema)
