"""The classifiers' forward passes against plain Python, text by text; and long texts in segments."""

import math
import re

import numpy as np
import pytest

from docloom.llm import langid, quality, textbytes, toxicity

M = (1 << 64) - 1
TEXTS = ["", " ", "a", "Ab", "naïve Words, and\tmore words\nwords!", "x" * 50, "日本 语 É", "one two three four five six seven eight 9 10", "the the the"]


def arrow(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def word_hash(word: bytes):
    inverse, scale, total = pow(0x9E3779B97F4A7C15, -1, 1 << 64), 1, 0
    for b in word:
        total = (total + (b + 1) * scale) & M
        scale = scale * inverse & M
    return mixed(total)


def words(t, separators):
    return re.findall(b"[^" + separators + b"]+", low(t).encode())


SPACE = rb"\x20\x09-\x0D"
NOT_ALNUM = rb"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def language(model, t):
    b = [32 if x in b" \t\n\x0b\x0c\r" else x for x in low(t).encode()]
    bits, total, n = (len(model.table) - 1).bit_length() - 1, np.zeros(len(model.classes)), 0
    for g in langid.GRAMS:
        for i in range(len(b) - g + 1):
            h = g
            for x in b[i : i + g]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
            total += model.table[(h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)]
            n += 1
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return p / p.sum()


@pytest.fixture(scope="module")
def languages():
    return langid.fit(["the cat and the dog are here", "der hund und die katze sind da", "le chat et le chien sont la"] * 8, ["en", "de", "fr"] * 8, buckets=1 << 10)


def test_languages(languages):
    best, p = languages.predict(*arrow(TEXTS))
    for k, t in enumerate(TEXTS):
        want = language(languages, t)
        assert p[k] == pytest.approx(want.max(), abs=1e-5) and want[best[k]] == pytest.approx(want.max(), abs=1e-5)


def test_toxicity():
    texts = ["you idiot go away now please", "nice day to you my friend here"] * 20
    model = toxicity.fit(texts, np.array([1, 0] * 20, np.float32), ["en", "fr"] * 20, buckets=1 << 10, updates=60)
    got = model.score(*arrow(TEXTS + texts[:2]))
    for t, s in zip(TEXTS + texts[:2], got):
        rows = []
        for w in words(t, NOT_ALNUM):
            ids = [word_hash(w), *(mixed((word_hash(w[:k]) + k) & M) for k in toxicity.STEMS)]
            rows.append(sum(model.embeddings[i & (len(model.embeddings) - 1)] for i in ids))
        maxima = []
        for width in toxicity.WIDTHS:
            seen = [sum(rows[i + j] @ model.kernels[width][j] for j in range(width)) + model.offsets[width] for i in range(len(rows) - width + 1)]
            maxima.append(np.maximum(np.max(seen, 0), 0) if seen else np.zeros(len(model.offsets[width])))
        z = np.concatenate(maxima) @ model.weights + model.bias
        p = language(model.languages, t)
        at = int(p.argmax()) if p.max() >= model.languages.reject_below else len(model.thresholds) - 1
        assert s == pytest.approx(sigmoid(model.slope * (z - model.thresholds[at]) + math.log(toxicity.DECIDE / (1 - toxicity.DECIDE))), abs=1e-4), t
    assert got[-2] >= toxicity.DECIDE > got[-1]


def test_quality():
    texts = ["low bad words here", "middle words are here", "top fine words, 9 of them"] * 12
    model = quality.fit(texts, [1.0, 2.0, 5.0] * 12, buckets=1 << 10)
    tails = model.tails(model.latent(*arrow(TEXTS)))
    expected = model.expected(tails)
    for k, t in enumerate(TEXTS):
        h = [word_hash(w) for w in words(t, SPACE)]
        pairs = [mixed((mixed((2 * 0xD6E8FEB86659FD93 + a) & M) * 0xD6E8FEB86659FD93 + b) & M) for a, b in zip(h, h[1:])]
        if len(h) == 1:
            pairs = [mixed((0xD6E8FEB86659FD93 + h[0]) & M)]
        ids = [x & (len(model.weights) - 1) for x in h + pairs]
        b, n = low(t).encode(), len(h)
        count = lambda f: sum(map(f, b))
        blank, digit = (lambda x: x in b" \t\n\x0b\x0c\r"), (lambda x: 48 <= x <= 57)
        mark = lambda x: x < 128 and not digit(x) and not 97 <= x <= 122 and not blank(x)
        shape = [
            math.log1p(n) / 5, len(set(h)) / max(n, 1), sum(len(w) for w in words(t, SPACE)) / max(n, 1) / 8, 4 * count(mark) / max(len(b), 1), 4 * count(digit) / max(len(b), 1),
            4 * b.count(10) / max(n, 1),
        ]
        eta = sum(model.weights[i] for i in ids) / math.sqrt(max(len(ids), 1)) + np.dot(shape, model.shape)
        want = [sigmoid(eta - c) for c in model.thresholds]
        assert tails[k] == pytest.approx(want, abs=1e-9)
        assert expected[k] == pytest.approx(1.0 + want[0] * 1.0 + want[1] * 3.0, abs=1e-9)


def test_segments_change_nothing(languages, monkeypatch):
    """A long text is taken in segments of bytes or words; what it gives is that of the whole."""
    rng = np.random.default_rng(0)
    long = " ".join("".join(rng.choice(list("abcdef"), rng.integers(1, 9))) for _ in range(400))
    data, at = arrow([*TEXTS, long])
    model = toxicity.fit(["you idiot go away", "nice day to you"] * 20, np.array([1, 0] * 20, np.float32), ["en"] * 40, updates=30)
    starts, ends, _ = textbytes.words(data, at, textbytes.SPACE)
    whole = textbytes.word_hashes(data, starts, ends), languages.logits(data, at), model.raw(data, at)
    monkeypatch.setattr(textbytes, "_POWERS", [])
    monkeypatch.setattr(textbytes, "SEGMENT", 37)
    monkeypatch.setattr(toxicity, "SEGMENT", 11)
    assert (textbytes.word_hashes(data, starts, ends) == whole[0]).all()
    assert np.allclose(languages.logits(data, at), whole[1]) and np.allclose(model.raw(data, at), whole[2])
    assert len(textbytes._POWERS[0]) == 38
