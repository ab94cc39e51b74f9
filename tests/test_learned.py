"""The learned embedding."""

import random

import numpy as np
import pytest

from docloom.operators import learned, retrieval

TOPICS, SYNONYMS = 30, 6


def word(topic, k):
    return f"t{topic}w{k}"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts on a topic use some of its words; a paraphrase of a text has none of that text's words but others of the topic."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        topic = i % TOPICS
        rows.append((f"c{i:05d}", "d", " ".join([word(topic, k) for k in rng.sample(range(SYNONYMS), 3)] + [f"noise{rng.randrange(400)}" for _ in range(4)])))
    rows += [("null", "d", None), ("empty", "d", "  ")]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def paraphrases(spark):
    """A question has two words of its topic; what counts as found is a text of the topic with neither."""
    rows = [(t, f"{word(t, 0)} {word(t, 1)}", None) for t in range(TOPICS)]
    return spark.createDataFrame(rows, "qid int, question string, document_id string")


def found(spark, corpus, paraphrases, model):
    """Of texts that share no word with the question, how many of its nearest 20 are on its topic."""
    texts = {r["chunk_id"]: r["text"] for r in corpus.collect()}
    ask = {r["qid"]: set(r["question"].split()) for r in paraphrases.collect()}
    hit = total = 0
    other = {}
    for r in learned.topk(corpus, paraphrases, model, 400).orderBy("qid", "rank").collect():
        if texts[r["chunk_id"]] and not ask[r["qid"]] & set(texts[r["chunk_id"]].split()):
            other.setdefault(r["qid"], []).append(f"t{r['qid']}w" in texts[r["chunk_id"]])
    for q in ask:
        hit, total = hit + sum(other.get(q, [])[:20]), total + 20
    return hit / total


def test_paraphrases_are_nearer_than_by_hashes(spark, corpus, paraphrases):
    model = learned.fit(corpus, dim=40, n_features=4096)
    got, hashed = found(spark, corpus, paraphrases, model), found(spark, corpus, paraphrases, None)
    assert got > 0.9 and got > hashed + 0.5


def test_seed_decides(spark, corpus):
    one, two = learned.fit(corpus, dim=16, n_features=2048), learned.fit(corpus.repartition(7), dim=16, n_features=2048)
    a, b = (np.array([r["embedding"] for r in learned.embed(corpus, m).orderBy("chunk_id").collect()]) for m in (one, two))
    assert np.abs(a @ a.T - b @ b.T).max() < 1e-5


def test_directions_are_those_of_the_matrix(spark, corpus):
    """Against numpy's decomposition of the whole matrix."""
    model = learned.fit(corpus, dim=8, n_features=512, rounds=12)
    terms = corpus.select(learned.features("text", 512).alias("terms")).where("size(terms) > 0").toArrow()["terms"]
    whole = np.zeros((len(terms), 512))
    for a, _, row, term, w in model.weights(terms):
        whole[a + row, term] = w
    s = np.linalg.svd(whole, compute_uv=False)[:8]
    assert np.allclose(np.linalg.norm(whole @ model.basis, axis=0), s, rtol=1e-2)
    assert np.allclose(model.basis.T @ model.basis, np.eye(8), atol=1e-6)


def test_models_fall_back(spark, corpus, tmp_path):
    model = learned.fit(corpus.limit(200), dim=4, n_features=128, rounds=2)
    path = f"file://{tmp_path}/model"
    assert learned.first_model(spark, [path]) is None
    model.save(spark, path)
    again = learned.first_model(spark, [f"file://{tmp_path}/none", path])
    assert np.array_equal(again.basis, model.basis) and np.array_equal(again.idf, model.idf)
    rows = {r["chunk_id"]: r["embedding"] for r in learned.embed(corpus, again).where("chunk_id IN ('null', 'empty')").collect()}
    assert rows == {"null": [0.0] * 4, "empty": [0.0] * 4}
    hashed = learned.embed(corpus, None).where("chunk_id = 'null'").first()["embedding"]
    assert hashed == [0.0] * retrieval.DIM


def test_no_texts(spark, corpus):
    model = learned.fit(corpus.where("false"), dim=4, n_features=64, rounds=2)
    assert learned.embed(corpus, model).count() == corpus.count()
