"""Backend calls: once a miss, in batches, at a rate, with retries; sentences by way of the memory; learned boundaries."""

import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import memory, sentences

REQUESTS = "request_id string, source_text string, lang_in string, lang_out string, service string, model string"


def requests_of(spark, texts):
    return spark.createDataFrame([(f"r{i}", t, "en", "vi", "s", "m") for i, t in enumerate(texts)], REQUESTS)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "cache_key string, translated_text string, expires_at long")


@pytest.fixture
def counted(tmp_path):
    """A backend that notes each text it is given and the size of each call, in files as workers are processes of their own."""
    folder = str(tmp_path)

    def run(frames, settings):
        for frame in frames:
            with open(f"{folder}/log-{os.getpid()}", "a") as file:
                file.write("\n".join([f"call {len(frame)}", *frame["source_text"]]) + "\n")
            if frame["source_text"].str.contains("boom").any():
                raise RuntimeError("out of order")
            yield pd.DataFrame({"cache_key": frame["cache_key"], "translated_text": "<" + frame["source_text"] + ">"})

    memory.BACKENDS["counted"] = run
    yield lambda: Counter(x for f in os.listdir(folder) if f.startswith("log-") for x in open(f"{folder}/{f}").read().splitlines())
    del memory.BACKENDS["counted"]


def test_once_a_miss_though_both_results_are_written(spark, nothing, counted, tmp_path):
    texts = [f"text {i % 100}" for i in range(250)] + ["", "  ", None]
    rows, new = memory.translate(memory.keyed(requests_of(spark, texts)), nothing, 100, using="counted", calls=memory.Calls(batch=16, tasks=3))
    rows.write.parquet(f"file://{tmp_path}/rows")
    new.write.parquet(f"file://{tmp_path}/new")
    assert rows.count() == 253 and new.count() == 100
    seen = counted()
    sizes = Counter({x: n for x, n in seen.items() if x.startswith("call")})
    assert all(seen[f"text {i}"] == 1 for i in range(100)) and sum(n for x, n in seen.items() if x.startswith("text")) == 100
    assert all(int(x.split()[1]) <= 16 for x in sizes) and sizes["call 16"] >= 3, "calls take whole batches"


def test_failures_are_tried_again_and_told(spark, nothing, counted):
    todo = memory.misses(memory.keyed(requests_of(spark, ["fine", "boom"])), nothing, 0)
    got = {r["tries"]: r for r in memory.call_backend(todo, "counted", calls=memory.Calls(batch=1, retries=2, wait_s=0.01, tasks=1)).collect()}
    assert got[1]["translated_text"] == "<fine>" and got[1]["error"] is None
    assert got[3]["translated_text"] is None and got[3]["error"] == "RuntimeError: out of order"
    assert counted()["boom"] == 3
    rows, new = memory.translate(memory.keyed(requests_of(spark, ["fine", "boom"])), nothing, 0, using="counted", calls=memory.Calls(batch=1, retries=0, tasks=1))
    assert {r["source_text"]: (r["status"], r["translated_text"]) for r in rows.collect()} == {"fine": ("translated", "<fine>"), "boom": ("failed", "boom")}
    assert new.count() == 1


def test_bucket_holds_the_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = memory.Bucket(4.0, clock=lambda: now[0], sleep=sleep)
    at = []
    for _ in range(9):
        bucket.take()
        at.append(now[0])
    assert at == pytest.approx([k / 4 for k in range(9)])
    now[0] += 10
    bucket.take()
    bucket.take()
    assert slept[-1] == pytest.approx(0.25), "idle time is not saved up beyond the burst"
    memory.Bucket(None).take()


def test_sentences_reach_the_memory(spark, nothing, counted):
    split = lambda t: F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: s != "")
    texts = ["One. Two! One.", "Two! Three", "", None, "boom. One."]
    calls = memory.Calls(batch=1, retries=0, tasks=2)
    rows, new = memory.translate_sentences(requests_of(spark, texts), nothing, 100, split, using="counted", calls=calls)
    got = {r["request_id"]: (r["translated_text"], r["n_sentences"], r["n_failed"]) for r in rows.collect()}
    assert got["r0"] == ("<One.>\n<Two!>\n<One.>", 3, 0) and got["r1"] == ("<Two!>\n<Three>", 2, 0)
    assert got["r2"] == ("", 0, 0) and got["r3"] == (None, 0, 0) and got["r4"] == ("boom.\n<One.>", 2, 1)
    assert {r["source_text"] for r in new.collect()} == {"One.", "Two!", "Three"}
    before = counted()
    again, _ = memory.translate_sentences(requests_of(spark, texts[:2]), new, 100, split, using="counted", calls=calls)
    assert {r["request_id"]: r["translated_text"] for r in again.collect()} == {"r0": got["r0"][0], "r1": got["r1"][0]} and counted() == before


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    names, verbs, things = ["Smith", "Jones", "Nguyen", "Miller"], ["sold", "saw", "took", "made"], ["bread", "cars", "ships", "books", "stones"]
    lines = []
    for _ in range(1500):
        a = f"{rng.choice(['Dr.', 'Prof.', 'Mr.'])} {rng.choice(names)} {rng.choice(verbs)} {rng.choice(things)}, {rng.choice(things)}, etc. for {rng.randrange(90)} {rng.choice(['francs in cash', 'cash or francs'])}."
        b = f"{rng.choice(['The', 'However', 'They'])} {rng.choice(things)} were {rng.choice(['old', 'new'])} and {rng.choice(verbs)} by J. {rng.choice(names)}."
        lines.append(f"{a} {b} {rng.choice(['The', 'They'])} {rng.choice(verbs)} {rng.choice(things)}!")
    return sentences.fit(spark.createDataFrame([(x,) for x in [*lines, None, ""]], "text string").repartition(4))


def test_abbreviations_keep_their_sentence(spark, model):
    assert {"dr", "prof", "mr", "etc"} <= model.abbreviations and not {"bread", "smith", "francs", "jones"} & model.abbreviations
    assert {"the", "they"} <= model.starters
    text = 'Dr. Smith took books, etc. for 12 francs. J. Miller saw Prof. Nguyen. "Is it old?" They sold ships, etc. The end came.'
    want = ["Dr. Smith took books, etc. for 12 francs.", "J. Miller saw Prof. Nguyen.", '"Is it old?"', "They sold ships, etc.", "The end came."]
    assert model.split(text) == want
    rows = spark.createDataFrame([(text,), (None,), ("  ",)], "t string").select(sentences.sentences("t", model).alias("s")).collect()
    assert [r["s"] for r in rows] == [want, [], []]


def test_no_texts(spark):
    empty = sentences.fit(spark.createDataFrame([], "text string"))
    assert empty.split("One. Two.") == ["One.", "Two."] and empty.split("") == []


def test_fit_reads_the_texts_once(spark, tmp_path):
    folder = str(tmp_path)

    @F.udf("string")
    def seen(text):
        with open(f"{folder}/log-{os.getpid()}", "a") as file:
            file.write(f"{text[:2]}\n")
        return text

    texts = [f'{i:02} Dr. Smith saw "(them)," etc. and Dr. Jones. The\x1cend, he said!" The rest?' for i in range(40)]
    model = sentences.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4).select(seen.asNondeterministic()("text").alias("text")))
    assert {"dr", "etc"} <= model.abbreviations
    log = Counter(x for f in os.listdir(folder) for x in open(f"{folder}/{f}").read().splitlines())
    assert log == Counter(f"{i:02}" for i in range(40))


def test_words_are_counted_apart_from_their_marks():
    import pyarrow as pa

    texts = ['He saw "Mr." Li, etc., and (Li). "Li!" he\x1csaid?" Why?. A', None, "", "! . x"]
    got = Counter()
    for batch in sentences._counted(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        for r in batch.to_pylist():
            got[r["w"], r["dot"], r["u"], r["hard"]] += r["n"]
    alone = {(w, dot): n for (w, dot, u, _), n in got.items() if u is None}
    assert alone == {("He", False): 1, ("saw", False): 1, ("Mr", True): 1, ("Li", False): 2, ("Li)", True): 1, ("etc", True): 1, ("and", False): 1, ("he\x1csaid", False): 1, ("Why?", True): 1, ("A", False): 1, ("", False): 1, ("", True): 1, ("x", False): 1}
    assert {k for k in got if k[2] is not None and (k[3] or k[1])} == {("Mr", True, "Li", False), ("etc", True, "and", False), ("Li)", True, "Li", False), ("", False, "he\x1csaid", True), ("", False, "Why?", True), ("Why?", True, "A", False), ("", True, "x", False)}


def test_sentences_go_by_key_once(spark):
    """Texts are shuffled once by key and once by request; a sentence that many ask for, failures and requests without one come out whole."""
    texts = [f"Common one. {i} fails. Own {i} text! Common one." for i in range(300)] + ["", None, "  "]
    split = lambda t: F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: s != "")
    entry = requests_of(spark, ["Own 7 text!", "Common one."]).select(memory.memory_key("lang_in", "lang_out", "service", "model", "source_text").alias("cache_key"), F.concat(F.lit("known "), "source_text").alias("translated_text"), (F.when(F.col("source_text").startswith("Own"), 500).otherwise(5)).cast("long").alias("expires_at"))
    rows, new = memory.translate_sentences(requests_of(spark, texts), entry, 100, split, using="marked")
    got = {r["request_id"]: tuple(r)[1:] for r in rows.collect()}
    common = "[vi] Common one."
    assert all(got[f"r{i}"] == ("\n".join([common, f"{i} fails.", "known Own 7 text!" if i == 7 else f"[vi] Own {i} text!", common]), 4, 1) for i in range(300))
    assert got["r300"] == ("", 0, 0) and got["r301"] == (None, 0, 0) and got["r302"] == ("  ", 1, 0) and len(got) == 303
    stored = {r["source_text"]: r for r in new.collect()}
    assert set(stored) == {"Common one.", *(f"Own {i} text!" for i in range(300) if i != 7)}
    assert stored["Common one."]["translated_text"] == common and len(stored["Common one."]["cache_key"]) == 64 and stored["Common one."]["service"] == "s"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, _ = memory.translate_sentences(requests_of(spark, texts), entry, 100, split, using="marked")
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3, "places and repeated sentences by key, texts by request"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
