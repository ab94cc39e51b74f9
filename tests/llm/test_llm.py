"""Training-data operators against brute force on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import common, decontam, langid, linededup, minhash, mixing, pivots, quality, queries, rangecoder, sharding, textbytes, tokenio, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)] + ["É", "naïve", "日本", "Ab"]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(int(rng.integers(1, 60))) for _ in range(40)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base[:15]]
    texts = [*base, *near, *base[:5], None, "", "  \t\n", "one", "One", "one two", text(5000), "a\nb\n\na\nb c d e f\nB c d e f", "x" * 3000, "  　"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, "null id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).withColumns({"size": F.lit("clash"), "k": F.lit(1), "id": F.lit(2), "shard": F.lit(3), "score": F.lit(4)}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# Mixing


def fill(sizes, weights, total, cap=3.0):
    clamped = set()
    while True:
        rest = total - sum(cap * sizes[s] for s in clamped)
        live = {s: w for s, w in weights.items() if s not in clamped and w}
        level = rest / sum(live.values()) if live else 0
        more = {s for s, w in live.items() if w * level > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in clamped else weights[s] * level for s in sizes}
        clamped |= more


def test_mix(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for _, t, _, s, _ in odd_rows():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = fill(sizes, {s: float(1 + i % 3) for i, s in enumerate(order)}, sum(sizes.values()))
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect())), "reruns agree"


def test_mix_of_repeated_rows(spark, tmp_path):
    """Rows that repeat one id and text, over whatever number of parts: as many are taken as come nearest to the target."""
    rows = [(7, "seven words are in this one text", "en", "a", 1)] * 1000 + [(None, "no id", None, "b", 1)] * 500 + [(i, f"x{i} y", "en", "c", 1) for i in range(900)]
    taken = set()
    for parts in (3, 7, 11):
        docs = spark.createDataFrame(rows, DOCS).repartition(parts)
        got = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).orderBy("source").collect()
        assert all(abs(r["taken"] - r["target"]) <= r["size"] for r in got)
        taken.add(tuple(r["taken"] for r in got))
        docs.write.parquet(f"file://{tmp_path}/{parts}")
        mixed = mixing.mixed_documents(spark.read.parquet(f"file://{tmp_path}/{parts}"))
        words = mixed.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).orderBy("source").collect()
        assert all(abs(w["n"] - r["target"]) <= r["size"] for w, r in zip(words, got))
    assert len(taken) == 1


def test_rows_without_an_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (5,)], "doc_id long").select("doc_id", queries.held_out("doc_id", 3, 1)).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 5)), min_size=1, max_size=8))
def test_water_fill(spark, rows):
    df = spark.createDataFrame([(f"s{i}", a, float(w)) for i, (a, w) in enumerate(rows)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    sizes, weights = {f"s{i}": a for i, (a, _) in enumerate(rows)}, {f"s{i}": float(w) for i, (_, w) in enumerate(rows)}
    want = fill(sizes, weights, sum(sizes.values()))
    assert all(got[s] == pytest.approx(want[s] if weights[s] else 0.0, abs=1e-6) for s in sizes)


def test_mix_weights_empty_and_rows(spark, docs, none):
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    w = spark.createDataFrame([("s1", 2.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix_sources(docs, w).where("copies > 0").collect()} == {"s1"}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]


# Languages


def test_langid(spark, docs, none):
    table = common.read(spark, SMALL, "documents")
    model = langid.fit_on(table.where(common.id_fold("doc_id", 3) != 1))
    got = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where(common.id_fold("doc_id", 3) == 1).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.9 * len(got)
    odd = langid.identify(docs, model, reject=False).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    by = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert all((by[i] == "und") == (not t or not re.search(r"[^\W\d_]", t)) for i, t, *_ in odd_rows())
    assert langid.identify(none, model).count() == 0
    unfit = langid.fit_on(none.select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(docs, unfit).collect()} == {"und"}


def test_langid_is_local_to_each_text():
    model = langid.fit(["aaa bbb", "ccc ddd"] * 10, ["x", "y"] * 10, epochs=3)
    one = lambda *t: model.logits(np.frombuffer("".join(t).encode(), np.uint8), np.cumsum([0, *(len(x) for x in t)]))
    assert np.allclose(one("aaab", "ccd")[1], one("ccd")[0]) and np.allclose(one("", "aaab")[1], one("aaab")[0])


# Toxicity


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(400)]
    bad = [" ".join([*t.split()[:10], f"insult{rng.choice(list('abcdefgh'))}x", *t.split()[10:]]) for t in texts[:100]]
    rows = [(i, t, "en", None, 0) for i, t in enumerate([*bad, *texts[100:]])]
    table = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit_on(table, labels.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table.where("doc_id % 4 = 2"), model).collect()}
    assert sum((s >= 0.3) == (i < 100) for i, s in got.items()) > 0.9 * len(got)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and kept.where("doc_id >= 100").count() > 280
    assert toxicity.score(docs, toxicity.fit_on(none, labels.limit(0))).count() == docs.count()


def test_pooling_never_leaves_a_text():
    f = np.array([[1.0], [9.0], [2.0], [3.0]])
    n, at = np.array([2, 0, 2]), np.array([0, 2, 2, 4])
    assert toxicity.pooled(f, n, at, 1).ravel().tolist() == [9, 0, 3]
    assert toxicity.pooled(f, n, at, 2).ravel().tolist() == [1, 0, 2]
    assert toxicity.pooled(f, n, at, 3).ravel().tolist() == [0, 0, 0]


# Decontamination


def contamination(text, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(low(text or ""))
    hit, found = set(), set()
    for i, t in items:
        x = word.findall(low(t or ""))
        for k in range(max(1, len(x) - width + 1) if x else 0):
            win = x[k : k + width]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_chars", [decontam.BLOCK_CHARS, 40])
def test_decontam(spark, docs, none, block_chars):
    long = " ".join(f"t{i}" for i in range(20))
    items = [(1, long), (2, "Short  item."), (3, ""), (4, None), (5, "short item"), (10, "é-É"), (6, "..."), (7, long.upper())]
    texts = [long, f"x {long} y", "a short, ITEM here short item", "é É", " ".join(long.split()[:12]), " ".join(long.split()[3:16]), long + " " + long, "short itemx", "z " * 100 + "short item", None, "", "naïve t0"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for r in decontam.find_contamination(table, bench, block_chars=block_chars).collect():
        assert tuple(r[c] for c in cols) == contamination(texts[r["doc_id"]], items), texts[r["doc_id"]]
        for s in r["spans"]:
            cut = texts[r["doc_id"]][s["begin"] : s["end"]]
            assert cut == cut.strip(" ,.") and contamination(cut, items)[1] == contamination(cut, items)[0] > 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("contaminated OR n_hit > 0").count() == 0
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.keep_clean(docs, bench).columns == docs.columns
    clean = {r["doc_id"] for r in decontam.keep_clean(table, bench).collect()}
    assert clean == {i for i, t in enumerate(texts) if not contamination(t, items)[4]}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "é", "."]), max_size=24), max_size=5), st.lists(st.lists(st.sampled_from(["a", "b", "c", "d", "E", "é", ".", "zz"]), max_size=40), min_size=1, max_size=6), st.integers(2, 5))
def test_sieve_lets_no_hit_through(items, texts, width):
    """The scan of every text by plain Python, against the texts that the sieve leaves."""
    bench = tuple((str(i), " ".join(w)) for i, w in enumerate(items))
    block = type("Block", (), {"value": bench})
    texts = [" ".join(t) for t in texts]
    got = decontam.examine(pa.array(texts), [block], width, 5)
    for k, t in enumerate(texts):
        assert tuple(x[k].as_py() for x in got[:5]) == contamination(t, [(int(i), w) for i, w in bench], width)


def test_one_automaton_for_a_large_benchmark(spark):
    """Two megabytes of items are one block and one build a worker; smaller blocks are gone through once for all that is gathered."""
    rng = np.random.default_rng(2)
    vocabulary = [f"v{i}" for i in range(20000)]
    items = [(i, " ".join(rng.choice(vocabulary, 60))) for i in range(6000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sum(len(t) for _, t in items) > 2_000_000
    texts = [f"start {items[k][1]} end" if k % 3 == 0 else " ".join(rng.choice(vocabulary, 80)) for k in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 50])], ["text"]) for a in range(0, 200, 50)]
    for chars, blocks_wanted in ((decontam.BLOCK_CHARS, 1), (1 << 20, 3)):
        blocks = decontam.item_blocks(bench, chars)
        assert len(blocks) == blocks_wanted
        decontam.automaton.cache_clear()
        found = [x for b in decontam.gathered(iter(batches), blocks) for x in decontam.examine(b.column("text"), blocks, 13, 5)[2].to_pylist()]
        assert decontam.automaton.cache_info().misses == blocks_wanted
        assert found == [1 if k % 3 == 0 else 0 for k in range(200)]


# Sharding


def test_shards(docs, none):
    got = sharding.shard_records(docs, 5).collect()
    assert len(got) == docs.count()
    slots = defaultdict(list)
    by = {}
    texts = {i: t for i, t, *_ in odd_rows()}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert by.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_records(none).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(20000)
    share = lambda w: {r[0]: r[1] / 20000 for r in ids.groupBy(sharding.rendezvous(F.col("id"), w).alias("s")).count().collect()}
    got = share([1.0, 2.0, 0.0, 1.0])
    assert got.get(2) is None and abs(got[1] - 0.5) < 0.02 and abs(got[0] - 0.25) < 0.02
    moved = ids.where(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0]) != sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0, 1.0]))
    assert moved.where(sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 1.0, 1.0]) != 4).count() == 0 and abs(moved.count() / 20000 - 0.2) < 0.02


# Line dedup


def removed_lines(rows, percent=80):
    """By (id, text): the lines that go. rows(id, text, hash of both)."""
    each = {(i is not None, i if i is not None else 0, h, k): (t, frozenset(WORD.findall(low(x)))) for i, t, h in rows if t is not None for k, x in enumerate(t.split("\n"))}
    out, before = defaultdict(list), []
    for (there, i, _, k), (t, s) in sorted(each.items()):
        if s:
            if any(100 * len(s & b) >= percent * len(s | b) for b in before):
                out[i if there else None, t].append(k)
            before.append(s)
    return out


def check_lines(table, **how):
    rows = table.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).collect()
    want = removed_lines(rows)
    found = linededup.similar_lines(table, **how)
    got = {(r["doc_id"], r["row"]): r for r in found.collect()}
    assert found.count() == len(rows)
    for i, t, h in rows:
        assert got[i, h]["removed"] == want[i, t] and got[i, h]["n_lines"] == (len(t.split("\n")) if t is not None else 0), (i, t)
    clean = linededup.without_lines(table, found)
    assert clean.columns == table.columns
    cut = lambda i, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i, t])
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((i, cut(i, t)) for i, t, _ in rows)
    return want


@pytest.mark.parametrize("cell", [linededup.CELL, 3])
def test_lines(spark, docs, none, cell):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 60, rng.integers(1, 14))] for _ in range(30)]
    lines = [" ".join(b) for b in base] + [" ".join([*b[:-1], "new"]) for b in base] + ["", " ", "V1", "v1 v1"]
    texts = ["\n".join(rng.choice(lines, rng.integers(1, 9))) for _ in range(30)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    assert check_lines(spark.createDataFrame(rows, DOCS).repartition(3), cell=cell)


@pytest.mark.parametrize(("cell", "room"), [(linededup.CELL, linededup.ROOM), (64, 2)])
def test_lines_that_share_most_words(spark, monkeypatch, cell, room):
    """17 words in common and 3 of their own: all pairs are just below the threshold, and some lines have a match among the many that fail."""
    monkeypatch.setattr(linededup, "ROOM", room)
    rng, head = np.random.default_rng(5), " ".join(f"c{i}" for i in range(17))
    own = [[f"w{x}" for x in rng.integers(0, 1 << 40, 3)] for _ in range(700)]
    lines = [f"{head} {' '.join(x)}" for x in own]
    lines += [f"{head} {' '.join(own[k][:1])} u{k} u{k + 1}" for k in range(0, 700, 23)] + [f"{head} {' '.join(own[k][:2])}" for k in range(0, 700, 31)]
    made = {}
    real = linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, name: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    want = check_lines(spark.createDataFrame([(i, "\n".join(lines[i::40]), None, None, None) for i in range(40)], DOCS).repartition(4), cell=cell)
    assert 0 < sum(map(len, want.values())) < 100
    asked = sum(x.where("many > 64").count() for x in made["asking"])
    assert asked > 300 and made["confirmed"] and all(x.count() <= 64 * len(lines) for x in made.get("rest", []))


def test_long_lines_that_share_rare_words(spark, monkeypatch):
    """Lines of 150 words that meet in many lists and are far from alike: the filters part them, so that none is asked again, and no match is lost."""
    rng, made, real = np.random.default_rng(7), {}, linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, name: made.setdefault(name, []).append(real(df, name)) or made[name][-1])
    words = [[f"w{x}" for x in rng.choice(3000, 150, replace=False)] for _ in range(300)]
    near = [[*w[k:], *(f"n{i}x{j}" for j in range(k))] for i, w in enumerate(words[:40]) for k in (3, 14, 17, 25)]
    lines = [" ".join(rng.permutation(w)) for w in [*words, *near]]
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    want = check_lines(spark.createDataFrame([(i, "\n".join(lines[i::20]), None, None, None) for i in range(20)], DOCS).repartition(4))
    assert sum(map(len, want.values())) >= 80 and spark.conf.get(key, None) == before
    assert sum(x.count() for x in made["asking"]) == 0 and sum(x.count() for x in made["named"]) < 250


def test_lines_odd(spark, docs, none):
    check_lines(docs.withColumns({"removed": F.lit("clash"), "row": F.lit(1), "doc": F.lit(2)}))
    assert linededup.similar_lines(none).count() == 0


def test_lines_where_ids_repeat_or_are_null(spark):
    same, near = "alpha beta gamma delta eps zeta eta theta iota", "alpha beta gamma delta eps zeta eta theta kappa"
    rows = [(5, f"{same}\nkeep me one two three"), (5, f"other words here now then\n{same}"), (None, f"{near}\nfirst of none"), (None, f"second of none\n{same}"), (None, f"second of none\n{same}"), (6, None), (6, "")]
    want = check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(map(len, want.values())) == 3, "of four lines that are alike the first stays"
    check_lines(spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in rows], "doc_id string, text string"))


def test_many_variants_of_a_line(spark):
    """Each asks for the rest only if its nearest partner fails; none is lost."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[j] if rng.random() > 0.12 else f"r{rng.integers(9)}" for j in range(40))) for i in range(150)]
    check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), cell=40)


# Token output


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1000]))
def test_coder_round_trip(ids, block):
    coded = rangecoder.encode(np.array(ids, np.int64), block)
    assert rangecoder.decode(coded).tolist() == ids and len(coded) == -(-len(ids) // block)


def test_coder_learns_and_blocks_stand_alone():
    ids = np.array([1, 2, 3, 70_000] * 1000)
    coded = rangecoder.encode(ids, 1000)
    assert sum(map(len, coded)) < 0.1 * 2 * len(ids)
    assert rangecoder.decode([coded[2]]).tolist() == ids[2000:3000].tolist()
    zeros = rangecoder.encode(np.full(100_000, 7), 100_000)
    assert rangecoder.decode(zeros).tolist() == [7] * 100_000, "carries over many words"
    for bad in (1 << 32, -1):
        with pytest.raises(ValueError):
            rangecoder.encode(np.array([bad]), 10)


def test_coder_against_a_byte_compressor():
    import public_tokenizers

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"].to_pylist()
    ids, n = tokenio.encoder_of(public_tokenizers.path("word_bpe_49k.json")).encode([t.encode() for t in table], 1)
    coded = rangecoder.encode(ids, tokenio.BLOCK)
    assert n.sum() == len(ids) and (rangecoder.decode(coded) == ids).all()
    p = np.bincount(ids) / len(ids)
    bits = 8 * sum(map(len, coded)) / len(ids)
    assert bits < 0.9 * 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    assert bits < -(p[p > 0] * np.log2(p[p > 0])).sum(), "fewer bits than the ids' own entropy: the contexts tell something"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    coder, tokenizer = tokenio.encoder_of(path), Tokenizer.from_file(path)
    assert isinstance(coder, tokenio.WordIds) == name.startswith("word")
    texts = [t or "" for _, t, *_ in odd_rows()] + ["a|b ||. |, 9. 9, a., b.. c,,", "It's <|endoftext|>. I'LL. Go!!. a<|endoftext|>b. <|x.", "ΑΣ. Σ ﬁ ｜ e\u0301."]
    monkeypatch.setattr(tokenio, "MEMO_WORDS", 100)
    for a in range(0, len(texts), 9):
        ids, n = coder.encode([t.encode() for t in texts[a : a + 9]], 3)
        want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 3] for t in texts[a : a + 9]]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_tokens(spark, docs, none, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(500, "It's <|endoftext|> I'LL. Go!!. (x.) 3.5. a. b É. café. DON'T, x,y . ,"), (501, "<|ENDOFTEXT|> a"), (502, "́x İ. \x1c y\x85z")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for block in (200, tokenio.BLOCK):
        out = f"file://{tmp_path}/{block}"
        tokenio.write_ids(table, out, path, 1, block=block, chunk_bytes=2000)
        got = tokenio.read_ids(spark, out).orderBy("start").collect()
        want = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        at = 0
        assert len(got) == len(want)
        for r, (i, t) in zip(got, want):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(ids), ids), t
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
    tokenio.write_ids(none, f"file://{tmp_path}/none", path, 1)
    assert tokenio.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_damage_is_found(spark, tmp_path):
    import public_tokenizers

    out = f"file://{tmp_path}/a"
    tokenio.write_ids(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), out, public_tokenizers.path("word_bpe_49k.json"), 1)
    bad = spark.read.parquet(out).withColumn("blocks", F.transform("blocks", lambda b: F.concat(b, F.lit(b"\x00"))))
    bad.write.parquet(f"file://{tmp_path}/b")
    with pytest.raises(Exception, match="damaged block"):
        tokenio.read_ids(spark, f"file://{tmp_path}/b").collect()


# Near-dedup of vectors


@pytest.mark.parametrize("cell", [pivots.CELL, 8])
def test_vectors(spark, cell):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    X = np.concatenate([base, *[base[:20] + rng.normal(size=(20, 16)) * s for s in (0.02, 0.1, 0.25)], base[:5], 3 * base[5:8], np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.05])
    rows = [(i * 3, [float(v) for v in x]) for i, x in enumerate(X)]
    n = len(rows)
    odd = [(1001, None), (1002, []), (1003, [0.0] * 16), (1004, [float("nan")] * 16), (1005, [None] * 16), (1006, [float("inf")] + [1.0] * 15), (1007, [1.0, 2.0]), (1008, [2.0, 4.0]), (1009, [1e300] * 16), (1010, [1e-300] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).repartition(3)
    got = {r["vec_id"]: r for r in pivots.near_duplicates(table, pivots=24, cell=cell).collect()}
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    link = U @ U.T >= 0.95
    np.fill_diagonal(link, False)
    assert sum(got[3 * i]["n_links"] for i in range(n)) >= 0.97 * link.sum()
    assert all(got[3 * i]["n_links"] <= link[i].sum() for i in range(n))
    exact = {r["vec_id"]: r for r in pivots.near_duplicates(table, pivots=1, nearest_count=1, shared=1, cell=cell).collect()}
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    for i in range(n):
        assert (exact[3 * i]["n_links"], exact[3 * i]["component_id"], exact[3 * i]["kept"]) == (link[i].sum(), 3 * comp[i], comp[i] == i)
    assert all(exact[k]["n_links"] == 0 and exact[k]["component_id"] == k for k in range(1001, 1007))
    assert exact[1007]["n_links"] == exact[1008]["n_links"] == 1 and exact[1009]["component_id"] == exact[1010]["component_id"] == 1009
    assert exact[None]["component_id"] is None and exact[None]["kept"]
    assert pivots.near_duplicates(table.where("false")).count() == 0


@pytest.mark.parametrize("pivot_count", [64, 4096])
def test_recall_on_clusters(spark, tmp_path, pivot_count):
    """Production's parameters; 2,000 clusters of four whose pairs lie around a cosine of 0.96, among 8,000 others."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = [unit(base + 0.2 * unit(rng.normal(size=(2000, 64)))) for base in [unit(rng.normal(size=(2000, 64)))] for _ in range(4)]
    X = np.concatenate([*near, unit(rng.normal(size=(8000, 64)))])[rng.permutation(16000)].astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(X)), "embedding": list(X)}), tmp_path / "v.parquet")
    U = unit(X.astype(float))
    links = np.concatenate([(U[a : a + 1000] @ U.T >= 0.95).sum(1) - 1 for a in range(0, len(U), 1000)])
    assert links.sum() > 10_000
    got = pivots.near_duplicates(spark.read.parquet(f"file://{tmp_path}/v.parquet"), pivots=pivot_count).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all() and (found[~got["kept"]] > 0).all()


@pytest.mark.parametrize("to_base", [0.98, 0.9999])
def test_large_group_of_distinct_near_copies(spark, tmp_path, to_base):
    """A third of 21,000 vectors around one base, no two equal; production defaults."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base, r = unit(rng.normal(size=64)), rng.normal(size=(7000, 64))
    group = to_base * base + (1 - to_base**2) ** 0.5 * unit(r - np.outer(r @ base, base))
    X = np.concatenate([group, unit(rng.normal(size=(14000, 64)))])[rng.permutation(21000)]
    pq.write_table(pa.table({"vec_id": np.arange(len(X)), "embedding": list(X)}), tmp_path / "v.parquet")
    links = np.concatenate([(X[a : a + 1000] @ X.T >= 0.95).sum(1) - 1 for a in range(0, len(X), 1000)])
    got = pivots.near_duplicates(spark.read.parquet(f"file://{tmp_path}/v.parquet")).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert (found <= links).all() and found.sum() >= 0.999 * links.sum()
    assert (got["component_id"].to_numpy()[links > 0] == np.flatnonzero(links)[0]).all()


def test_vectors_with_a_common_mean(spark, tmp_path, monkeypatch):
    """20,000 vectors of mean cosine 0.7 and 500 near copies: nearly all lie in the reach of each hub, a sixth at home at some, and only those are compared with
    all (0.18 n² products measured; balls against themselves would take several n²); recall stays."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean, spread = unit(rng.normal(size=64)), unit(rng.normal(size=(19500, 64)))
    X = unit(0.7**0.5 * mean + 0.3**0.5 * spread)
    X = np.concatenate([X, unit(X[:500] + 0.15 * unit(rng.normal(size=(500, 64))))])[rng.permutation(20000)]
    pq.write_table(pa.table({"vec_id": np.arange(len(X)), "embedding": list(X)}), tmp_path / "v.parquet")
    links = np.concatenate([(X[a : a + 1000] @ X.T >= 0.95).sum(1) - 1 for a in range(0, len(X), 1000)])
    made, real = {}, pivots.materialize
    monkeypatch.setattr(pivots, "materialize", lambda df, name: made.setdefault(name, real(df, name)))
    got = pivots.near_duplicates(spark.read.parquet(f"file://{tmp_path}/v.parquet")).toPandas().sort_values("vec_id")
    found = got["n_links"].to_numpy()
    assert links.sum() >= 1000 and (found <= links).all() and found.sum() >= 0.9 * links.sum()
    balls = made["index"].where("list < 0").groupBy("list").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("list") == -1 - F.col("home")).alias("h"))
    assert (balls.agg(F.sum(F.col("c") * F.col("h"))).first()[0] or 0) < 0.25 * len(X) ** 2


# Quality


def test_quality(spark, docs, none):
    rng = np.random.default_rng(6)
    pools = [[f"low{i}" for i in range(50)], [f"mid{i}" for i in range(50)], [f"top{i}" for i in range(50)]]
    grade = lambda i: i % 3
    rows = [(i, " ".join(rng.choice(pools[grade(i)] + pools[1], 40)), None, None, None) for i in range(450)]
    table = spark.createDataFrame(rows, DOCS)
    ratings = spark.createDataFrame([(i, float(2 * grade(i))) for i in range(300)], "doc_id long, grade double")
    model = quality.fit_on(table, ratings)
    assert model.grades == [0.0, 2.0, 4.0] and (np.diff(model.thresholds) >= 0).all()
    got = quality.grade(table.where("doc_id >= 300"), model, select_from=2).collect()
    assert np.mean([abs(r["expected_grade"] - 2 * grade(r["doc_id"])) for r in got]) < 0.7
    assert all(r["tails"][0] >= r["tails"][1] == r["tail"] and r["kept"] == (r["tail"] >= 0.5) for r in got)
    odd = quality.grade(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["tail"] <= 1 for r in odd)
    assert quality.grade(none, model).count() == 0
    unfit = quality.grade(docs, quality.fit_on(none, ratings.limit(0)))
    assert unfit.where("kept").count() == 0 and unfit.count() == docs.count()


def test_plain_words_go_to_the_model():
    """Words of plain letters have the library's ids without a pass through normaliser and splitter."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, passed = Tokenizer.from_file(path), []

    class Spy:
        model, encode = tokenizer.model, staticmethod(tokenizer.encode)

        def encode_batch_fast(self, texts, **more):
            passed.extend(w for t in texts for w in t.split(" | "))
            return tokenizer.encode_batch_fast(texts, **more)

    rng = np.random.default_rng(12)
    letters = "abcxyz" + "".join(chr(k) for k in range(0xDF, 0x100) if chr(k).isalpha())
    plain = sorted({"".join(rng.choice(list(letters), int(rng.integers(1, 12)))) for _ in range(2000)})
    odd = ["É", "ÀÉ", "e\u0301a", "a\u0301", "÷", "aé÷", "don't", "x1", "日本", "ſa", "a|b", "|"]
    ids, n = tokenio.WordIds(Spy()).encode([w.encode() for w in [*plain, *odd]], 1)
    want = [[*e.ids, 1] for e in tokenizer.encode_batch_fast([*plain, *odd], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert not set(passed) & set(plain)


# Near-dedup of texts


def near(rows, width, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append((i, frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if sets[a][1] and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k), i)) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("width, percent", [(2, 80), (5, 80), (1, 50)])
def test_near_duplicates(spark, docs, none, width, percent):
    got = minhash.near_duplicates(docs, width, percent).collect()
    want = near([(r[0], r[1]) for r in odd_rows()], width, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(none, width, percent).count() == 0


def test_chains_and_variants(spark):
    """Links that pass through others, many variants of one text, and a passage that unlike texts share."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    chain = [" ".join(base[: 60 + 3 * k]) for k in range(20)]
    variants = [" ".join(w if rng.random() > 0.06 else f"r{rng.integers(50)}" for w in base) for _ in range(120)]
    shared = [" ".join([f"p{i}" for i in range(60)] + [f"q{k}.{i}" for i in range(int(rng.integers(5, 60)))]) for k in range(80)]
    rows = list(enumerate([*chain, *variants, *shared]))
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == set(near(sorted(rows), 2, 80))


def joined_rows(spark, key, since):
    """The most rows that a join on this key alone has made, in executions from this number on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(k) for k in range(runs.size())):
        if run.executionId() < since:
            continue
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name() and re.search(rf"Join \[{key}#\d+L\], \[{key}#\d+L\], Inner", node.desc()):
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                rows = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                most = max([most, *(int(r.get().replace(",", "")) for r in rows if r.isDefined())])
    return most


def test_strays_of_a_large_group(spark):
    """Texts half like all of a large group, and chains that lead out of it: no join makes a pair of each with each member."""
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(300)]
    swap = lambda words, k, n, name: [*words[:k], *[f"{name}.{i}" for i in range(n)], *words[k + n :]]
    members = [swap(swap(base, int(rng.integers(300)), 1, f"m{k}"), int(rng.integers(300)), 1, f"n{k}") for k in range(150)]
    strays = [swap(base, int(rng.integers(0, 180)), int(rng.integers(80, 100)), f"s{k}") for k in range(60)]
    chain = [swap(base, 0, 24 * k, "c") for k in range(1, 8)]
    rows = list(enumerate(" ".join(t[:300]) for t in [*strays, *members, *chain]))
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = 1 + max([-1, *(runs.apply(k).executionId() for k in range(runs.size()))])
    # Without broadcasts, so that the join is one that has its rows counted on its own.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2, 80).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == set(near(rows, 2, 80))
    assert joined_rows(spark, "v", since) <= 24 * len(rows), "a set opens at most so many lists"


# What they share


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(5000, 5000)]
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        if a != b:
            comp[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in comp}


def test_hashes_do_not_depend_on_place():
    text = "foo bar foo\nba r"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, own = textbytes.words(data, np.array([0, 5, len(data)]), textbytes.SPACE)
    assert [text[a:b] for a, b in zip(starts, ends)] == ["foo", "b", "ar", "foo", "ba", "r"] and own.tolist() == [0, 2, 6]
    h = textbytes.word_hashes(data, starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 5


def test_bit_filter_lets_all_of_its_own_through(spark):
    ids = np.arange(-5000, 5000) * 7919
    bits = common.bit_filter(spark.createDataFrame([(int(i),) for i in ids], "h long"), 16)
    assert common.bit_hit(bits, ids).all() and not common.bit_hit(bits, ids + 1).all()


def test_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    for name in ("op1_mixing", "op5_sharding", "op4_decontam"):
        assert queries.QUERIES[name](spark, SMALL).count() == common.read(spark, SMALL, "documents").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(name, spark):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    cursor = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(str, cursor.fetchall()))
