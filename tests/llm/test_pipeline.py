"""The pipeline's stages, each against what it must do on its own input."""

import re

from docloom.llm import common, decontam, minhash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as pipeline

    docs = common.read(spark, SMALL, "documents")
    columns, inputs = docs.columns, []
    for name, stage in pipeline.STAGES:
        inputs.append((name, docs))
        docs = common.materialize(stage(spark, docs, SMALL), name)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    outputs = [d for _, d in inputs[1:]] + [docs]
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}

    labels = {r["doc_id"]: r["toxic"] for r in common.read(spark, SMALL, "labels").collect()}
    insult = re.compile(r"\b(idiot|moron|scum|loser|pathetic|worthless|stupid|clown|trash|disgusting)\b", re.I)
    gone = ids(inputs[0][1]) - ids(outputs[0])
    marked = {r["doc_id"] for r in inputs[0][1].collect() if insult.search(r["text"]) and labels.get(r["doc_id"]) == 1}
    assert len(gone) < 0.4 * len(labels) and len(marked & gone) >= 0.5 * len(marked)

    found = minhash.near_duplicates(inputs[1][1], 5, 80).collect()
    assert ids(outputs[1]) == {r["component_id"] for r in found}, "one of each group stays"

    clean = decontam.find_contamination(inputs[2][1], common.read(spark, SMALL, "benchmark")).where("NOT contaminated")
    assert ids(outputs[2]) == ids(clean)

    words = lambda d: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in d.collect())
    assert abs(words(outputs[3]) - words(inputs[3][1])) < 0.2 * words(inputs[3][1])
    rows = outputs[4].orderBy("start").collect()
    assert len(rows) == inputs[4][1].count() and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_repeated_rows_and_empty(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", None, None, None), (3, None, None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted((str(r["doc_id"]) for r in got)) == ["1", "3", "None"]
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0, name


def test_near_duplicates_where_ids_repeat_or_are_null(spark):
    import corpus_pipeline as pipeline

    text = lambda s: [f"{s}{i}" for i in range(60)]
    near = lambda s: " ".join([*text(s)[:-1], "changed"])
    a, b, c, d = (" ".join(text(s)) for s in "abcd")
    rows = [(1, b), (5, a), (5, near("b")), (None, c), (None, near("c")), (None, near("d")), (7, d), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs.repartition(3), SMALL).collect()]
    assert sum(g in [(None, c), (None, near("c"))] for g in got) == 1, "one of two near copies without ids"
    assert sorted(map(str, (g for g in got if g[1] not in (c, near("c"))))) == sorted(map(str, [(1, b), (5, a), (7, d), (8, None), (None, None)]))


def test_long_texts_ties_and_clashing_names(spark):
    """A text of 2 MB among short ones, copies without ids, columns with the names that stages use inside; every stage keeps what it must."""
    import corpus_pipeline as pipeline

    long = " ".join(f"w{i % 5000}x{i % 7}" for i in range(250_000))
    rows = [(1, long, "en", "s", 1), (2, long, "en", "s", 1), (None, "same words here in two rows", None, None, None), (None, "same words here in two rows", None, None, None), (3, "", "en", "t", 0), (4, "same words here in two rows", "en", "t", 5)]
    names = ["row", "doc", "copies", "h", "k", "_kept", "_digest", "removed", "part"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)).repartition(2)
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = common.materialize(stage(spark, kept, SMALL), name)
        assert kept.columns == docs.columns, name
        if name == "near_dedup":
            assert sorted((str(r["doc_id"]), len(r["text"])) for r in kept.collect()) == [("1", len(long)), ("3", 0), ("4", 27)]
    taken = kept.collect()
    got = pipeline.STAGES[-1][1](spark, kept, SMALL).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in taken)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] == 3)
