"""Text functions on cases that the tables do not hold."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T

CLEAN = {
    "ab ,cd": "ab, cd", "xong,được": "xong, được", "1,000": "1,000", "12:30": "12:30", "http://x.com": "http://x.com", "3.14": "3.14", "e.X": "e. X", "a  b   c": "a b c",
    "\t ends  ": "ends", "a.com": "a.com", "": "",
}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize("given_, wanted", CLEAN.items())
def test_clean(spark, given_, wanted):
    assert one(spark, T.clean_translation("t"), t=given_) == wanted


def test_clean_other_language(spark):
    assert one(spark, T.clean_translation("t", "en"), t=" ab ,cd ") == "ab ,cd"
    assert one(spark, T.clean_translation("t", "vi", strip_markdown=True), t="**đậm** *x*") == "đậm x"


def test_protect_and_restore(spark):
    text, found = T.protect("t")
    row = spark.createDataFrame([(r"area $\pi r^2$ and $a_1$",)], "t string").select(text.alias("p"), found.alias("f"))
    assert row.first()["p"] == "area {v1} and {v2}"
    back = row.withColumn("p", F.regexp_replace("p", r"\{v1\}", "{ V 1 }")).select(T.restore("p", "f")).first()[0]
    assert back == r"area $\pi r^2$ and $a_1$"


def test_protect_brackets(spark):
    text, found = T.protect("t", style="brackets")
    row = spark.createDataFrame([("x $y$ z",), ("none",), (None,)], "t string").select(text.alias("p"), found.alias("f"))
    assert [r["p"] for r in row.collect()] == ["x ⟦1⟧ z", "none", None]
    assert [r[0] for r in row.select(T.restore("p", "f", "brackets")).collect()] == ["x $y$ z", "none", None]


def test_preview(spark):
    assert one(spark, T.preview("t", 5), t=" ab\ncdefg ") == "ab cd"
    assert one(spark, T.preview("t", 5, True), t="abcdefg") == "abcde…"
    assert one(spark, T.preview("t", 5, True), t="abcde") == "abcde"


def test_null_and_empty_model_share_a_key(spark):
    row = spark.createDataFrame([(None, "")], "a string, b string")
    a, b = row.select(*[T.memory_key(F.lit("en"), F.lit("vi"), F.lit("s"), F.col(c), F.lit("t")) for c in "ab"]).first()
    assert a == b


ETA = {-1.0: "—", 0.4: "<1s", 1.0: "1s", 59.4: "59s", 60.0: "1m", 61.0: "1m 1s", 119.6: "1m 60s"}


def test_eta(spark):
    rows = spark.createDataFrame([(k, v) for k, v in ETA.items()] + [(None, "—")], "s double, w string").select(T.eta_label("s"), "w").collect()
    assert all(r[0] == r[1] for r in rows), rows


def test_relative(spark):
    ages = {0.0: "now", 5.0: "5 seconds ago", 60.0: "1 minute ago", 7200.0: "2 hours ago", 86400.0: "yesterday", -86400.0: "tomorrow", 259200.0: "3 days ago"}
    rows = spark.createDataFrame([(k, v) for k, v in ages.items()] + [(None, "earlier")], "s double, w string").select(T.relative_label("s"), "w").collect()
    assert all(r[0] == r[1] for r in rows), rows


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n 　abé", max_size=8), min_size=1, max_size=20))
def test_strip_and_tokens_are_pythons(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.strip("t").alias("s"), T.tokens("t").alias("k")).collect()
    for r in rows:
        assert r["s"] == texts[r["i"]].strip()
        assert r["k"] == texts[r["i"]].lower().split()


def test_language_name(spark):
    assert one(spark, T.language_name("t"), t="ja") == "Japanese (日本語)"
    assert one(spark, T.language_name("t"), t="xx") == "xx"
    assert re.fullmatch(r"[0-9a-f]{64}", one(spark, T.content_hash("t"), t="a"))
