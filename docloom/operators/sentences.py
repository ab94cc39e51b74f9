"""Sentence boundaries learned from the corpus alone: which words are abbreviations and which begin sentences, by likelihood ratios of counts.

The tests and their bounds are those of Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection (2006).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import ship, written

#: Scores from which a word is an abbreviation, or begins sentences; words of each kind that a model holds at most, best first.
ABBREVIATION, STARTER, MOST = 0.3, 30.0, 65_536
_ENDS = re.compile(r"[.!?]+[\"'”’)\]]*\s+")
#: Marks that may stand before a word and behind it, periods aside; behind an end that needs no period.
_OPENERS, _CLOSERS, _QUOTES = "\"'“”‘’([", "\"'“”‘’)],;:!?", "\"'”’)]"
#: Python's white space without what is none to Unicode, and that: words are parted alike here and in Spark.
_WORD, _SEPARATORS = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), "\x1c\x1d\x1e\x1f"
#: Distinct words and pairs that a task counts before it gives them out.
COUNTED = 1 << 18


@dataclass(frozen=True)
class Model:
    abbreviations: frozenset[str]
    starters: frozenset[str]

    def split(self, text: str) -> list[str]:
        text, out, begin = text.strip(), [], 0
        for m in _ENDS.finditer(text):
            if self.is_end(text, m):
                out.append(text[begin : m.end()].strip())
                begin = m.end()
        rest = text[begin:].strip()
        return [*out, rest] if rest else out

    def is_end(self, text: str, m: re.Match) -> bool:
        begin, end = m.span()
        marks = m[0]
        if "!" in marks or "?" in marks:
            return True
        if text[end : end + 1].islower():
            return False
        following = text[end : end + 64].split(None, 1)
        following = following[0].lstrip(_OPENERS) if following else ""
        if following[:1].islower():
            return False
        before = text[max(0, begin - 64) : begin]
        before = before.rsplit(None, 1)[-1].lstrip(_OPENERS).lower() if before and not before[-1].isspace() else ""
        if before in self.abbreviations or (len(before) == 1 and before.isalpha()):
            return len(before) > 1 and following.rstrip(_CLOSERS + ".").lower() in self.starters
        return True


def words(text: str) -> list[str]:
    """The parts between Unicode's white space."""
    return _WORD.findall(text) if any(x in text for x in _SEPARATORS) else text.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, dot, u, hard, n, words without the marks around them: how often each word w is there, with a period behind it or not (u null), and how often u is behind
    a word that ends in a period (w) or in another mark that ends a sentence (hard; w empty). A row may come several times."""
    one, two, marks = Counter(), Counter(), frozenset(_CLOSERS + ".")
    types = pa.schema({"w": pa.string(), "dot": pa.bool_(), "u": pa.string(), "hard": pa.bool_(), "n": pa.int64()})

    def rows(w: list[str], u: list[str | None], hard: list[bool], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([x.rstrip(".") for x in w], [x[-1:] == "." for x in w], u, hard, n), types)], schema=types)

    def out() -> Iterator[pa.RecordBatch]:
        yield rows([x.lstrip(_OPENERS).rstrip(_CLOSERS) for x in one], [None] * len(one), [False] * len(one), [*one.values()])
        w = [x.lstrip(_OPENERS).rstrip(_CLOSERS) for x, _ in two]
        hard = [x != "" and t.rstrip(_QUOTES)[-1:] in ("!", "?") for x, (t, _) in zip(w, two)]
        yield rows(["" if h else x for h, x in zip(hard, w)], [u.lstrip(_OPENERS).rstrip(_CLOSERS).rstrip(".") for _, u in two], hard, [*two.values()])
        one.clear()
        two.clear()

    for batch in batches:
        for text in batch.column(0):
            found = words(text.as_py() or "")
            one.update(found)
            two.update([(t, u) for t, u in zip(found, found[1:]) if t[-1] in marks and ("!" in t or "?" in t or t.rstrip(_CLOSERS)[-1:] == ".")])
            if len(one) + len(two) > COUNTED:
                yield from out()
    yield from out()


def fit(texts: DataFrame) -> Model:
    """A model from the counts of all of texts(text); null texts count for nothing. One pass counts words and the pairs around what may be an end, as they are
    written; all else is worked out from those counts. The driver gets the words that pass the tests, MOST of each kind."""
    ship(texts.sparkSession)
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    typed = texts.select("text").mapInArrow(_counted, "w string, dot boolean, u string, hard boolean, n long")
    typed = typed.select(F.lower("w").alias("w"), F.lower("u").alias("u"), (F.col("dot") | F.col("hard")).alias("dot"), "hard", "n")
    typed = typed.where(F.when(F.col("u").isNull(), F.col("w") != "").otherwise((F.col("u") != "") & (F.col("hard") | (F.col("dot") & (F.length("w") > 1)))))
    seen = written(typed.groupBy("w", "u").agg(sum_if(F.col("dot")).alias("dotted"), sum_if(~F.col("dot")).alias("bare")), "words")
    counts = seen.where("u IS NULL").drop("u")
    total = counts.agg(F.sum(F.col("dotted") + F.col("bare")).alias("n"), F.sum("dotted").alias("dots")).first()
    n, dots = total["n"] or 0, total["dots"] or 0
    if not n or not dots:
        return Model(frozenset(), frozenset())
    p = min(dots / n, 1 - 1e-9)
    ratio = lambda q: F.col("dotted") * F.log(F.lit(q)) + F.col("bare") * F.log(F.lit(1 - q))
    letters = F.length(F.replace(F.col("w"), F.lit("."), F.lit("")))
    inner = F.length("w") - letters + 1
    score = 2 * (ratio(0.99) - ratio(p)) * F.exp(-letters) * inner * F.pow(letters, -F.col("bare"))
    good = counts.where("dotted > 0").where(F.col("w").rlike(r"\p{L}")).select("w", score.alias("s")).where(F.col("s") >= ABBREVIATION)
    abbreviations = {r["w"] for r in good.orderBy(F.desc("s"), "w").limit(MOST).collect()}
    # Words behind an end that is surely one, against all their places.
    pairs = seen.where("u IS NOT NULL").select("w", "u", F.col("dotted").alias("n"))  # w is empty behind an end without a period
    short = good.select("w")
    sure = pairs.join(F.broadcast(short) if len(abbreviations) < MOST else short, "w", "left_anti")
    behind = written(sure.groupBy("u").agg(F.sum("n").alias("k")), "behind")
    n_ends = behind.agg(F.sum("k")).first()[0] or 0
    rows = behind.join(counts.select(F.col("w").alias("u"), (F.col("dotted") + F.col("bare")).alias("c")), "u")
    log_l = lambda k, m, q: k * F.log(F.greatest(q, F.lit(1e-12))) + (m - k) * F.log(F.greatest(1 - q, F.lit(1e-12)))
    k, c, m = F.least("k", "c").cast("double"), F.col("c").cast("double"), F.lit(float(max(n_ends, 1)))
    rest = F.greatest(F.lit(float(n)) - m, F.lit(1.0))
    dunning = 2 * (log_l(k, m, k / m) + log_l(c - k, rest, (c - k) / rest) - log_l(k, m, c / n) - log_l(c - k, rest, c / n))
    found = rows.where((k / m > c / n) & F.col("u").rlike(r"^\p{L}")).select("u", dunning.alias("s")).where(F.col("s") >= STARTER)
    return Model(frozenset(abbreviations), frozenset(r["u"] for r in found.orderBy(F.desc("s"), "u").limit(MOST).collect()))


def sentences(text: str | Column, model: Model) -> Column:
    """The sentences of a text, as array<string>, none empty; none for a null text."""
    ship()

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.split(t) if t is not None else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(F.col(text) if isinstance(text, str) else text)
