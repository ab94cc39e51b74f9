"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

#: Words parted by ASCII whitespace.
WORD = r"[^\x20\x09-\x0D]+"
#: A source's cut in the seeded order is found by the upper bits of the hash: 12, then 24, then all 63. Each look needs one sum for each
#: value of the next bits, 4,096 a source, and at last one for each document that shares the 24 bits of the cut.
LEVELS = (51, 39, 0)
#: Tables with a row for each source are broadcast up to so many rows, and joined by Spark's choice beyond.
BROADCAST_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds weight: the cycle repeated over the sources by code point, null last. sources has a row for each source.

    Ranks come from ranges of sources: a row's place within its range, and the counts of the ranges before.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ranges")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    rank = F.col("_place") + F.col("before")
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    ranged = ranged.join(F.broadcast(parts.select(F.col("_part"), before.alias("before"))), "_part")
    return ranged.withColumn("weight", F.element_at(weights, (rank % len(cycle) + 1).cast("int"))).select(*sources.columns, "weight")


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """Adds target to sources(source, source_size, weight): shares of total (all sizes if None) by weight, none above
    max_epochs times its size; the excess goes to the others by weight until none is above.

    Each round clamps every source above its cap; the driver holds two sums a round. If total is above all caps, all
    are at their caps. A weight of 0, or an empty source, gets 0.
    """
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) if total is None else float(total)
    level, seen = 0.0, -1
    while True:
        held = F.col("weight") * F.lit(level) >= F.col("cap")
        row = sources.agg(
            F.sum(F.when(held, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(held).alias("n")
        ).first()
        if row["n"] == seen or not row["weight"]:
            return sources.withColumn("target", F.least("cap", F.col("weight") * F.lit(level if row["weight"] else float("inf")))).withColumn("target", F.when(F.col("weight") > 0, F.coalesce(F.nanvl("target", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)).drop("cap")
        seen, level = row["n"], max(level, (total - row["cap"]) / row["weight"])


def _with(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with table, which has a row for each source in _s."""
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _order(seed: int) -> Column:
    """A document's place in the seeded order, 63 bits of id and text: rows that repeat an id, or have none, are spread by their texts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.xxhash64("text")), 1)


def _last(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds last to cuts(_s, cut, some, n): the number of the last of the first ``some`` rows of the source at cut, -1 for none. These rows repeat one id and text;
    they are counted by the parts in which they were written, and numbered in the one part where they end."""
    if not cuts.where("n > 1").limit(1).count():  # no rows repeat there: all or none are taken
        return cuts.select("_s", "cut", F.when(F.col("some") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-1)).alias("last"))
    part = F.shiftright("row", 33)
    sums = _with(sized, cuts).where(F.col("h") == F.col("cut")).groupBy("source", part.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = _with(materialize(sums.withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0))), "repeats"), cuts)
    ends = materialize(found.where("before < some AND some <= before + m").select(F.col("source").alias("_s"), "cut", "part", (F.col("some") - F.col("before")).alias("need")), "ends")
    rows = _with(sized, ends).where((F.col("h") == F.col("cut")) & (part == F.col("part")))
    number = F.row_number().over(Window.partitionBy("source").orderBy("row"))
    last = rows.withColumn("number", number).where("number = need").select(F.col("source").alias("_c"), F.col("row").alias("last"))
    return cuts.join(last, F.col("_s").eqNullSafe(F.col("_c")), "left").select("_s", "cut", F.coalesce("last", F.lit(-1)).alias("last"))


def _plan(sized: DataFrame, weights: DataFrame | None, max_epochs: int, cycle: tuple[int, ...]) -> DataFrame:
    """A row for each source of sized(source, size, h, row): _s, source_size, target, whole, cut, last. A document of the source is taken
    ``whole`` times, and once more if its h is below cut, or is cut and its row not above last."""
    first = F.shiftright("h", LEVELS[0])
    sums = materialize(sized.groupBy("source", first.alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "sums")
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        sources = cyclic_weights(sources, cycle)
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    plan = water_fill(materialize(sources, "sources"), max_epochs=max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "_s").drop("weight"), "plan")
    at = plan.where(f"rest > 0 AND whole < {int(max_epochs)}").select("_s", "rest", F.lit(0).cast("long").alias("base"), F.lit(None).cast("long").alias("prefix"))
    for k, level in enumerate(LEVELS):
        if k:
            inside = _with(sized, at.select("_s", "prefix")).where(F.shiftright("h", LEVELS[k - 1]) == F.col("prefix"))
            sums = inside.groupBy("source", F.shiftright("h", level).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        found = _with(sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))), at.select("_s", "rest", "base"))
        found = found.withColumn("base", F.col("base") + F.col("before")).where("base < rest AND rest <= base + words")
        at = materialize(found.select(F.col("source").alias("_s"), "rest", "base", F.col("b").alias("prefix"), "words", "n"), "cuts")
    taken = F.round((F.col("rest") - F.col("base")) / (F.col("words") / F.col("n"))).cast("long")  # of the documents at the cut, to the nearest
    cuts = _last(sized, materialize(at.select("_s", F.col("prefix").alias("cut"), taken.alias("some"), "n"), "cuts"))
    cuts = cuts.select(F.col("_s").alias("_c"), "cut", "last")
    return materialize(plan.join(cuts, F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c", "rest"), "plan")


def _copies() -> Column:
    """How often a row is taken; h, row, whole, cut and last are its columns."""
    at_cut = (F.col("h") == F.col("cut")) & (F.col("row") <= F.col("last"))
    return F.col("whole") + F.coalesce((F.col("h") < F.col("cut")) | at_cut, F.lit(False)).cast("long")


def _sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    return materialize(docs.select(*more, "source", word_count("text").alias("size"), _order(seed).alias("h"), F.monotonically_increasing_id().alias("row")), "sized")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    A source's target over its size gives epochs e: every document is taken floor(e) times whole, and once more for
    the documents first in a seeded hash order until their words fill the fraction, to the nearest document. That is a limit on the hash,
    exact for each source, found from sums by the hash's upper bits; so a hot source never meets in one task, and what is
    taken is then a map over the documents.

    weights(source, weight) overrides the cycle; sources that it lacks get 0. Null text has size 0 and is a document
    like others; null source is a source, last in order; rows with a null or repeated id have places by their texts, and of rows that
    repeat both as many are taken, where the limit falls among them, as come nearest to it; an empty table gives no rows. Other columns of docs are left
    out, so none can clash.
    """
    sized = _sized(docs, seed, "doc_id")
    rows = _with(sized, _plan(sized, weights, max_epochs, cycle)).withColumn("copies", _copies())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: each row of docs, all its columns whatever their names, as often as mix_sources takes it, nulls and ties as there.
    The limits come from narrow rows; texts are then mapped, not shuffled. docs is a table that has been written, so that its rows come in the same parts twice.
    An empty table gives no rows."""
    plan = _plan(_sized(docs, seed), weights, max_epochs, cycle)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", _order(seed).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = _with(rows, plan).select("doc", _copies().cast("int").alias("copies"))
    return rows.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")
