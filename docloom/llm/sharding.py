"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize

#: Parts of a shard within which slots are counted; offsets are then shards x PARTS rows, whatever the input.
PARTS = 512


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The shard (0-based) with the least -ln(u) / weight, u in (0, 1) from a hash of key and shard.

    A shard that is added, or whose weight rises, only takes records; the records of a removed one spread over the
    others. With equal weights the order of -ln(u) is the reverse order of u, so the logarithm is skipped. A shard of
    weight 0 gets nothing. Null keys hash as one value.
    """
    if not weights or min(weights) < 0 or not max(weights) > 0:
        raise ValueError("weights must be at least 0, one of them above")
    live, tries = [(s, w) for s, w in enumerate(weights) if w > 0], []
    for s, w in live:
        h = F.xxhash64(F.lit(salt), F.lit(s), F.coalesce(key.cast("string"), F.lit("\u0000null")))
        if len({w for _, w in live}) == 1:
            cost: Column = h
        else:
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
            cost = -F.ln(u) / F.lit(float(w))
        tries.append(F.struct(cost.alias("cost"), F.lit(s).alias("shard")))
    return F.array_min(F.array(*tries))["shard"] if len(tries) > 1 else F.lit(live[0][0])


def shard_records(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes (size 8, crc32 0), like an empty one. Slots run
    from 0 without gaps in every shard, by (part, doc_id): a shard is split into PARTS parts by another hash of the
    key and of the row's number as written, so rows of one id, or none, are spread over all parts; rows are numbered within a part, and the
    parts' offsets come from counts, at most shards x PARTS rows. Repeated ids meet in one shard with slots of their own; null ids share a
    shard; an empty table gives no rows; other columns are left out. Law ``key``: doc_id and the shard count decide; grown_shard is the shard with one more, of grown_weight.
    """
    weights = list(weights or [1.0] * shards)
    more = [*weights, float(grown_weight if grown_weight is not None else weights[-1])]
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    placed = sized.withColumns({"shard": rendezvous(F.col("doc_id"), weights), "grown_shard": rendezvous(F.col("doc_id"), more), "_r": F.monotonically_increasing_id()})
    placed = materialize(placed, "placed").withColumn("_p", F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id").cast("string"), "_r"), F.lit(PARTS)).cast("int"))
    counts = placed.groupBy("shard", "_p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(F.col("shard").alias("_s"), F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "_p").orderBy("doc_id", "size", "text_crc32", "_r")) - 1
    rows = placed.withColumn("_n", number).join(F.broadcast(first), (F.col("shard") == F.col("_s")) & (F.col("_p") == F.col("_q")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_n") + F.col("first")).cast("long").alias("slot"), "grown_shard")
