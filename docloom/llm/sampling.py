"""Bounded samples of labelled rows for fitting; everything else reads all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stratified(rows: DataFrame, label: str, key: Column, per_class: int, seed: int = 5) -> DataFrame:
    """About per_class rows of each label value, at most twice as many in all, by a seeded hash of key: no sort, no shuffle of
    texts. The driver holds a count for each label value."""
    sizes = rows.groupBy(label).count().orderBy(label).collect()
    if not sizes:
        return rows.limit(0)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(per_class / r["count"]))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53)
    return rows.where(draw < F.coalesce(F.element_at(share, F.col(label)), F.lit(0.0))).limit(2 * per_class * len(sizes))
