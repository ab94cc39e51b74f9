"""Merkle manifest of a dataset: a tree for each group of rows, one over the groups' roots, and a witness for every row.

Rows are appended in order. A tree that is being built is a row of open subtrees, as many as its size has bits set; each holds the partial witnesses
of its leaves. Two subtrees of one height meet and extend the witnesses of each other's leaves. Blocks of 2**BITS leaves, aligned to the tree, are built by
tasks apart from each other; their roots are then appends of the next pass, whose witnesses extend those of all leaves below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import lean, materialize, ship

#: Levels of a block, which has 2**BITS leaves: what one run of a task holds.
BITS = 10
SIZE = 32  # bytes of a digest


def parent(*digests: bytes) -> bytes:
    """The digest over the hex texts of one or two digests."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


class OpenTrees:
    """Open subtrees of the leaves appended so far, at most 2**bits, each (height, root, first leaf), heights falling. The witness of a leaf has a
    slot for each height: ``witness[leaf, height]`` is the sibling that its subtree met there, if ``met`` says so."""

    def __init__(self, bits: int, room: int):
        self.open: list[tuple[int, bytes, int]] = []
        self.witness, self.met, self.size = np.zeros((room, bits, SIZE), np.uint8), np.zeros((room, bits), bool), 0

    def append(self, digest: bytes) -> None:
        self.open.append((0, digest, self.size))
        self.size += 1
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._meet()

    def _meet(self) -> None:
        (height, left, a), (_, right, b) = self.open[-2:]
        for part, sibling in ((slice(a, b), right), (slice(b, self.size), left)):
            self.witness[part, height] = np.frombuffer(sibling, np.uint8)
            self.met[part, height] = True
        self.open[-2:] = [(height + 1, parent(left, right), a)]

    def close(self, height: int) -> bytes:
        """The root at this height: the last subtree goes up alone until it meets the one before."""
        while True:
            h, digest, a = self.open[-1]
            if len(self.open) > 1 and self.open[-2][0] == h:
                self._meet()
            elif h < height:
                self.open[-1] = (h + 1, parent(digest), a)
            else:
                return digest

    def witnesses(self) -> list[bytes]:
        """The siblings of each leaf, lowest first, one behind the other."""
        return [w[m].tobytes() for w, m in zip(self.witness[: self.size], self.met)]


def height_of(n: int) -> int:
    """Levels above n nodes until one remains."""
    return max(n - 1, 0).bit_length()


def fold(digest: bytes, idx: int, n: int, siblings: bytes) -> tuple[bytes, bytes]:
    """(root, siblings not used) from node idx of n and its siblings, lowest first."""
    at = 0
    while n > 1:
        if idx % 2 or idx + 1 < n:
            sibling, at = siblings[at : at + SIZE], at + SIZE
            digest = parent(sibling, digest) if idx % 2 else parent(digest, sibling)
        else:
            digest = parent(digest)
        idx, n = idx // 2, (n + 1) // 2
    return digest, siblings[at:]


def record(columns: Sequence[str | Column]) -> Column:
    """The leaf of a row, as binary: sha256 over its columns in turn, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds idx and n: a row's place in its group g by the order, and the group's size. Ranges of (g, order) are sorted apart; a row's place is that
    within its range plus the counts of the group in the ranges before. rows is a written table, as ranges are found from a sample of it."""
    keys = ["g", *order, "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # parts rows that are equal, so no range is theirs alone
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), "ranged")
    group = Window.partitionBy("g")
    counts = ranged.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("m"), F.min("_place").alias("first"))
    before = F.coalesce(F.sum("m").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "_part", (before - F.col("first")).alias("shift"), F.sum("m").over(group).alias("n"))
    counts = materialize(counts, "counts")  # ranges + groups rows; Spark sees its size and broadcasts it only if small
    return ranged.join(counts, ["g", "_part"]).withColumn("idx", F.col("_place") + F.col("shift")).drop("_part", "_place", "shift")


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Adds to nodes(g, idx, n, digest) siblings, the witness within the block, and top, the block's root. A group of one block is closed at its
    own height, others at that of a full block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
            ends = _ends(rows, bits)
            if len(ends) > 1:
                yield from _built(rows.slice(0, ends[-2]), ends[:-1], bits)
                rows = rows.slice(ends[-2])
            rest = rows.to_batches()
        if rest:
            rows = pa.Table.from_batches(rest)
            yield from _built(rows, _ends(rows, bits), bits)

    dealt = nodes.repartition("g", F.shiftright("idx", bits)).sortWithinPartitions("g", "idx")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", siblings binary, top binary"
    return dealt.mapInArrow(lean(run), schema)


def _ends(rows: pa.Table, bits: int) -> np.ndarray:
    """Where blocks end among rows sorted by (g, idx)."""
    block, g = rows["idx"].to_numpy() >> bits, rows["g"].combine_chunks()
    other = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero((block[1:] != block[:-1]) | other) + 1, len(block))


def _built(rows: pa.Table, ends: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    digests, sizes, siblings, tops = rows["digest"].to_pylist(), rows["n"].to_pylist(), [], []
    for a, b in zip([0, *ends[:-1]], ends):
        tree = OpenTrees(bits, b - a)
        for digest in digests[a:b]:
            tree.append(digest)
        top = tree.close(min(height_of(sizes[a]), bits))
        siblings += tree.witnesses()
        tops += [top] * (b - a)
    out = rows.append_column("siblings", pa.array(siblings, pa.binary())).append_column("top", pa.array(tops, pa.binary()))
    yield from out.combine_chunks().to_batches()


def trees(nodes: DataFrame, most: int, bits: int) -> list[DataFrame]:
    """The passes over nodes(g, idx, n, digest), no group above ``most`` nodes: of each the nodes with siblings and top. The nodes of a pass are the tops of
    the one before; the last has one block a group."""
    levels = [materialize(_blocks(nodes, bits), "blocks")]
    while most > 1 << bits:
        most = -(-most >> bits)
        levels.append(materialize(_blocks(_tops(levels[-1], bits), bits), "blocks"))
    return levels


def _tops(level: DataFrame, bits: int) -> DataFrame:
    n = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
    return level.where(F.col("idx").bitwiseAND(F.lit((1 << bits) - 1)) == 0).select("g", F.shiftright("idx", bits).alias("idx"), n.alias("n"), F.col("top").alias("digest"))


def _down(levels: list[DataFrame], roots: DataFrame, bits: int) -> DataFrame:
    """The nodes of the first level with whole witnesses; roots(g, subroot, above, root, ...) has a row for each group. A parent has at most 2**bits rows below it
    at every step, so a group with most of the rows is no hot key."""
    upper = _tops(levels[-1], bits).select("g", F.col("idx").alias("_b")).join(roots, "g")
    for depth, level in enumerate(reversed(levels)):
        rows = level.withColumn("_b", F.shiftright("idx", bits)).join(upper, ["g", "_b"])
        rows = rows.withColumn("above", F.concat("siblings", "above")).drop("_b", "siblings", "top")
        if depth == len(levels) - 1:
            return rows
        upper = rows.drop("digest", "n").withColumnRenamed("idx", "_b")
    raise ValueError("no levels")


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """One row for each row of docs: doc_id (the order column), leaf, idx, n, group_idx, groups, siblings, subroot, root, and the columns of
    ``carry``, which are taken from docs. Digests are binary.

    leaf is ``record(fields)``. The leaves of a group ascend by the order column, null first; rows that repeat its value by their
    digests. Every two neighbours become their parent, a last one alone too, until one remains: subroot. Subroots in the order of their groups (null
    first, bytewise) give root in the same way. siblings is the row's witness, lowest first: ``fold`` leads from the leaf to subroot by (idx, n), then to
    root by (group_idx, groups).

    Texts are read once and never shuffled. Any column may be null or empty; repeated rows are leaves of their own; an empty table gives no rows; columns that
    are not named are left out, so none can clash. A group may hold any part of the rows.
    """
    ship(docs.sparkSession)
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # orders as the group does, null first
    carry = carry or {}
    leaves = materialize(docs.select(g.alias("g"), F.col(order).alias("_order"), record(fields).alias("digest"), F.struct(F.lit(0), *[c.alias(k) for k, c in carry.items()]).alias("_carry")), "leaves")
    levels = trees(numbered(leaves, "_order", "digest"), leaves.groupBy("g").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], bits)
    subroots = _groups(levels[-1])
    over = numbered(subroots, "_g")
    upper = trees(over, over.count(), bits)
    empty = F.lit(b"")
    roots = _down(upper, _groups(upper[-1]).select("g", F.col("digest").alias("root"), empty.alias("above")), bits)
    roots = roots.select(F.col("_g").alias("g"), F.col("idx").alias("group_idx"), F.col("n").alias("groups"), F.col("digest").alias("subroot"), "root", "above")
    rows = _down(levels, roots, bits)
    return rows.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "idx", "n", "group_idx", "groups", F.col("above").alias("siblings"), "subroot", "root", *[F.col("_carry")[k].alias(k) for k in carry])


def _groups(last: DataFrame) -> DataFrame:
    """The root of each group, as a written table of one group."""
    return materialize(last.where("idx = 0").select(F.lit("").alias("g"), F.col("g").alias("_g"), F.col("top").alias("digest")), "roots")


def folded(rows: DataFrame, leaf: str) -> DataFrame:
    """Adds folded_root to rows of ``manifest``: what the column ``leaf`` leads to by the row's siblings."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for digest, idx, n, group_idx, groups, siblings in zip(*[batch.column(c).to_pylist() for c in (leaf, "idx", "n", "group_idx", "groups", "siblings")]):
                digest, siblings = fold(digest, idx, n, siblings)
                found.append(fold(digest, group_idx, groups, siblings)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", folded_root binary"
    return rows.mapInArrow(lean(run), schema)
