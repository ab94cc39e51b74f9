"""Embedding near-dedup: a pivot-permutation index with inverted lists, shared-pivot counts and a verification in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from docloom.llm.common import components, lean, materialize, ship, unite

#: A vector is described by its NEAREST pivots in order; two vectors are candidates when they share at least SHARED of them.
NEAREST, SHARED = 6, 2
#: Pivots grow with the root of the rows within these bounds; DRAW rows are drawn for each pivot.
MIN_PIVOTS, MAX_PIVOTS, DRAW = 64, 32_768, 4
#: Numbers of pivots are below this.
BASE = 1 << 20
#: No two pivots have this cosine or more. Rows this near to a hub, a pivot with others so near, are compared with all that can link with them.
APART = 0.8
#: Hubs are taken while a drawn row lies within reach of at most this many on average.
REACHED = 8.0
#: Rows of a list that meet in one cell are at most twice this; longer lists are dealt over a grid of cells.
CELL = 2048


def rows_of(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Rows with a vector that has a direction: not null, not empty, all components finite, some not zero; as double."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good, out = [], []
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(column)):
        x = flat[at[i] : at[i + 1]]
        if len(x) and np.isfinite(x).all() and x.any():
            good.append(i)
            out.append(x)
    return good, out


def unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1, keepdims=True)  # squares neither overflow nor vanish
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def nearest(X: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the count nearest pivots of each row, nearest first; ties by number."""
    sim = X @ pivots.T
    count = min(count, len(pivots))
    top = np.sort(np.argpartition(-sim, count - 1, axis=1)[:, :count], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, 1), axis=1, kind="stable"), 1)


def list_keys(order: np.ndarray, shared: int) -> np.ndarray:
    """The lists of each row: one for each choice of ``shared`` (1 or 2) of its pivots, a number for each."""
    if shared == 1 or order.shape[1] < 2:
        return order.astype(np.int64)
    i, j = np.triu_indices(order.shape[1], 1)
    return joint(order[:, i], order[:, j])


def joint(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(p, q).astype(np.int64) * BASE + np.maximum(p, q)


def reach(least: float) -> float:
    """The least cosine to a hub of whatever links with a row at APART from it: the angles add up."""
    return float(np.cos(min(np.pi, np.arccos(APART) + np.arccos(np.clip(least, -1, 1))))) - 1e-9


def choose(sample: np.ndarray, wanted: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` pivots of the sample, in its order and kept apart, and the numbers of those that are hubs, the fullest first."""
    taken = np.empty((wanted, sample.shape[1]))
    n = 0
    for a in range(0, len(sample), 256):
        part = sample[a : a + 256]
        before = n
        for x in part[(part @ taken[:n].T).max(1) < APART] if n else part:
            if n < wanted and (n == before or (taken[before:n] @ x).max() < APART):
                taken[n] = x
                n += 1
    near, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for s in range(0, len(sample), 1024):
        sim = sample[s : s + 1024] @ taken[:n].T
        near += (sim >= APART).sum(0)
        far += (sim >= reach(least)).sum(0)
    order = np.argsort(-near, kind="stable")
    order = order[near[order] > 1]
    return taken[:n], order[np.cumsum(far[order]) <= REACHED * len(sample)]


def _index(shared_pivots, nearest_count: int, shared: int, least: float, kind: type):
    """Rows (dim, list, id, copies, x, order, home): of a vector far from all hubs one for each of its lists, with its nearest pivots in
    order; of one near a hub's reach one for the hub, without. x is the vector as it is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, vectors = rows_of(batch.column("embedding"))
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                these = np.flatnonzero(dims == dim)
                # A length that the sample lacks: one list for all.
                pivots, hubs = shared_pivots.value.get(int(dim), (np.eye(1, int(dim)), np.zeros(0, np.int64)))
                raw = np.stack([vectors[i] for i in these])
                X = unit(raw)
                to_hubs = X @ pivots[hubs].T
                home = np.full(len(X), -1)
                if len(hubs):
                    home = np.where(to_hubs.max(1) >= APART, hubs[to_hubs.argmax(1)], -1)
                loose = np.flatnonzero(home < 0)
                order = nearest(X[loose], pivots, nearest_count).astype(np.int32)
                keys = list_keys(order, shared)
                n, m = keys.shape[1], order.shape[1]
                ball_row, ball = np.nonzero(to_hubs >= reach(least))
                each = np.concatenate([np.repeat(loose, n), ball_row])
                flat = np.ascontiguousarray(raw.astype(kind))
                stored = pa.Array.from_buffers(pa.binary(), len(X), [None, pa.py_buffer((np.arange(len(X) + 1) * flat.itemsize * int(dim)).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                at = pa.array(np.array(good)[these][each])
                ends = np.minimum(np.arange(len(each) + 1), len(loose) * n) * m
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(each), dim, np.int32)), pa.array(np.concatenate([keys.ravel(), -1 - hubs[ball]])), batch.column("id").take(at), batch.column("copies").take(at), stored.take(pa.array(each)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.repeat(order, n, axis=0).ravel())), pa.array(home[each].astype(np.int32))],
                    ["dim", "list", "id", "copies", "x", "order", "home"],
                )

    return run


def counted_in(order: np.ndarray, p: np.ndarray, q: np.ndarray, shared: int) -> np.ndarray:
    """The list in which each pair of rows (p, q) counts: of the pivots that both have, the first in the order of the first row."""
    first, second = order[np.minimum(p, q)], order[np.maximum(p, q)]
    both = (first[:, :, None] == second[:, None, :]).any(2)
    rows = np.arange(len(p))
    u = both.argmax(1)
    if shared == 1 or order.shape[1] < 2:
        return first[rows, u].astype(np.int64)
    both[rows, u] = False
    return joint(first[rows, u], first[rows, both.argmax(1)])


def compare(ids: np.ndarray, X: np.ndarray, order: np.ndarray, block: np.ndarray, copies: np.ndarray, here: int, cell: tuple[int, int], least: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found in a cell, rows by ascending id: for each row the copies of the rows linked with it, and the least id of its group.

    Candidates are the pairs whose count of shared pivots is at least ``shared``; those are verified.
    """
    n = len(ids)
    found, label, step = np.zeros(n, np.int64), np.arange(n), 256
    local, at = np.unique(order, return_inverse=True)
    holds = np.zeros((n, len(local)), np.float32)
    holds[np.arange(n)[:, None], at.reshape(order.shape)] = 1
    least_count = min(shared, order.shape[1])
    for a in range(0, n, step):
        candidate = holds[a : a + step] @ holds.T >= least_count
        i, j = np.nonzero(candidate & (X[a : a + step] @ X.T >= least - 1e-12))
        i += a
        keep = ids[i] != ids[j]
        if cell[0] != cell[1]:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        exact = np.concatenate([(X[i[s : s + 65536]] * X[j[s : s + 65536]]).sum(1) >= least for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[exact], j[exact]
        for s in range(0, len(i), 1 << 14):
            p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            own = counted_in(order, p, q, shared) == here
            p, q = p[own], q[own]
            np.add.at(found, p, copies[q])
            label = unite(label, p, q)
    return found, ids[label]


def compare_ball(ids: np.ndarray, X: np.ndarray, home: np.ndarray, core: np.ndarray, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same in a cell of a hub: links of the ``core`` entries, rows at home there, with the others, rows in reach. Each entry of a row at home counts as
    core alone; one at home elsewhere counts its links there; one in no home counts them here. A row may be there twice, as both."""
    found, label, step = np.zeros(len(ids), np.int64), np.arange(len(ids)), 256
    twice = np.flatnonzero(ids[1:] == ids[:-1])
    label = unite(label, twice, twice + 1)
    mine, others = np.flatnonzero(core), np.flatnonzero(~core)
    Y, weight, free = X[others], copies[others].astype(float), home[others] < 0
    for a in range(0, len(mine), step):
        rows = mine[a : a + step]
        sim = X[rows] @ Y.T
        link = sim >= least + 1e-12
        i, j = np.nonzero((sim >= least - 1e-12) & ~link)
        for s in range(0, len(i), 65536):
            p, q = i[s : s + 65536], j[s : s + 65536]
            link[p, q] = (X[rows[p]] * Y[q]).sum(1) >= least
        link &= ids[rows, None] != ids[others]
        found[rows] = (link @ weight).astype(np.int64)
        found[others] += np.where(free, copies[rows].astype(float) @ link, 0).astype(np.int64)
        i, j = np.nonzero(link & (label[rows, None] != label[others]))
        label = unite(label, rows[i], others[j])
    return found, ids[label]


def _cells(least: float, shared: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(t) < 2:
                return
            t = t.sort_by("id")
            ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
            X = unit(np.frombuffer(b"".join(t["x"].to_pylist()), kind).astype(np.float64).reshape(len(t), -1))
            here, cell = t["list"][0].as_py(), (t["i"][0].as_py(), t["j"][0].as_py())
            if here < 0:
                found, low = compare_ball(ids, X, t["home"].to_numpy(), t["core"].to_numpy(zero_copy_only=False), copies, least)
            else:
                order = np.stack(t["order"].to_numpy(zero_copy_only=False))
                found, low = compare(ids, X, order, t["block"].to_numpy(), copies, here, cell, least, shared)
            hit = (found > 0) | (low != ids)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(found[hit]), pa.array(low[hit])], ["id", "links", "low"])

        kept: list[pa.RecordBatch] = []  # of the cell that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "list", "i", "j")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            if kept and any(kept[-1].column(c)[-1].as_py() != key[0, k] for k, c in enumerate(("dim", "list", "i", "j"))):
                yield from out(pa.Table.from_batches(kept))
                kept = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                if b == len(key):
                    kept.append(part)
                elif kept:
                    yield from out(pa.Table.from_batches([*kept, part]))
                    kept = []
                elif b - a > 1:
                    yield from out(pa.Table.from_batches([part]))
        if kept:
            yield from out(pa.Table.from_batches(kept))

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, nearest_count: int = NEAREST, shared: int = SHARED, pivots: int | None = None, cell: int = CELL, seed: int = 9) -> DataFrame:
    """One row for each row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link when their cosine in double precision is at least ``least``. Those that are null, empty or zero, or that
    hold a null or non-finite component, link with nothing; vectors of different lengths never link. n_links counts the
    other rows linked directly, copies included; component_id is the smallest vec_id reachable; kept is vec_id =
    component_id. vec_id is a whole number; rows that repeat one link like any others, null ids have no links, no component
    and are kept. An empty table gives no rows; other columns are left out.

    Equal vectors are one node with a number of copies. Pivots are a seeded draw of about twice the root of the nodes,
    at most MAX_PIVOTS, kept apart; a vector's description is its nearest ones in order; every choice of ``shared`` of them
    is an inverted list, so vectors in a common list share that many pivots. A pivot that has other drawn rows close by is a
    hub: a vector at APART or nearer to one is in no list but at home there, and is compared with every vector whose angle to
    the hub lets the two link (rows at home against those, not those with each other), so it loses no link; links of two vectors far from all hubs can be missed. Lists longer than ``cell`` are dealt over a grid
    of cells, each of two blocks, so none grows with the group. A cell compares its rows by one matrix product and tells
    of each row how many links it found and the least id of the group that its links form there, not the pairs; a pair
    counts in the least list that it shares. The groups of all cells are joined into components.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType == FloatType() else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    nodes = materialize(rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")
    count = nodes.count()
    wanted = pivots or int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * count**0.5)))
    drawn = nodes.select("embedding").orderBy(F.xxhash64(F.lit(seed), "id")).limit(DRAW * wanted).toPandas() if count else None
    table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if count:
        _, sample = rows_of(pa.array(drawn["embedding"].tolist(), pa.list_(pa.float64())))
        for dim in {len(x) for x in sample}:
            these = unit(np.stack([x for x in sample if len(x) == dim]))
            table[dim] = choose(these, -(-wanted * len(these) // len(sample)), least)
    index = nodes.mapInArrow(lean(_index(spark.sparkContext.broadcast(table), nearest_count, shared, least, kind)), "dim int, list long, id long, copies long, x binary, order array<int>, home int")
    index = materialize(index, "index")
    # Of a hub's list (below 0) only the rows at home are compared with all: without any it is left out, and its grid is one of blocks of those by blocks of all.
    at_home = F.col("list") == -1 - F.col("home")
    full = index.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("c"), F.count_if(at_home).alias("h")).where("c > 1 AND (list >= 0 OR h > 0)")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(cell)).cast("int")
    cells = index.join(full, ["dim", "list"]).withColumns({"g": blocks("c"), "gh": F.greatest(F.lit(1), blocks("h"))})
    cells = cells.withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("home_block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("gh")).cast("int"))
    to = lambda i, j, core: F.struct(i.alias("i"), j.alias("j"), F.lit(core).alias("core"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = F.transform(upto("g"), lambda o: to(F.least("block", o), F.greatest("block", o), False))
    reached = F.transform(upto("gh"), lambda o: to(o, F.col("block"), False))
    own = F.transform(upto("g"), lambda o: to(F.col("home_block"), o, True))
    cells = cells.withColumn("to", F.explode(F.when(F.col("list") >= 0, pairs).when(at_home, F.concat(reached, own)).otherwise(reached)))
    cells = cells.select(*index.columns, "block", "to.*")
    found = cells.repartition("dim", "list", "i", "j").sortWithinPartitions("dim", "list", "i", "j").mapInArrow(lean(_cells(least, shared, kind)), "id long, links long, low long")
    found = materialize(found, "found")
    comps = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = nodes.join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    empty = F.expr("size(filter(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('inf'))) > 0 OR NOT exists(embedding, v -> v <> 0)")
    named = nodes.select("embedding", F.when(~empty, F.coalesce("comp", "id")).alias("comp"), (F.when(~empty, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)).alias("n_links"))
    out = rows.join(materialize(named.where("n_links > 0"), "named"), "embedding", "left")
    own = F.coalesce("comp", "vec_id")
    return out.select(
        F.col("vec_id"), F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), own).alias("component_id"), F.when(F.col("vec_id").isNotNull(), F.col("vec_id") == own).otherwise(True).alias("kept"),
    )
