"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists of retained values, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textbytes as tb
from docloom.llm.common import bit_filter, bit_hit, components, lean, materialize, ship, unite

U = np.uint64
#: Retained values of a sketch, and how many of them open lists. Two sets of Jaccard 0.8 have none of the lowest RETAIN in common
#: with a chance of 0.2 ** RETAIN (4e-9).
SKETCH, RETAIN = 48, 12
#: Sketches' values are counted in this many buckets (a power of two); the counts go to every worker, 8 MB whatever the input.
BUCKETS = 1 << 20
#: A value is common if its bucket holds more values than this, and than this many times the mean: sets with enough others go by those.
HOT, HOT_MEANS = 128, 8
#: Rows of a block of a cell.
BLOCK = 1024
#: A set of which less than this part of the sketch is uncommon opens its common lists as well.
UNCOMMON = 0.75
#: Neighbourhoods of more members take in the sets of other ones that may be like some of them as guests, for their cells.
CROWD = 16
#: Leaders take in sets from this percentage of the threshold on: more than the estimate asks for, so that near misses lie in one neighbourhood.
NEAR = 75
#: Standard deviations of an estimate below the threshold that still go to the exact check.
SIGMAS = 5.0


def sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending (63 bits), and their offsets."""
    low = tb.LOWER[data]
    starts, ends, own = tb.words(low, at, tb.SPACE)
    h, sh = tb.shingles(tb.word_hashes(low, starts, ends), own, width)
    h >>= U(1)
    each = [np.unique(h[a:b]) for a, b in zip(sh[:-1], sh[1:])]
    return (np.concatenate(each) if each else h), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)


#: Columns of a set's signature, 64 bits each.
SIGNATURE = ["sig0", "sig1", "sig2", "sig3"]


def signature(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """256 bits of each set in four numbers: the lowest bit of the least value in each of 256 ranges of values.

    Sets of Jaccard J differ in about 128 (1 - J) of them, and never in more than they have values of their own.
    """
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    bin_ = values >> U(55)
    first = np.ones(len(values), bool)
    first[1:] = (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])
    bit = np.where(first, (values & U(1)) << (bin_ & U(63)), U(0))
    return [tb.sum_by(np.where(bin_ >> U(6) == k, bit, U(0)), at).view(np.int64) for k in range(len(SIGNATURE))]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tb.pieces(*tb.strings(batch.column("text"))):
                v, own = sets(data, at, width)
                n = np.diff(own)
                keep = np.arange(len(v)) - np.repeat(own[:-1], n) < SKETCH
                cut = np.concatenate([[0], np.cumsum(np.minimum(n, SKETCH))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("h").slice(i, j - i), pa.array(n), tb.set_keys(v, own), *map(pa.array, signature(v, own)), tb.longs(v[keep], cut)],
                    ["doc_id", "h", "n", "k", *SIGNATURE, "sketch"],
                )

    return run


def _full_sets(width: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(bit_hit(shared.value, batch.column("h").to_numpy()))
            for _, _, data, at in tb.pieces(*tb.strings(batch.column("text").filter(hit))):
                v, own = sets(data, at, width)
                yield pa.RecordBatch.from_arrays([tb.set_keys(v, own), tb.longs(v, own)], ["k", "s"])

    return run


def _openers(shared, hot_above: int | None):
    """Rows (id, n, the signature, pop, vs) of nodes: vs are the lists that a set opens. Values that no other set has open none.

    Without hot_above a set opens its lowest RETAIN values, and pop tells how common its values are: of a group of copies with edits the
    one with the fewest edits has the most. With it, a set opens the lowest of those in buckets of at most so many values, and the plain
    ones too where less than UNCOMMON of the sketch is such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            lists = batch.column("sketch")
            v = lists.flatten().to_numpy()
            n = lists.value_lengths().to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            row, start = np.repeat(np.arange(len(n)), n), np.repeat(at[:-1], n)
            seen = counts[v & (len(counts) - 1)]
            pop = (1000 * tb.sum_by(np.log2(np.maximum(seen, 1)), at) / np.maximum(n, 1)).astype(np.int64)
            use = np.arange(len(v)) - start < RETAIN
            if hot_above is not None:
                rare = seen <= hot_above
                before = np.concatenate([[0], np.cumsum(rare)])
                poor = tb.sum_by(rare.astype(np.int64), at) < UNCOMMON * n
                use = (rare & (before[1:] - before[start] <= RETAIN)) | (poor[row] & use)
            use &= seen > 1
            cut = np.concatenate([[0], np.cumsum(tb.sum_by(use.astype(np.int64), at))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", *SIGNATURE)), pa.array(pop), tb.longs(v[use], cut)], ["id", "n", *SIGNATURE, "pop", "vs"])

    return run


def overlaps(A: list[np.ndarray], B: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of two lists of sets, by matrix products over the values that stand in both lists."""
    a, b = np.concatenate(A), np.concatenate(B)
    values = np.intersect1d(a, b)
    out = np.zeros((len(A), len(B)), np.float32)

    def places(flat: np.ndarray, sets_: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets_)), [len(x) for x in sets_])
        at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
        hit = values[at] == flat if len(values) else np.zeros(len(flat), bool)
        return row[hit], at[hit]

    (ra, ca), (rb, cb) = places(a, A), places(b, B)
    for first in range(0, len(values), step):
        M, N = np.zeros((len(A), step), np.float32), np.zeros((len(B), step), np.float32)
        for rows, cols, into in ((ra, ca, M), (rb, cb, N)):
            own = (cols >= first) & (cols < first + step)
            into[rows[own], cols[own] - first] = 1
        out += M @ N.T
    return out


def _cells(percent: int, step: int = 256):
    """Edges (a, b) that join the rows of each cell (hood, i, j), those that are open with all, as their links do; rows are sorted by cell."""

    def groups(t: pa.Table) -> pa.RecordBatch | None:
        ids, place = np.unique(t["id"].to_numpy(), return_inverse=True)
        open_ = t["open"].to_numpy(zero_copy_only=False)
        sets_ = t["s"].combine_chunks()
        values, size = sets_.flatten().to_numpy(), sets_.value_lengths().to_numpy().astype(np.int64)
        each = np.split(values, np.cumsum(size)[:-1])
        label, left, right = np.arange(len(ids)), np.flatnonzero(open_), np.flatnonzero(~open_)
        for a in range(0, len(left), step):
            for b in range(0, len(right), step):
                A, B = left[a : a + step], right[b : b + step]
                both = overlaps([each[k] for k in A], [each[k] for k in B]).astype(np.int64)
                p, q = np.nonzero(100 * both >= percent * (size[A][:, None] + size[B][None, :] - both))
                label = unite(label, place[A[p]], place[B[q]])
        moved = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"]) if moved.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the cell that goes on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("hood", "i", "j")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if kept and tuple(key[a]) != last:
                    if (found := groups(pa.Table.from_batches(kept))) is not None:
                        yield found
                    kept = []
                kept.append(batch.slice(a, b - a))
                last = tuple(key[a])
        if kept and (found := groups(pa.Table.from_batches(kept))) is not None:
            yield found

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of ``width`` words (lower-cased A-Z, parted by ASCII whitespace); with fewer
    words the whole sequence is one; null, empty and blank texts have an empty set and link with nothing. Sets link when
    100 * intersection >= percent * union, on full sets. component_id is the smallest doc_id reachable, kept is doc_id =
    component_id (null-safe; a null id is smallest only of a component of nulls). Rows that repeat an id and a text agree
    and are both kept; an empty table gives no rows; other columns are left out.

    Equal sets are one node from the start. Then two rounds of candidates:

    1. Neighbourhoods. Each list (a retained value, within a range of set sizes) compares its members with one leader, the
       member whose values are the most common, which in a group of copies with edits is the one nearest to the others. Pairs
       with an estimate near the threshold or above join nodes into neighbourhoods. Of each the member with the most common values is
       checked against all others, on full sets; those that link with it are one group. Only the ones left open are then checked against
       the whole neighbourhood, dealt over grids of cells of at most two blocks, by matrix products; a cell tells of its groups, not its pairs.
       What shares a list with a neighbourhood of more than CROWD members, and by the distance from its leader may be like one of them, is
       its guest: guests are left open in its cells too, so a stray of a large group makes no pair with each of its members.
    2. Lists that hold several neighbourhoods are joined with themselves, one side without the list's largest, for pairs of
       different neighbourhoods only, and without the pairs of guests. Values in very full buckets are replaced by a set's next lowest
       others; sets that consist of such values to a good part open both. No list is cut.

    Pairs must agree in size and in a 256-bit signature within the join, then in the estimate from the union's lowest
    SKETCH values, then exactly; full sets are computed again from the texts of those in question only, behind a bitmap
    of fixed size. A pair just at the threshold is missed with a chance below 1e-5; pairs above it, far less.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, share = docs.schema["doc_id"].dataType.simpleString(), percent / 100
    longs = ", ".join(f"{c} long" for c in SIGNATURE)
    source = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text")
    rows = materialize(source.mapInArrow(lean(_sketches(width)), f"doc_id {kind}, h long, n long, k binary, {longs}, sketch array<long>"), "sketches")
    reps = rows.where("n > 0").groupBy("k").agg(F.min("h").alias("h"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in SIGNATURE], F.first("sketch").alias("sketch"))
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "reps")  # ids are fixed as they are written

    def farthest(m: str, n: str, least: int) -> str:
        """In how many bits signatures of sets of m and n values differ at most, for a Jaccard of least percent."""
        apart = (100 - least) / 200
        most = int(np.ceil(256 * apart + 5.6 * np.sqrt(256 * apart * (1 - apart))))
        return f"least({most}, ({m} + {n}) * {100 - least} div {100 + least})"

    def alike(a: str, b: str, least: int = percent) -> str:
        """What sets of a Jaccard of least percent satisfy by size and signature: by 5.6 standard deviations, and surely for small sets."""
        differ = " + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in SIGNATURE)
        return f"100 * least({a}n, {b}n) >= {least} * greatest({a}n, {b}n) AND {differ} <= {farthest(f'{a}n', f'{b}n', least)}"

    slack = SIGMAS * float(np.sqrt(share * (1 - share) / SKETCH))

    def estimated(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) of nodes whose estimate is near the threshold or above, exactly so for sets that are their sketches."""
        side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        whole = f"na <= {SKETCH} AND nb <= {SKETCH}"
        union = F.array_sort(F.array_union("sa", "sb"))
        close = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("u", F.expr(f"IF({whole}, 1000000, {SKETCH})"))
        close = close.withColumn("u", F.slice(union, F.lit(1), F.col("u")))
        close = close.withColumn("j", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))) / F.size("u"))
        return materialize(close.where(F.col("j") >= F.expr(f"IF({whole}, {share - 1e-9}, {share - slack})")).select("a", "b"), "close")

    def full_sets(ids: DataFrame) -> DataFrame:
        """id and s, all values of the nodes ids(id): read from the texts again, of one document for each node."""
        asked = ids.join(reps.select("id", "k", "h"), "id")
        bitmap = spark.sparkContext.broadcast(bit_filter(asked.select("h")))
        full = source.mapInArrow(lean(_full_sets(width, bitmap)), "k binary, s array<long>")
        return full.join(asked.select("id", "k"), "k").select("id", "s").dropDuplicates(["id"])

    def verified(close: DataFrame) -> DataFrame:
        """Links among pairs (a, b)."""
        full = materialize(full_sets(close.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
        both = close.join(full.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(full.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
        both = both.withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return materialize(both.where(F.col("i") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b"), "links")

    bucketed = reps.select(F.explode("sketch").alias("v")).groupBy(F.col("v").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count().toArrow()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[bucketed["b"].to_numpy()] = bucketed["count"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    # Leaders, in two divisions of the sizes into ranges, so that no group is parted in both.
    slim = reps.select("id", "n", *SIGNATURE, "sketch")
    schema = f"id long, n long, {longs}, pop long, vs array<long>"
    opened = materialize(slim.mapInArrow(lean(_openers(shared, None)), schema).where("size(vs) > 0"), "opened")
    pairs: DataFrame | None = None
    for shift in (0.0, 0.5):
        ranged = opened.withColumn("range", F.floor(F.ln("n") / F.lit(float(np.log(1.5))) + F.lit(shift)).cast("int")).withColumn("v", F.explode("vs")).drop("vs")
        leaders = ranged.groupBy("v", "range").agg(F.max(F.struct("pop", "id", "n", *SIGNATURE)).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        found = ranged.join(leaders, ["v", "range"]).where(f"id <> l.id AND {alike('', 'l.', percent * NEAR // 100)}").select(F.col("l.id").alias("a"), "id")
        pairs = found if pairs is None else pairs.union(found)
    hoods = components(estimated(pairs.select("a", F.col("id").alias("b")).distinct()))
    members = hoods.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    hoods = materialize(hoods.join(members, "comp").select(F.col("node").alias("id"), F.col("comp").alias("hood"), "members"), "hoods")

    # Lists that hold several neighbourhoods. Rows that are not of the largest, but may be like some of its members, go to its cells.
    hot_above = int(max(HOT, HOT_MEANS * counts.mean()))
    lead = opened.select("id", "pop", *SIGNATURE).join(hoods, "id").groupBy("hood").agg(F.max(F.struct("pop", "id", *SIGNATURE)).alias("l"))
    lead = materialize(lead, "lead")
    opened = slim.mapInArrow(lean(_openers(shared, hot_above)), schema).where("size(vs) > 0").join(hoods, "id", "left")
    opened = materialize(opened.select("id", "n", *SIGNATURE, F.coalesce("hood", "id").alias("hood"), F.coalesce("members", F.lit(1).cast("long")).alias("members"), "vs"), "opened")
    listed = opened.withColumn("v", F.explode("vs")).drop("vs")
    several = listed.groupBy("v").agg(F.min("hood").alias("lo"), F.max("hood").alias("hi"), F.max(F.struct("members", "hood")).alias("most")).where("lo <> hi")
    several = several.select("v", F.col("most.hood").alias("most"), (F.col("most.members") > CROWD).alias("crowd"))
    mixed = materialize(listed.join(several, "v").drop("members"), "mixed")
    apart = " + ".join(f"bit_count({c} ^ l.{c})" for c in SIGNATURE)
    around = slim.join(hoods.where(f"members > {CROWD}"), "id").join(lead, "hood").groupBy(F.col("hood").alias("home"))
    around = around.agg(F.first("l").alias("l"), F.expr(f"max({apart})").alias("reach"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    # What is like a member is no farther from the leader than from the member and the member from the leader.
    near = f"100 * hi >= {percent} * n AND 100 * n >= {percent} * lo AND {apart} <= reach + {farthest('n', 'hi', percent)}"
    guests = mixed.where("crowd AND hood <> most").select("id", "n", *SIGNATURE, F.col("most").alias("home")).distinct().join(around, "home").where(near)
    guests = materialize(guests.select("home", "id"), "guests")

    # All of a neighbourhood against its leader, then what that leaves open, and the guests, against all of it and the guests.
    full = materialize(full_sets(hoods.select("id").union(guests.select("id")).distinct()), "full")
    own = full.join(hoods, "id")
    first = full.select("id", F.col("s").alias("ls")).join(lead.select("hood", F.col("l.id").alias("id")), "id").withColumnRenamed("id", "leader")
    both = F.size(F.array_intersect("s", "ls"))
    met = own.join(first, "hood").where("id <> leader").select("hood", "id", "leader", (both * 100 >= percent * (F.size("s") + F.size("ls") - both)).alias("linked"))
    met = materialize(met, "met")
    links = met.where("linked").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    visits = guests.withColumnRenamed("home", "hood")
    open_ = met.where("NOT linked").select("hood", "id").union(visits.select("hood", "id"))
    sizes = open_.groupBy("hood").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("g_open"))
    sizes = sizes.join(members.withColumnRenamed("comp", "hood"), "hood").join(visits.groupBy("hood").agg(F.count(F.lit(1)).alias("more")), "hood", "left")
    sizes = sizes.select("hood", "g_open", F.ceil((F.col("members") + F.coalesce("more", F.lit(0))) / F.lit(BLOCK)).cast("int").alias("g_all"))
    partly = own.select("hood", "id", "s").union(full.join(visits, "id").select("hood", "id", "s")).join(sizes, "hood")
    dealt = lambda g: F.pmod(F.xxhash64("id"), F.col(g)).cast("int")
    blocks = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    each = partly.select("hood", blocks("g_open").alias("i"), dealt("g_all").alias("j"), F.lit(False).alias("open"), "id", "s")
    those = partly.join(open_, ["hood", "id"], "left_semi").select("hood", dealt("g_open").alias("i"), blocks("g_all").alias("j"), F.lit(True).alias("open"), "id", "s")
    cells = each.unionByName(those).repartition("hood", "i", "j").sortWithinPartitions("hood", "i", "j", "open", "id")
    links = links.union(cells.mapInArrow(lean(_cells(percent)), "a long, b long"))
    links = materialize(links, "links")

    # What else lies between neighbourhoods: the cells have compared a list's guests with its largest neighbourhood and with each other.
    marked = mixed.join(guests.select(F.col("home").alias("most"), "id", F.lit(True).alias("guest")), ["most", "id"], "left").fillna(False, ["guest"])
    join = f"a.v = b.v AND a.hood <> b.hood AND (b.hood = b.most OR a.id < b.id) AND NOT (a.guest AND (b.guest OR b.hood = b.most)) AND {alike('a.', 'b.')}"
    pairs = marked.where("hood <> most").alias("a").join(marked.alias("b"), F.expr(join)).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    close = estimated(pairs)
    nodes = components(links.union(verified(close)) if close.limit(1).count() else links)

    keys = reps.select("id", "k").join(nodes.withColumnRenamed("node", "id"), "id").select("k", "comp")
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), "k").join(keys, "k", "left")
    # Nodes without links have their set as component: its copies.
    named = named.withColumn("comp", F.expr("IF(n_shingles > 0, coalesce(cast(concat('#', comp) AS binary), k), NULL)")).drop("k")
    least = materialize(named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "least")
    out = named.join(least, "comp", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
