"""Line dedup: an exact set-similarity join of lines with rarity order, prefix, positional, length and bitmap filters; later matches are removed."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textbytes as tb
from docloom.llm.common import bit_filter, bit_hit, lean, materialize, ship

U = np.uint64
#: Words are counted in this many buckets (a power of two) by the upper bits of their hash: the counts, not the words, go to every worker,
#: some megabytes whatever the input.
BUCKET_BITS = 18
LOW = 64 - BUCKET_BITS
#: A list's token leaves its lowest bits to the position, up to this number: tokens that differ there alone share a list, which costs
#: candidates and loses none. Later positions count as the last, which the positional filter passes.
POSITIONS = 1 << 12
#: Rows of a token's list that meet in one cell; longer lists are dealt over a grid of cells.
CELL = 4096
#: Partners up to which all of a row's pairs leave the cells for verification; of rows with more only the nearest, and if that fails they are
#: verified within the cells.
PARTNERS = 64
#: Tokens a row for which a cell of verification has room.
ROOM = 64
#: Sets of which the tokens are read that are few enough to send their documents' ids to all workers.
FEW = 1 << 14
#: Words of the widest signature.
SIGN_WORDS = 8
#: Rows of lists that are packed together before they go to their parts; rows of a part, and parts at least.
PACK, PART, PARTS = 1 << 19, 1 << 16, 256


def line_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its line counted over all texts, lines of each text, first line of each text)."""
    low = tb.LOWER[data]
    starts, ends, _ = tb.words(low, at, tb.SPACE)
    _, line_ends, n, first = line_bounds(low, at)
    words = np.diff(np.searchsorted(starts, line_ends), prepend=0)
    return tb.word_hashes(low, starts, ends), np.repeat(np.arange(len(words)), words), n, first


def line_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends of all lines, lines of each text, first line of each text)."""
    breaks = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(breaks, at)) + 1
    first = np.cumsum(n) - n
    opens, closes = np.zeros(n.sum(), bool), np.zeros(n.sum(), bool)
    opens[first], closes[first + n - 1] = True, True
    starts, ends = np.empty(len(opens), np.int64), np.empty(len(opens), np.int64)
    starts[opens], ends[closes] = at[:-1], at[1:]
    starts[~opens], ends[~closes] = breaks + 1, breaks
    return starts, ends, n, first


def line_sets(data: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each line with a word, rarest first and distinct; offsets; the lines; lines of each text; first lines).

    A token is the word's hash of 64 bits with its bucket replaced by the bucket's rank, so it loses nothing and sorts by rarity.
    """
    h, line, n, first = line_words(data, at)
    if not len(h):
        none = np.zeros(0, np.int64)
        return h, np.zeros(1, np.int64), none, n, first
    token = (rank[(h >> U(LOW)).astype(np.int64)].astype(U) << U(LOW)) | (h & U((1 << LOW) - 1))
    bits = U(64 - max(1, int(line[-1]).bit_length()))
    key = (line.astype(U) << bits) | (token >> (U(64) - bits))
    order = np.argsort(key)
    tied = (key[order[1:]] == key[order[:-1]]) & (token[order[1:]] != token[order[:-1]])
    if tied.any():  # two words of a line that the key can't tell apart
        order = np.lexsort((token, line))
    token, line = token[order], line[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    token, line = token[new], line[new]
    cut = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    return token, np.concatenate([cut, [len(token)]]), line[cut], n, first


def sign_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the signature of a set of n tokens: a power of two, so that about a third of the bits at most may differ."""
    return np.select([n <= 64, n <= 160, n <= 320], [1, 2, 4], SIGN_WORDS)


def bitmaps(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): parities of each set; two sets differ in at most as many as they have tokens of their own. Wide ones fold to narrower."""
    n = np.diff(at)
    words = sign_words(n)
    own = np.concatenate([[0], np.cumsum(words)])
    h, out = tb.mix(tokens), np.zeros(own[-1], U)
    word = (h >> U(55)).astype(np.int64) & (np.repeat(words, n) - 1)
    np.bitwise_xor.at(out, np.repeat(own[:-1], n) + word, U(1) << (h >> U(58)))
    return out, own


class Signatures:
    """Signatures of rows with n tokens, one behind the other."""

    def __init__(self, flat: np.ndarray, n: np.ndarray):
        self.flat, self.words = flat, sign_words(n)
        self.at = np.concatenate([[0], np.cumsum(self.words)])
        self.one = np.bitwise_xor.reduceat(flat, self.at[:-1]) if len(n) else flat

    def folded(self, x: np.ndarray, width: int) -> np.ndarray:
        """The signatures of x, which have width words at least, folded to width words."""
        out = self.flat[self.at[x][:, None] + np.arange(width)]
        for k in range(width, SIGN_WORDS, width):
            more = np.flatnonzero(self.words[x] > k)
            out[more] ^= self.flat[self.at[x[more]][:, None] + np.arange(k, k + width)]
        return out

    def differ(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """In how many bits x and y differ; above most not all may be counted."""
        out = np.bitwise_count(self.one[x] ^ self.one[y]).astype(np.int64)
        width = np.where(out <= most, np.minimum(self.words[x], self.words[y]), 1)
        for w in np.unique(width[width > 1]):
            these = np.flatnonzero(width == w)
            out[these] = np.bitwise_count(self.folded(x[these], w) ^ self.folded(y[these], w)).sum(1, np.int64)
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for _, _, data, at in tb.pieces(*tb.strings(batch.column("text"))):
            low = tb.LOWER[data]
            starts, ends, _ = tb.words(low, at, tb.SPACE)
            total += np.bincount((tb.word_hashes(low, starts, ends) >> U(LOW)).astype(np.int64), minlength=len(total))
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "c"])


def places(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of each line's place from its row's hash and its number."""
    return tb.mix(row.view(U) + line.astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _lines(shared, percent: int):
    """Rows (doc_id, row, line, place, k, n, sig, opens, prefix) of the lines with words; k names the set; each of the opens entries of prefix, of
    8 bytes, is a token, its lowest bits replaced by where in the set it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, single = shared.value
        for batch in batches:
            row = batch.column("row").to_numpy()
            for i, _, data, at in tb.pieces(*tb.strings(batch.column("text"))):
                tokens, own, line, _, first = line_sets(data, at, rank)
                doc = np.searchsorted(first, line, "right") - 1
                n, number = np.diff(own), line - first[doc]
                # Sets of Jaccard t share one of their n - ceil(t n) + 1 rarest tokens; a token that no other line has opens no list.
                length = n - -(-percent * n // 100) + 1
                length[n * (100 - percent) < percent] = 0  # too few tokens for a match that isn't equal
                pos = np.arange(len(tokens)) - np.repeat(own[:-1], n)
                use = (pos < np.repeat(length, n)) & ~single[(tokens >> U(LOW)).astype(np.int64)]
                opens = tb.sum_by(use.astype(np.int64), own)
                prefix = (tokens[use] & ~U(POSITIONS - 1)) | np.minimum(pos[use], POSITIONS - 1).astype(U)
                sig, signed = bitmaps(tokens, own)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc + i)), pa.array(row[doc + i]), pa.array(number.astype(np.int32)), pa.array(places(row[doc + i], number)), tb.set_keys(tokens, own),
                    pa.array(n.astype(np.int32)), tb.binaries(sig, signed * 8), pa.array(opens.astype(np.int32)), tb.binaries(prefix, np.concatenate([[0], np.cumsum(opens)]) * 8),
                ], ["doc_id", "row", "line", "place", "k", "n", "sig", "opens", "prefix"])

    return run


def _tokens_of(rank_shared, bitmap_shared):
    """Rows (k, s) of the lines whose place the bitmap lets through; s is all tokens of the line. Other lines are not parted into words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for i, j, data, at in tb.pieces(*tb.strings(batch.column("text"))):
                starts, ends, lines, first = line_bounds(data, at)
                number = np.arange(len(starts)) - np.repeat(first, lines)
                asked = np.flatnonzero(bit_hit(bitmap_shared.value, places(np.repeat(row[i:j], lines), number)))
                if not len(asked):
                    continue
                size = (ends - starts)[asked]
                own = np.concatenate([[0], np.cumsum(size)])
                tokens, own, _, _, _ = line_sets(data[np.arange(own[-1]) + np.repeat(starts[asked] - own[:-1], size)], own, rank_shared.value[0])
                yield pa.RecordBatch.from_arrays([tb.set_keys(tokens, own), tb.longs(tokens, own)], ["k", "s"])

    return run


#: Order of the sets: by first place.
PLACE = ["doc_id", "row", "line"]


def list_pairs(key: np.ndarray, n: np.ndarray, sid: np.ndarray, percent: int, small: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All pairs (x, y) of rows with equal keys that pass the length filter, x the earlier by sid, in runs; rows are sorted by key and n, so
    a row meets a window of its list. Short lists are taken together, by distance; of others, which the third value tells, a run has all pairs of its y."""
    cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    size = np.diff(cut)
    end = np.repeat(cut[1:], size)
    least, most = percent * n, 100 * n
    x = np.flatnonzero(np.repeat((size > 1) & (size <= small), size))
    d = 1
    while len(x):
        x = x[x + d < end[x]]
        x = x[least[x + d] <= most[x]]
        if len(x):
            y = x + d
            swap = sid[x] > sid[y]
            yield np.where(swap, y, x), np.where(swap, x, y), False
        d += 1
    for k in np.flatnonzero(size > small):
        lo, hi = cut[k], cut[k + 1]
        for a in range(lo, hi, 256):
            b = min(a + 256, hi)
            i, j = lo + np.searchsorted(most[lo:hi], least[a]), lo + np.searchsorted(least[lo:hi], most[b - 1], "right")
            y, x = np.nonzero((sid[i:j] < sid[a:b, None]) & (most[i:j] >= least[a:b, None]) & (least[i:j] <= most[a:b, None]))
            yield x + i, y + a, True


def list_key(p: np.ndarray, i: np.ndarray | int = 0, j: np.ndarray | int = 0) -> np.ndarray:
    """A number for each list and cell; were two alike, their rows would only meet in vain."""
    return tb.mix(tb.mix(p >> U(POSITIONS.bit_length() - 1)) + (np.asarray(i, U) << U(32)) + np.asarray(j, U))


def split_at(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of its set stand before each token, and how many from it on; all, if its position is not known."""
    pos = (p & U(POSITIONS - 1)).astype(np.int64)
    known = pos < POSITIONS - 1
    return np.where(known, pos, n), np.where(known, n - pos, n)


def placed(x: np.ndarray, y: np.ndarray, percent: int, n: np.ndarray, around: tuple[np.ndarray, np.ndarray], cells: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (x, y) that pass the positional filter, and how many tokens of their own they may have; around: split_at; cells: of rows off the diagonal of a grid, blocks meet others."""
    both = n[x] + n[y]
    overlap = -(-percent * both // (100 + percent))  # least for the threshold
    head, tail = around
    # Tokens in common are this one, at most the fewer before it and the fewer behind it.
    keep = np.minimum(head[x], head[y]) + np.minimum(tail[x], tail[y]) >= overlap
    if cells is not None:
        off, block = cells
        keep &= ~off[x] | (block[x] != block[y])
    return x[keep], y[keep], (both - 2 * overlap)[keep]


def alike(x: np.ndarray, y: np.ndarray, slack: np.ndarray, sig: Signatures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that pass the bitmap filter, and in how many bits they differ."""
    differ = sig.differ(x, y, slack)
    keep = differ <= slack
    return x[keep], y[keep], differ[keep]


def _confirmed(percent: int, pairs_room: int = 1 << 20):
    """Column y: the sets of a list that ``ask`` of which an earlier one holds, verified on the tokens s, each once a cell."""

    def match(t: pa.Table) -> pa.RecordBatch | None:
        p, n, sid = t["p"].to_numpy().view(U), t["n"].to_numpy().astype(np.int64), t["sid"].to_numpy()
        key, around, sig = _key(t), split_at(p, n), Signatures(tb.strings(t["sig"])[0].copy().view(U), n)
        cells, open_ = (t["i"].to_numpy() != t["j"].to_numpy(), t["block"].to_numpy()), t["ask"].to_numpy(zero_copy_only=False).copy()
        sets = t["s"].combine_chunks()
        own, tokens = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy()
        own, tokens = own - own[0], tokens[own[0] : own[-1]]
        kinds, token = np.unique(tokens, return_inverse=True)
        held = np.sort(np.repeat(np.arange(len(n)), np.diff(own)) * len(kinds) + token)  # (row, token), in order
        found = np.zeros(len(n), bool)
        for x, y, _ in list_pairs(key, n, sid, percent):
            keep = open_[y] & (sid[x] != sid[y])
            x, y, _ = alike(*placed(x[keep], y[keep], percent, n, around, cells), sig)
            start = 0
            while start < len(x):
                room = np.cumsum(n[y[start : start + pairs_room]])
                stop = start + max(1, int(np.searchsorted(room, pairs_room, "right")))
                a, b = x[start:stop], y[start:stop]
                a, b, start = a[open_[b]], b[open_[b]], stop
                if not len(a):
                    continue
                cut = np.concatenate([[0], np.cumsum(n[b])])
                at = np.arange(cut[-1]) + np.repeat(own[b] - cut[:-1], n[b])
                want = np.repeat(a, n[b]) * len(kinds) + token[at]
                place = np.minimum(np.searchsorted(held, want), len(held) - 1)
                both = tb.sum_by((held[place] == want).astype(np.int64), cut)
                hit = b[both * 100 >= percent * (n[a] + n[b] - both)]
                found[hit], open_[hit] = True, False
        return pa.RecordBatch.from_arrays([pa.array(np.unique(sid[found]))], ["y"]) if found.any() else None

    return by_key(match, _key)


def _key(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return list_key(*(t.column(c).to_numpy().view(kind) for c, kind in (("p", U), ("i", np.uint32), ("j", np.uint32))))


def opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(set, entry of its prefix) of a batch of sets, one behind the other."""
    return np.repeat(np.arange(batch.num_rows), batch.column("opens").to_numpy()), tb.strings(batch.column("prefix"))[0].copy().view(U)


def _packed(blocks_shared, parts: int):
    """Rows (part, p, sid, n, i, j, block, sig) from sets: each has, packed, the rows of lists that go to one part; long lists are dealt over a grid of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def packed() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            own, p = opened(batch)
            sid, n = batch.column("sid").to_numpy(), batch.column("n").to_numpy()
            g = blocks_shared.value[(p >> U(LOW)).astype(np.int64)]
            block = (tb.mix(sid.view(U))[own] % g.astype(U)).astype(np.int64)
            at = np.repeat(np.arange(len(p)), g)
            other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
            own, p, block = own[at], p[at], block[at]
            i, j = np.minimum(block, other), np.maximum(block, other)
            part = (list_key(p, i, j) % U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], part[order[1:]] != part[order[:-1]]]))
            part, own = part[order], own[order]
            cut = np.concatenate([cut, [len(part)]])
            flat, signed = tb.strings(batch.column("sig"))[0].copy().view(U), sign_words(n)
            words = signed[own]
            ends = np.concatenate([[0], np.cumsum(words)])
            sig = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(signed) - signed)[own] - ends[:-1], words)]
            fields = [p[order], sid[own], n[own].astype(np.uint32), *(x[order].astype(np.uint16) for x in (i, j, block))]
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *(tb.binaries(x, cut * x.itemsize) for x in fields), tb.binaries(sig, ends[cut] * 8)], PACKED)

        for batch in batches:
            if not batch.num_rows:
                continue
            own, p = opened(batch)
            total = rows + np.cumsum(np.bincount(own, blocks_shared.value[(p >> U(LOW)).astype(np.int64)], batch.num_rows).astype(np.int64))
            cut = [0, *(np.flatnonzero(np.diff(total // PACK)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:]):  # noqa: B905
                if a:
                    yield packed()
                    held.clear()
                held.append(batch.slice(a, b - a))
            rows = int(total[-1])
        if held:
            yield packed()

    return run


#: Columns of packed rows.
PACKED = ["part", "p", "sid", "n", "i", "j", "block", "sig"]


def _partners(percent: int):
    """Rows (y, x, far, many) from packed rows: of each set y of a list the earlier sets x that pass the filters, if they are at most PARTNERS, else
    the nearest alone; many is their number in y's first row, else 0."""

    def match(t: pa.Table) -> pa.RecordBatch | None:
        p, sid, n, i, j, block, sig = (tb.strings(t[c])[0].copy().view(kind) for c, kind in zip(PACKED[1:], (U, np.int64, np.uint32, np.uint16, np.uint16, np.uint16, U), strict=True))
        sig = Signatures(sig, n := n.astype(np.int64))
        key = list_key(p, i, j)
        order = np.lexsort((n, key))
        key, n, sid, p, off, block = key[order], n[order], sid[order], p[order], (i != j)[order], block[order]
        around, cells = split_at(p, n), (off, block) if off.any() else None
        sig.words, sig.at, sig.one = sig.words[order], sig.at[:-1][order], sig.one[order]
        found = []

        def keep_near(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> None:
            order = np.lexsort((x, far, y))
            x, y, far = x[order], y[order], far[order]
            cut = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])[: len(y)])
            size = np.diff(np.concatenate([cut, [len(y)]]))
            many = np.zeros(len(y), np.int64)
            many[cut] = size
            keep = (many > 0) | np.repeat(size <= PARTNERS, size)
            found.append((sid[y[keep]], sid[x[keep]], far[keep], many[keep]))

        short = []
        for x, y, whole in list_pairs(key, n, sid, percent):
            x, y, slack = placed(x, y, percent, n, around, cells)
            keep = (np.bitwise_count(sig.one[x] ^ sig.one[y]) <= slack) & (sid[x] != sid[y])
            if keep.any():
                some = x[keep], y[keep], slack[keep]
                keep_near(*alike(*some, sig)) if whole else short.append(some)
        if short:
            keep_near(*alike(*(np.concatenate(v) for v in zip(*short, strict=True)), sig))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], ["y", "x", "far", "many"])

    return by_key(match, lambda t: t.column("part").to_numpy(), each=True)


def _asked_rows(bitmap_shared):
    """Rows (token, p, sid, n, sig) of the lists whose token the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, p = opened(batch)
            token = (p >> U(POSITIONS.bit_length() - 1)).view(np.int64)
            hit = np.flatnonzero(bit_hit(bitmap_shared.value, token)) if bitmap_shared else np.arange(len(p))
            sets = batch.select(["sid", "n", "sig"]).take(pa.array(own[hit]))
            yield pa.RecordBatch.from_arrays([pa.array(token[hit]), pa.array(p[hit].view(np.int64)), *sets.columns], ["token", "p", "sid", "n", "sig"])

    return run


def by_key(match, key_of, each: bool = False):
    """A worker that gives all rows of a key together to match (several keys at once, or each alone), which may be None for those without a
    result; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the key that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = key_of(batch)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            same = bool(rest) and key_of(rest[-1].slice(rest[-1].num_rows - 1))[0] == key[0]
            if len(cut) == 1 and (same or not rest):
                rest.append(batch)
                continue
            whole = [[batch.slice(a, b - a)] for a, b in zip(cut, cut[1:])]  # noqa: B905
            whole = [rest + whole[0], *whole[1:]] if same else [rest] * bool(rest) + whole
            for group in whole if each else [sum(whole, [])]:
                if (found := match(pa.Table.from_batches(group))) is not None:
                    yield found
            rest = [batch.slice(cut[-1])]
        if rest and (found := match(pa.Table.from_batches(rest))) is not None:
            yield found

    return run


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query ends that wrote them, not when the driver collects its garbage: what is needed again is materialized."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


def similar_lines(docs: DataFrame, percent: int = 80, cell: int = CELL) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_lines, n_removed, removed (line numbers from 0, ascending), row (a hash of id and text).

    Lines are parted by newlines; a line's set is its distinct words (lower-cased A-Z, parted by ASCII white space). A line
    is removed if an earlier line, in the order of (doc_id, row, line), has a set of Jaccard percent / 100 or more, whether that
    line is removed itself or not. Lines without a word are kept. A null text has no lines, an empty text one. doc_id is of any type
    that sorts, null before all; rows with one id, or none, and different texts are documents of their own; rows that repeat id and text
    are one document in that order and come out alike. An empty table gives no rows; other columns are left out.

    Words are ordered by rarity: counts in 2**BUCKET_BITS buckets, then the hash, a total order of bounded size that keeps
    the prefix filter exact. Equal sets become one, at their first place, and are numbered in the order of places. Of each set the prefix
    opens lists; a row of a list holds number, size, position and a bitmap of parities that is wider for larger sets, not the text. Rows go to
    parts by list, packed. Lists longer than ``cell`` are dealt over a grid of cells. Within a list each row names the earlier rows that
    pass the positional, length and bitmap filters, which drop no match: all of them up to PARTNERS, else the nearest. What is named is
    verified on all tokens (64 bits each), read from the texts again; of a row with more than PARTNERS partners only the nearest. Such rows,
    if that does not hold, are asked again: their lists' rows take tokens along and are verified within the cells, which give a
    row at most once. So what leaves the cells is linear in the rows, and no match is lost. Within a list rows are still
    compared with each other, as the filters ask.
    """
    with shuffles_dropped(docs.sparkSession):
        return _similar_lines(docs, percent, cell)


def _similar_lines(docs: DataFrame, percent: int, cell: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    row_hash = F.xxhash64(F.col("doc_id").cast("string"), "text")
    source = docs.select("doc_id", row_hash.alias("row"), "text")
    counted = source.select("text").mapInArrow(lean(_counts), "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # at most 2**BUCKET_BITS rows
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[counted["bucket"].to_numpy()] = counted["c"].to_numpy()
    rank = np.empty(len(counts), np.uint32)
    order = np.argsort(counts, kind="stable")
    rank[order] = np.arange(len(counts), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((rank, (counts <= 1)[order]))

    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = source.mapInArrow(lean(_lines(shared, percent)), f"doc_id {kind}, row long, line int, place long, k binary, n int, sig binary, opens int, prefix binary")
    lines = materialize(lines, "lines")
    at = F.min(F.struct(*PLACE, "place")).alias("at")
    sets = lines.groupBy("k").agg(at, F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("n", "sig", "opens", "prefix")])
    sets = sets.select("k", "at.*", "n", "sig", "opens", "prefix", "c").orderBy(*PLACE).withColumn("sid", F.monotonically_increasing_id())
    sets = materialize(sets, "sets")  # sid is fixed as it is written

    # Longer lists than a cell: at most the count of the token's bucket says how many rows a list has.
    blocks = spark.sparkContext.broadcast(np.clip(-(-counts[order] // cell), 1, 1 << 12).astype(np.int64))
    openers = sets.where("opens > 0").select("sid", "n", "opens", "sig", "prefix")
    parts = max(PARTS, (openers.agg(F.sum("opens")).first()[0] or 0) // PART)

    def token_sets(ids: DataFrame) -> DataFrame:
        """sid and all tokens of the sets of ids(sid), read from the texts."""
        asked = materialize(ids.distinct().join(sets.select("sid", "k", "place", "doc_id"), "sid"), "asked")
        n, texts = int(asked.count()), source
        if n <= FEW:  # other documents don't go to the workers
            there = asked.select(F.col("doc_id").alias("there")).distinct()
            texts = source.join(F.broadcast(there), F.col("doc_id").eqNullSafe(F.col("there")), "left_semi")
        bits = int(np.clip(n.bit_length() + 4, 16, 27))
        bitmap = spark.sparkContext.broadcast(bit_filter(asked.select(F.col("place").alias("h")), bits))
        tokens = texts.mapInArrow(lean(_tokens_of(shared, bitmap)), "k binary, s array<long>").join(asked.select("sid", "k"), "k").select("sid", "s").dropDuplicates(["sid"])
        return materialize(tokens, "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        """The y of pairs (y, x) of which some x holds."""
        tokens = token_sets(pairs.select(F.explode(F.array("y", "x")).alias("sid")))
        both = pairs.join(tokens.select(F.col("sid").alias("y"), F.col("s").alias("sy")), "y").join(tokens.select(F.col("sid").alias("x"), F.col("s").alias("sx")), "x")
        both = both.withColumn("both", F.size(F.array_intersect("sy", "sx"))).where(f"both * 100 >= {percent} * (size(sy) + size(sx) - both)")
        return materialize(both.select("y").distinct(), "later")

    def lists_of(asking: DataFrame) -> DataFrame:
        """The rows of the lists that asking(y) opens, those of y marked."""
        row = "token long, p long, sid long, n int, sig binary"
        own = openers.join(asking.select(F.col("y").alias("sid")), "sid").mapInArrow(lean(_asked_rows(None)), row)
        own = materialize(own.select("token").distinct(), "asked")
        bits = int(np.clip(int(own.count()).bit_length() + 4, 16, 27))
        bitmap = spark.sparkContext.broadcast(bit_filter(own.select(F.col("token").alias("h")), bits))
        rows = openers.mapInArrow(lean(_asked_rows(bitmap)), row).join(own, "token", "left_semi")
        return rows.join(asking.select(F.col("y").alias("sid"), F.lit(True).alias("ask")), "sid", "left").fillna(False, ["ask"])

    def confirmed_in(asking: DataFrame) -> DataFrame:
        """The y of asking that hold, verified within cells; the lists' lengths and tokens are counted, so a cell has room for its rows' tokens."""
        rows = materialize(lists_of(asking), "lists")
        load = rows.groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum("n") / (cell * ROOM))).alias("g")).where("g > 1")
        rows = rows.join(load, "token", "left").join(token_sets(rows.select("sid")), "sid").withColumn("g", F.coalesce("g", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        rows = rows.withColumns({"i": F.least("block", "o").cast("int"), "j": F.greatest("block", "o").cast("int")})
        key = ["token", "i", "j"]
        rows = rows.select(*key, "block", "p", "sid", "n", "sig", "ask", "s").repartition(*key).sortWithinPartitions(*key, "n")
        return materialize(rows.select("i", "j", "block", "p", "sid", "n", "sig", "ask", "s").mapInArrow(lean(_confirmed(percent)), "y long").distinct(), "confirmed")

    packed = openers.mapInArrow(lean(_packed(blocks, parts)), "part int, p binary, sid binary, n binary, i binary, j binary, block binary, sig binary")
    named = packed.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_partners(percent)), "y long, x long, far long, many long")
    named = named.groupBy("y").agg(F.min(F.struct("far", "x")).alias("near"), F.collect_set("x").alias("xs"), F.sum("many").alias("many"), F.max("many").alias("most"))
    whole = (F.col("most") <= PARTNERS) & (F.size("xs") <= PARTNERS)
    named = materialize(named.select("y", F.when(whole, F.col("xs")).otherwise(F.array("near.x")).alias("xs"), F.when(whole, 0).otherwise(F.col("many")).alias("many")), "named")
    later = verified(named.select("y", F.explode("xs").alias("x")))
    asking = materialize(named.where("many > 0").select("y", "many").join(later, "y", "left_anti"), "asking")
    if asking.limit(1).count():
        later = later.union(confirmed_in(asking.select("y"))).distinct()

    flagged = sets.join(later.select(F.col("y").alias("sid"), F.lit(True).alias("near")), "sid", "left").where("c > 1 OR near")
    flagged = materialize(flagged.select("k", *[F.col(c).alias(f"first_{c}") for c in PLACE], F.coalesce("near", F.lit(False)).alias("near")), "flagged")
    gone = lines.select("k", *PLACE).join(flagged, "k").where("near OR NOT (doc_id <=> first_doc_id AND row = first_row AND line = first_line)")
    gone = gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = docs.select("doc_id", row_hash.alias("row"), n_lines.alias("n_lines")).alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.row = g.row"), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("d.doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), "d.row")


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the lines that similar_lines found taken out of text; all columns stay, whatever their names. Rows are told apart by id and
    text, so rows that repeat both come out alike; null texts stay null; an empty table gives no rows."""
    gone = found.where("n_removed > 0").select(F.col("doc_id").alias("id"), "row", "removed").dropDuplicates(["id", "row"])
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("own"))
    own = own.join(gone, F.col("doc")["doc_id"].eqNullSafe(F.col("id")) & (F.col("own") == F.col("row")), "left")
    kept = F.array_join(F.filter(F.split(F.col("doc")["text"], "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("doc")["text"]).otherwise(kept)
    return own.select(*[text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
