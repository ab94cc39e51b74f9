"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of test items, each text scanned once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import textbytes as tb
from docloom.llm.common import lean, ship

#: Characters of items in one automaton, some three hundred megabytes; a larger benchmark is taken in blocks of items, each with an automaton and a scan.
BLOCK_CHARS = 1 << 22
#: Bytes of rows that a worker gathers, where there are several blocks, before it builds their automata in turn.
GATHERED = 1 << 26


class Numbers(dict):
    """Numbers of the benchmark's words, from 1; 0 for all others."""

    def __missing__(self, word: str) -> int:
        return 0


def normal(data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Each text as its words between single spaces, one before and one behind; with the words' starts, ends and offsets."""
    low = tb.LOWER[data]
    starts, ends, own = tb.words(low, at, tb.NOT_ALNUM)
    size = ends - starts + 1  # with the space before
    place = np.cumsum(size) - size
    n_docs = len(at) - 1
    extra = np.repeat(np.arange(n_docs), np.diff(own))  # a closing space for each text before
    out = np.full(int(size.sum()) + n_docs, 32, np.uint8)
    first = place + extra + 1
    total = int((size - 1).sum())
    if total:
        shift = np.repeat(first - starts, size - 1)
        inside = np.repeat(starts - (np.cumsum(size - 1) - (size - 1)), size - 1) + np.arange(total)
        out[inside + shift] = low[inside]
    bounds = np.concatenate([[0], np.cumsum(tb.sum_by(size, own) + 1)])
    raw = out.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])], starts, ends, own


class Sieve:
    """Tells texts that may hold a window from those that can't: a window is a run of neighbours that some item has as neighbours, word by word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, width: int):
        h, own = self.hashes(data, at)
        n = np.minimum(np.diff(own), width)
        self.known = np.unique(h)
        k = self.numbers(h)
        inside = np.ones(max(len(k) - 1, 0), bool)
        inside[own[1:-1][(own[1:-1] > 0) & (own[1:-1] < len(k))] - 1] = False
        self.pairs = np.unique((k[:-1] * (len(self.known) + 1) + k[1:])[inside])
        self.least = int(n[n > 1].min()) if (n > 1).any() else 0
        self.alone = np.zeros(len(self.known) + 1, bool)
        self.alone[k[own[:-1][n == 1]]] = True

    @staticmethod
    def hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = tb.LOWER[data]
        starts, ends, own = tb.words(low, at, tb.NOT_ALNUM)
        return tb.word_hashes(low, starts, ends), own

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers from 1, 0 for words that no item has."""
        return _places(self.known, h) + 1

    def suspects(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts to be scanned, words of each text)."""
        h, own = self.hashes(data, at)
        if not len(self.known) or not len(h):
            return np.zeros(0, np.int64), np.diff(own)
        k = self.numbers(h)
        hit = self.alone[k]
        if self.least and len(k) > 1:
            near = np.flatnonzero((k[:-1] > 0) & (k[1:] > 0))
            alive = np.zeros(len(k), np.int64)
            alive[near[_places(self.pairs, k[near] * (len(self.known) + 1) + k[near + 1]) >= 0]] = 1
            alive[own[1:][own[1:] > 0] - 1] = 0  # the last word of a text has no neighbour behind it
            run = np.concatenate([[0], np.cumsum(alive)])
            first = np.flatnonzero(run[self.least - 1 :] - run[: max(len(run) - self.least + 1, 0)] == self.least - 1)
            hit[first[first < len(hit)]] = True
        return np.unique(np.searchsorted(own, np.flatnonzero(hit), "right") - 1), np.diff(own)


def _places(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands among ascending values; -1 where it does not."""
    at = np.minimum(np.searchsorted(values, x), max(len(values) - 1, 0))
    return np.where(values[at] == x, at, -1) if len(values) else np.full(len(x), -1)


@lru_cache(maxsize=1)
def automaton(items: tuple[tuple[str, str], ...], width: int) -> tuple[Numbers, ahocorasick.Automaton, Sieve]:
    """Over word numbers as letters. Payload of a window: (its words, the ids of the items that hold it)."""
    found: dict[tuple[int, ...], set[str]] = {}
    raw, number = [t.encode() for _, t in items], Numbers()
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    texts = normal(data, at)[0]
    for (item, _), text in zip(items, texts):
        own = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
        for i in range(max(1, len(own) - width + 1)) if own else ():
            found.setdefault(tuple(own[i : i + width]), set()).add(item)
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for x, ids in found.items():
        out.add_word(x, (len(x), tuple(sorted(ids))))
    if found:
        out.make_automaton()
    return number, out, Sieve(data, at, width)


def words_of(text: str) -> list[str]:
    """The words of a text as ``normal`` gives it."""
    return text.split(" ")[1:-1] if len(text) > 1 else []


def scan(text: str, machine: tuple[Numbers, ahocorasick.Automaton, Sieve]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged runs of hit words [first, end), and the items; text as ``normal`` gives it."""
    number, states, _ = machine
    matches = list(states.iter(tuple(map(number.__getitem__, words_of(text))))) if len(states) else []
    return merged([(end - n + 1, end + 1) for end, (n, _) in matches]), {i for _, (_, ids) in matches for i in ids}


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[Broadcast]:
    """Items (id, text) in blocks of at most block_chars together, a broadcast each; a longer item comes alone. Rows come to the driver a
    partition at a time and go on as they come."""
    spark, blocks, block, size = benchmark.sparkSession, [], [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i", "text").toLocalIterator():
        if size and size + len(r["text"]) > block_chars:
            blocks.append(spark.sparkContext.broadcast(tuple(block)))
            block, size = [], 0
        block.append((r["i"], r["text"]))
        size += len(r["text"])
    return [*blocks, spark.sparkContext.broadcast(tuple(block))] if block else blocks


def examine(column: pa.Array, blocks: list[Broadcast], width: int, percent: int) -> list[pa.Array]:
    """n_words, n_hit, n_items, items_sha256, contaminated and spans of each text. A worker keeps one automaton: it goes through all these texts before
    the next block's is built."""
    data, at = tb.strings(column)
    n = len(column)
    words, hit, items, spans = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
    sha = np.array([hashlib.sha256(b"").hexdigest()] * n, object)
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for block in blocks or [None]:
        machine = automaton(block.value if block is not None else (), width)
        for i, j, part, own in tb.pieces(data, at):
            some, words[i:j] = machine[2].suspects(part, own)
            for k in some:
                runs, ids = scan(normal(part[own[k] : own[k + 1]], np.array([0, own[k + 1] - own[k]]))[0][0], machine)
                if runs:
                    before = found.get(i + k, ([], set()))
                    found[i + k] = (merged(before[0] + runs), before[1] | ids)
    for k, (runs, ids) in found.items():
        text = data[at[k] : at[k + 1]]
        starts, ends, _ = tb.words(text, np.array([0, len(text)]), tb.NOT_ALNUM)
        hit[k], items[k] = sum(b - a for a, b in runs), len(ids)
        sha[k] = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        chars = np.cumsum((text & 0xC0) != 0x80)  # code points up to and with a byte
        spans[k] = [{"begin": int(chars[starts[a]]) - 1, "end": int(chars[ends[b - 1] - 1])} for a, b in runs]
    bad = (hit > 0) & (100 * hit >= percent * words)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return [pa.array(words), pa.array(hit), pa.array(items), pa.array(sha, pa.string()), pa.array(bad), pa.array([x or [] for x in spans], kind)]


def gathered(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """The batches as they come where there is one block, whose automaton a worker builds once; else together, GATHERED bytes of rows at least."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(blocks) < 2:
            yield batch
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    benchmark(item_id, text) holds questions and answers, one text each. Texts are lower-cased (A-Z), words are letters,
    digits and all code points from 128; a window is width words of an item, or all of a shorter item. A word inside any
    occurrence of a window is hit; contaminated: some word is, and hit words are at least ``percent`` in a hundred of all. spans are the
    hit runs in the original text as array<struct<begin, end>>, 0-based code points, end behind the last.

    A benchmark of up to block_chars, which is any usual one, is one automaton, which a worker builds once, and each text is scanned once. A larger one goes to the
    workers in blocks; a worker holds the texts of all blocks and the automaton of one, and gathers texts before it goes through the blocks. Nothing is shuffled. Null and empty texts have no
    words and are clean; items without words or with null text match nothing; repeated items or rows count as they stand; null or
    repeated doc_ids stay as rows; other columns are left out; either table may be empty.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = item_blocks(benchmark, block_chars)
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<begin:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, blocks):
            found = examine(batch.column("text"), blocks, width, percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns whatever their names, that find_contamination would not call contaminated; repeated rows are judged
    alike, rows with null or empty text stay, empty tables give no rows or all. A map, without a shuffle."""
    ship(docs.sparkSession)
    blocks = item_blocks(benchmark, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, blocks):
            yield batch.filter(pc.invert(examine(batch.column(names.index("text")), blocks, width, percent)[4]))

    names = docs.columns
    return docs.mapInArrow(lean(run), docs.schema)
