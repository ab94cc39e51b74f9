"""Token-ID output: tokenises whole texts and writes the ids as range-coded, checksummed blocks in files of a fixed order; and reads them back."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import rangecoder, textbytes as tb
from docloom.llm.common import lean, ship

#: Ids in a block: its model starts anew, so a damaged block costs no other.
BLOCK = 1 << 21
#: Bytes of text whose ids are coded together, as one row of the file; a longer text comes alone.
CHUNK_BYTES = 4 << 20
#: Words whose ids a worker remembers; beyond that the half that was met most often stays.
MEMO_WORDS = 600_000
#: A row of the file holds whole documents: ids and lengths of those, the ids in all, and the blocks with their crc32.
FILE_SCHEMA = "part int, chunk int, doc_ids array<{kind}>, lengths array<long>, total long, crcs array<long>, blocks array<binary>"

# The normaliser and the splitter under which a text's ids are those of its words in turn. They put letters in lower case and
# drop white space, and no part that they make holds white space or both letters and marks.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words that are their own normal form and one part of the splitter: a to z, and the lower-case letters from sharp s to y with diaeresis in UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Those of their bytes that are written as other characters in the vocabulary than their own.
_BYTE_CHARS = {0x9F: "\u0141", 0xA0: "\u0142", 0xAD: "\u0143"}
#: Ends a text among the words; the byte stands in no UTF-8 text.
_END = b"\xff"
#: What strings of special tokens begin with; texts without it may be put in lower case first, as the normaliser does.
_SPECIAL = b"<|"
_ENCODERS: dict[str, WholeTexts] = {}


class WholeTexts:
    """Ids of whole texts by a tokenizers file."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with end_id behind, number of each)."""
        each = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.int64), np.array([len(ids) for ids in each], np.int64)


class Words(dict):
    """Numbers of words in the order in which they were asked for; new ones wait in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordIds(WholeTexts):
    """The same under WORD_NORMALIZER and WORD_SPLITTER: each distinct word goes through the tokenizer once, many in one text with bars
    between them; one of plain letters, which normaliser and splitter leave as it is, goes to the tokenizer's model at once. A full stop or
    comma at the end of a word, behind a letter or digit, is a part of its own and is left out for that."""

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        bar = tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.number = Words()
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the tokenizer: (numbers of the words in the order of what follows, ids of the words, number of each)."""
        model, flat, size, plain, texts = self.tokenizer.model, [], [], [], {}
        for k, w in enumerate(words):
            if _LETTERS.fullmatch(w):
                ids = [t.id for t in model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTE_CHARS))]
                plain.append(k)
                flat += ids
                size.append(len(ids))
            else:
                texts[k] = w.decode("utf-8", "replace")
        alone = [k for k, t in texts.items() if self.bar is None or "|" in t]
        together = [k for k, t in texts.items() if "|" not in t] if self.bar is not None else []
        order, found, size = plain, [np.array(flat, np.uint32)], [np.array(size, np.int64)]
        runs = [together[b : b + 500] for b in range(0, len(together), 500)]
        for a in range(0, len(runs), 64):
            for run, e in zip(runs[a : a + 64], self.tokenizer.encode_batch_fast([" | ".join([texts[k] for k in run]) for run in runs[a : a + 64]], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                bars = np.flatnonzero(ids == self.bar)
                if len(bars) != len(run) - 1:
                    alone += run
                    continue
                order += run
                found.append(np.delete(ids, bars))
                size.append(np.diff(bars, prepend=-1, append=len(ids)) - 1)
        for a in range(0, len(alone), 8192):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in alone[a : a + 8192]], add_special_tokens=False)]
            found.append(np.array([i for ids in each for i in ids], np.uint32))
            size.append(np.array([len(ids) for ids in each], np.int64))
        none = [np.zeros(0, np.int64)]
        return np.array([*order, *alone], np.int64), np.concatenate(none + found).astype(np.uint32), np.concatenate(none + size)

    def gathered(self, k: np.ndarray) -> np.ndarray:
        """The ids of the words of these numbers in turn."""
        n = self.size[k]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def append(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids.astype(np.uint32)])
        self.met = np.concatenate([self.met, np.zeros(len(size), np.int64)])

    def learn(self) -> None:
        """Ids for the words that wait."""
        while self.number.fresh:
            fresh, self.number.fresh = self.number.fresh, []
            cut = [len(w) > 1 and w[-1] in b".," and (97 <= w[-2] <= 122 or 48 <= w[-2] <= 57) for w in fresh]
            stems = [self.number[w[:-1]] for w, c in zip(fresh, cut) if c]  # new ones wait in their turn
            marks = [self.number[w[-1:]] for w, c in zip(fresh, cut) if c]
            later, self.number.fresh = self.number.fresh, []
            begin, own = len(self.size), [k for k, c in enumerate(cut) if not c]
            order, ids, size = self.ids_of([fresh[k] for k in own] + later)
            order = np.array([*own, *range(len(fresh), len(fresh) + len(later))], np.int64)[order]
            whole = np.zeros(len(fresh) + len(later), np.int64)
            whole[order] = size
            # In the order of their numbers; cut words get their ids when the stems have theirs.
            room = np.cumsum(whole) - whole
            out = np.zeros(len(ids), np.uint32)
            out[np.repeat(room[order] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
            self.append(out, whole)
            if stems:
                pair = np.array([stems, marks], np.int64).T.ravel()
                both = self.size[pair].reshape(-1, 2).sum(1)
                at = begin + np.flatnonzero(cut)
                self.first[at] = len(self.flat) + np.cumsum(both) - both
                self.flat = np.concatenate([self.flat, self.gathered(pair)])
                self.size[at] = both

    def forget(self) -> None:
        """Leaves the half of the words that was met most often."""
        stay = np.sort(np.argsort(-self.met[1:], kind="stable")[: MEMO_WORDS // 2]) + 1
        words = list(self.number)
        ids, size = self.gathered(stay), self.size[stay]
        end = self.flat[self.first[0]]
        self.clear()
        for w in [_END, *(words[k] for k in stay)]:
            self.number[w]
        self.number.fresh = []
        self.append(np.concatenate([[end], ids]), np.concatenate([[1], size]))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if self.number and self.flat[self.first[0]] != end_id:
            self.clear()
        if not self.number:
            self.number[_END]
            self.number.fresh = []
            self.append(np.array([end_id]), np.array([1]))
        if len(self.number) > MEMO_WORDS:
            self.forget()
        joined = (b" " + _END + b" ").join([*texts, b""])
        joined = joined.lower() if _SPECIAL not in joined else (b" " + _END + b" ").join([*(t if _SPECIAL in t else t.lower() for t in texts), b""])
        words = joined.split()
        k = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        del joined, words  # some ten times the texts' size
        self.learn()
        self.met += np.bincount(k, minlength=len(self.met))
        ends = np.cumsum(self.size[k])[k == 0]
        return self.gathered(k), np.diff(ends, prepend=0)


def encoder_of(path: str) -> WholeTexts:
    """By words where the file's normaliser and splitter are those for which that is the same, by whole texts otherwise."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        said = json.loads(tokenizer.to_str())
        special = all(t["special"] and t["content"].startswith(_SPECIAL.decode()) and not t["content"].split()[1:] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in said["added_tokens"])
        by_word = special and said["normalizer"] == WORD_NORMALIZER and said["pre_tokenizer"] == WORD_SPLITTER and not said["truncation"] and not said["padding"]
        _ENCODERS[path] = WordIds(tokenizer) if by_word else WholeTexts(tokenizer)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes the ids of docs(doc_id, text) in ascending doc_id order to Parquet files at path, in FILE_SCHEMA.

    part is the range of doc_ids, ascending, chunk the place within it. A null text is an empty one: only end_id. Null ids come first;
    rows of the same id stand together, by a hash of their texts and then the texts, and may be dealt over several parts. Every text is
    encoded whole, however long, without special tokens, though strings that are special tokens in the text are ids as the library has it.
    No rows give no parts; other columns are left out. The vocabulary file is at ``tokenizer`` on every worker; ids have up to 32 bits.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, chunk = encoder_of(tokenizer), 0
        for batch in batches:
            for i, j, data, at in tb.pieces(*tb.strings(batch.column("text")), chunk_bytes):
                raw = data.tobytes()
                ids, lengths = coder.encode([raw[a:b] for a, b in zip(at[:-1], at[1:])], end_id)
                blocks = rangecoder.encode(ids, block)
                yield pa.RecordBatch.from_arrays([
                    batch.column("part").slice(i, 1), pa.array([chunk], pa.int32()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column("doc_id").slice(i, j - i)),
                    pa.array([lengths], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                    pa.array([[zlib.crc32(b) for b in blocks]], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary())),
                ], ["part", "chunk", "doc_ids", "lengths", "total", "crcs", "blocks"])
                chunk += 1

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    ordered.mapInArrow(lean(run), FILE_SCHEMA.format(kind=kind)).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each document of the files at path: doc_id, start, n_tokens, ids_crc32 and, with_ids, ids array<long>.

    start counts the ids of all documents before, by sums per part and chunk. A block whose crc32 differs raises ValueError.
    """
    ship(spark)
    chunks = spark.read.parquet(path)
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    totals = chunks.select("part", "chunk", "total")
    parts = totals.groupBy("part").agg(F.sum("total").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))  # a row for each part
    within = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("inner", F.coalesce(F.sum("total").over(within), F.lit(0))).join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("inner")).alias("chunk_start"))
    names = ["part", "chunk", "doc_id", "offset", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                blocks = row["blocks"].as_py()
                if [zlib.crc32(b) for b in blocks] != row["crcs"].as_py():
                    raise ValueError(f"damaged block in part {row['part']}, chunk {row['chunk']}")
                ids = rangecoder.decode(blocks)
                n = np.array(row["lengths"].as_py(), np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4").tobytes())
                cols = [
                    pa.array(np.full(len(n), row["part"].as_py(), np.int32)), pa.array(np.full(len(n), row["chunk"].as_py(), np.int32)), row["doc_ids"].values, pa.array(at[:-1]), pa.array(n),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"part int, chunk int, doc_id {kind}, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = chunks.mapInArrow(lean(run), schema).join(starts, ["part", "chunk"])
    return docs.select("doc_id", (F.col("chunk_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
