"""Byte-level BPE: exact ids by longest matches with backtracking, in linear time; and texts from ids by a table of offsets.

At each place of a word the longest token that begins there comes from one Aho-Corasick scan. A token stays if it can stand behind the one before: no merge across
their seam may come before those that made the two. Otherwise the next shorter token is tried, and where none is left the token before is given up. Ends
that were given up once are not tried again, so a word of any length takes time in proportion to it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from docloom.llm import textbytes as tb
from docloom.llm.common import lean, ship
from docloom.llm.tokenio import Words

#: Words that a worker remembers, beyond which the half that was met most often stays; words above LONG characters, of MEMO_LONG together, then go.
MEMO_WORDS, LONG, MEMO_LONG = 400_000, 128, 1 << 23
#: Pairs of tokens of which a worker remembers whether they can stand together.
MEMO_PAIRS = 1_000_000

# Fixed value: the splitter of byte-level vocabularies.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before the string of an added token, to tell it from a word; no text holds it.
_ADDED = "\ud800"


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: a printable one is itself, the others follow from 256 on in turn."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=1)
def disputed() -> tuple[int, regex.Pattern]:
    """Code points that the tokenizers library and the regex module class unlike, as their Unicode versions differ: (the first byte of the least, a pattern)."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd = np.zeros(len(every), bool)
    for kind in (r"\p{L}+", r"\p{N}+", r"\s+"):
        marks = np.zeros((2, len(every) + 1), np.int8)
        ours = [m.span() for m in regex.finditer(kind, every)]
        theirs = [span for _, span in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every)]
        for row, spans in zip(marks, (ours, theirs)):
            begin, end = np.array(spans).T
            np.add.at(row, begin, 1)
            np.add.at(row, end, -1)
        inside = np.cumsum(marks, axis=1)[:, :-1]
        odd |= inside[0] != inside[1]
    if not odd.any():
        return 256, regex.compile(r"(?!)")
    edges = np.flatnonzero(np.diff(odd.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    spans = [f"\\U{ord(every[a]):08x}-\\U{ord(every[b - 1]):08x}" for a, b in edges]
    return every[edges[0, 0]].encode()[0], regex.compile(f"[{''.join(spans)}]")


class Vocabulary:
    """A byte-level BPE file of the tokenizers library. Tokens are numbered by the order in which merges make them: the bytes, then each merge."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, splitter, added = said["model"], said["pre_tokenizer"] or {}, said["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        split = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space") and splitter.get("use_regex", True)
        whole = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model.get("type", "BPE") != "BPE" or not plain or not split or not whole or said["normalizer"] or (said["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE file without normaliser")
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        letters = byte_letters()
        token = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        by_byte = {b: c for c, b in letters.items()}
        names = [by_byte[b] for b in range(256)] + ["".join(m) for m in merges]
        number = {t: k for k, t in enumerate(names)}
        if len(number) < len(names) or any(t not in model["vocab"] for t in names):
            raise ValueError("every byte is a token and every merge makes a token of its own")
        self.bytes = [token[t] for t in names]
        self.ids = np.array([model["vocab"][t] for t in names], np.uint32)
        self.length = [len(b) for b in self.bytes]
        self.left = [*range(256), *(number[a] for a, _ in merges)]
        self.right = [*range(256), *(number[b] for _, b in merges)]
        self.merged = {(a, b): 256 + k for k, (a, b) in enumerate(zip(self.left[256:], self.right[256:]))}
        if any(max(pair) >= k for pair, k in self.merged.items()):
            raise ValueError("merges come after those of their parts")
        self.pairs: dict[tuple[int, int], bool] = {}
        # Tokens that merges of their own bytes do reach; others are never ids of a text.
        made = [True] * 256
        for k in range(256, len(names)):
            made.append(made[self.left[k]] and made[self.right[k]] and self._apart(self.left[k], self.right[k], k))
        self.known = {b.decode("latin-1"): k for k, b in enumerate(self.bytes) if made[k]}
        self.shorter = [next((self.known[w] for e in range(len(b) - 1, 0, -1) if (w := b[:e].decode("latin-1")) in self.known), -1) for b in self.bytes]
        self.backwards = ahocorasick.Automaton()
        for w, k in self.known.items():
            self.backwards.add_word(w[::-1], k)
        self.backwards.make_automaton()
        self.added = {t["content"]: t["id"] for t in added}
        self.parts = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        # What ids stand for, one behind the other.
        shown = {i: token.get(t, t.encode()) for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.added.items()}
        sizes = np.array([len(shown.get(i, b"")) for i in range(max(shown) + 2)], np.int64)
        self.flat = np.frombuffer(b"".join(shown.get(i, b"") for i in range(max(shown) + 1)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.clear()

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether tokens a and b stay apart: going back through the merges at the seam, latest first, no pair there merges before ``limit``, the
        step at which one of the two became part of a longer token."""
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a >= 256 and (a > b or b < 256):
                limit, a = a, self.right[a]
            elif b >= 256:
                limit, b = b + 1, self.left[b]  # of equal steps the left one is taken first
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b, len(self.bytes))
        return found

    def word(self, text: str) -> list[int]:
        """Numbers of the tokens of a word, its bytes as Latin-1."""
        if text in self.known:
            return [self.known[text]]
        n = len(text)
        longest = [-1] * n
        for end, k in self.backwards.iter(text[::-1]):
            if longest[n - 1 - end] < 0 or self.length[k] > self.length[longest[n - 1 - end]]:
                longest[n - 1 - end] = k
        free, tokens, at, k = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        while at < n:
            while k >= 0 and not (free[at + self.length[k]] and (not tokens or self.apart(tokens[-1], k))):
                k = self.shorter[k]
            if k >= 0:
                tokens.append(k)
                at += self.length[k]
                k = longest[at] if at < n else -1
            else:
                free[at] = 0
                k = tokens.pop()
                at -= self.length[k]
        return tokens

    def clear(self) -> None:
        """Forgets all words but the added tokens."""
        self.number = Words()
        for t in self.added:
            self.number[_ADDED + t]
        self.number.fresh = []
        self.found, self.size = np.array(list(self.added.values()), np.uint32), np.ones(len(self.added), np.int64)
        self.met, self.held = np.zeros(len(self.added), np.int64), 0

    def forget(self) -> None:
        """Leaves the half of the words that was met most often, none of them long."""
        words, first = list(self.number), np.cumsum(self.size) - self.size
        order = np.argsort(-self.met[len(self.added) :], kind="stable") + len(self.added)
        stay = [k for k in order.tolist() if len(words[k]) <= LONG][: MEMO_WORDS // 2]
        ids, size, met = self._gathered(np.array(stay, np.int64), first), self.size[stay], self.met[stay]
        self.clear()
        for k in stay:
            self.number[words[k]]
        self.number.fresh = []
        self.found, self.size, self.met = np.concatenate([self.found, ids]), np.concatenate([self.size, size]), np.concatenate([self.met, met])

    def _gathered(self, k: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The ids of the words of these numbers in turn; first tells where a word's ids begin."""
        n = self.size[k]
        ends = np.cumsum(n)
        return self.found[np.repeat(first[k] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def split(self, text: str, doubtful: bool) -> list[str]:
        """The words of a text, added tokens behind _ADDED."""
        out, at = [], 0
        for m in self.parts.finditer(text) if self.parts and self.parts.search(text) else ():
            out += self._words(text[at : m.start()], doubtful)
            out.append(_ADDED + m[0])
            at = m.end()
        return out + self._words(text[at:] if at else text, doubtful)

    def _words(self, text: str, doubtful: bool) -> list[str]:
        if doubtful and disputed()[1].search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return _SPLIT(text)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each); texts as bytes and offsets."""
        raw, words, counts = data.tobytes(), [], []
        for a, b in zip(at[:-1], at[1:]):
            doubtful = b > a and int(data[a:b].max()) >= disputed()[0]
            words += self.split(raw[a:b].decode("utf-8", "replace"), doubtful)
            counts.append(len(words))
        keys = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        fresh, self.number.fresh = self.number.fresh, []
        found = [self.word(w.encode().decode("latin-1")) for w in fresh]
        self.size = np.concatenate([self.size, np.array([len(x) for x in found], np.int64)])
        self.found = np.concatenate([self.found, self.ids[np.array([k for x in found for k in x], np.int64)]])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
        self.met += np.bincount(keys, minlength=len(self.met))
        ids = self._gathered(keys, np.cumsum(self.size) - self.size)
        ends = np.concatenate([[0], np.cumsum(self.size[keys])])
        self.held += sum(len(w) for w in fresh if len(w) > LONG)
        if len(self.number) > MEMO_WORDS or self.held > MEMO_LONG:
            self.forget()
        return ids, np.diff(ends[counts], prepend=0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the ids in turn, number of bytes of each); ids that the file lacks stand for nothing."""
        known = np.minimum(ids.astype(np.int64), len(self.offsets) - 2)
        known[ids.astype(np.int64) < 0] = len(self.offsets) - 2
        first, n = self.offsets[known], self.offsets[known + 1] - self.offsets[known]
        ends = np.cumsum(n)
        return self.flat[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


_SPLIT = regex.compile(SPLITTER).findall


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(path)


def encode(docs: DataFrame, tokenizer: str, packed: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_tokens, ids.

    ids are those of the tokenizers library for the byte-level BPE file ``tokenizer`` (a path that every worker has), without special tokens around the text;
    strings of added tokens in the text are those tokens. array<int>, or if packed little-endian unsigned 32-bit integers as binary. Texts are taken whole,
    however long. A null text is an empty one, without ids; null or repeated doc_ids stay as rows; an empty table gives no rows; other columns are left out.
    A map over the rows, nothing is shuffled; other kinds of files raise ValueError.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(tokenizer)
        for batch in batches:
            for i, j, data, at in tb.pieces(*tb.strings(batch.column("text"))):
                ids, n = coder.encode(data, at)
                to = np.concatenate([[0], np.cumsum(n)])
                if packed:
                    column = tb.binaries(ids.astype("<u4").view(np.uint8), 4 * to)
                else:
                    column = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), column], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Adds decoded to rows, which hold ids as ``encode`` gives them: the text as the library has it, added tokens shown, bytes that are no UTF-8 as
    U+FFFD, ids outside the file left out. Null ids give null; a column of that name in rows is replaced; an empty table gives no rows."""
    ship(rows.sparkSession)
    rows = rows.drop("decoded")
    packed = rows.schema["ids"].dataType.simpleString() == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(tokenizer)
        for batch in batches:
            column = batch.column("ids")
            if packed:
                data, at = tb.strings(column.cast(pa.large_binary()).fill_null(b""))
            else:
                lists = column.fill_null([])
                data, at = lists.flatten().fill_null(-1).to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            out = []
            for i, j, part, own in tb.pieces(data, at):
                ids, own = (np.frombuffer(part.tobytes(), "<u4"), own // 4) if packed else (part, own)
                text, n = coder.decode(ids)
                to = np.concatenate([[0], np.cumsum(n)])[own]
                raw = text.tobytes()
                out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(to[:-1], to[1:])]
            texts = pa.array(out, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"
    return rows.mapInArrow(lean(run), schema)
