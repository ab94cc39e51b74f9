"""Fill-in-middle transformation: texts are cut at two seeded boundaries of units and their parts put in another order behind sentinels.

The boundaries of a text are a set of byte offsets in containers of 65,536 offsets each, every one in the smallest of three forms; cumulative counts
lead to the container of the k-th boundary, and a select within the container to its offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import textbytes as tb
from docloom.llm.common import lean, ship

#: Offsets that one container spans, and words of 64 bits in a bitmap of them.
SPAN = 1 << 16
WORDS = SPAN // 64
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: What units are: words with the white space before them (white space at the end is one), lines with their ends, code points.
UNITS = ("word", "line", "char")


class Values:
    """Offsets within a container, one by one, as 16-bit numbers."""

    def __init__(self, low: np.ndarray):
        self.values = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class Bitmap:
    """A bit for each offset, with the bits set before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # the lowest bit goes
        return 64 * at + (word & -word).bit_length() - 1


class Runs:
    """Runs of consecutive offsets: where each begins, and the offsets before it in the container."""

    def __init__(self, low: np.ndarray, begins: np.ndarray):
        self.first, self.before = low[begins].astype(np.uint16), begins.astype(np.uint16)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


class BoundarySet:
    """Ascending offsets, each once. ``select(k)`` is the k-th of them, from 0."""

    def __init__(self, offsets: np.ndarray):
        high = offsets // SPAN
        begins = np.concatenate([[0], np.flatnonzero(high[1:] != high[:-1]) + 1])[: len(offsets)].astype(np.int64)
        self.keys, self.size = high[begins], len(offsets)
        self.before = begins  # offsets in the containers before
        self.containers = [self._container(offsets[a:b] - h * SPAN) for h, a, b in zip(self.keys, begins, [*begins[1:], len(offsets)])]

    @staticmethod
    def _container(low: np.ndarray) -> Values | Bitmap | Runs:
        begins = np.concatenate([[0], np.flatnonzero(np.diff(low) != 1) + 1])
        if 2 * len(begins) < min(len(low), SPAN // 16):  # two numbers of 16 bits a run, one a value, SPAN bits a bitmap
            return Runs(low, begins)
        return Values(low) if len(low) <= SPAN // 16 else Bitmap(low)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.keys[at]) * SPAN + self.containers[at].select(k - int(self.before[at]))


def unit_ends(data: np.ndarray, at: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the units of all texts as offsets in data, their offsets by text)."""
    if unit == "word":
        _, ends, own = tb.words(data, at, tb.SPACE)
        n = np.diff(own)
        last = np.zeros(len(n), np.int64)
        last[n > 0] = ends[own[1:][n > 0] - 1]
        loose = np.flatnonzero((at[1:] > at[:-1]) & (last < at[1:]))  # white space behind the last word, or nothing else
        return np.insert(ends, own[1:][loose], at[1:][loose]), own + np.concatenate([[0], np.cumsum(np.bincount(loose, minlength=len(n)))])
    if unit == "char":
        ends = np.flatnonzero(np.append((data[1:] & 0xC0) != 0x80, [True] * (len(data) > 0))) + 1
    elif unit == "line":
        ends = np.union1d(np.flatnonzero(data == 10) + 1, at[1:][at[1:] > at[:-1]])
    else:
        raise ValueError(f"unit is one of {UNITS}")
    return ends, np.searchsorted(ends, at, "right")


def seeded(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of 8 hex digits of sha256 over ``seed:doc_id``, as numbers; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, unit: str = "word") -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    n is the number of units. Of h1 to h4 (``seeded``), h1 and h2 modulo n + 1 are the units before the two cuts, the smaller first. form is ``plain`` where
    the text is empty or holds a sentinel or h3 % 100 >= rate; else ``spm`` where h4 % 100 < spm_rate, else ``psm``. output is the text itself; or
    ``<P>`` prefix ``<S>`` suffix ``<M>`` middle for psm; or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle for spm. prefix_chars and middle_chars are
    the parts' code points, null for plain.

    A map over the rows, whole texts however long; nothing is shuffled. A null text is an empty one; a null id has the hash of no text; rows
    that repeat id and text have one result; an empty table gives no rows; other columns are left out.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    h = seeded(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit("<P>")) | F.contains(text, F.lit("<S>")) | F.contains(text, F.lit("<M>")) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    p, s, m = (x.encode() for x in SENTINELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, h1, h2 = batch.column("form").to_pylist(), batch.column("h1").to_pylist(), batch.column("h2").to_pylist()
            for i, j, data, at in tb.pieces(*tb.strings(batch.column("text"))):
                ends, own = unit_ends(data, at, unit)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # code points before a byte
                raw, out, chars = data.tobytes(), [], []
                for k in range(j - i):
                    a, b, n = at[k], at[k + 1], int(own[k + 1] - own[k])
                    if forms[i + k] == "plain":
                        out.append(raw[a:b])
                        chars.append((None, None))
                        continue
                    cuts = BoundarySet(ends[own[k] : own[k + 1]] - a)
                    x, y = (a + (cuts.select(c - 1) if c else 0) for c in sorted((h1[i + k] % (n + 1), h2[i + k] % (n + 1))))
                    head = [p, raw[a:x], s, raw[y:b]] if forms[i + k] == "psm" else [s, raw[y:b], p, raw[a:x]]
                    out.append(b"".join([*head, m, raw[x:y]]))
                    chars.append((int(lead[x] - lead[a]), int(lead[y] - lead[x])))
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
                texts = pa.LargeStringArray.from_buffers(len(out), pa.py_buffer(lengths), pa.py_buffer(b"".join(out))).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array(np.diff(own)), batch.column("form").slice(i, j - i),
                    pa.array([c[0] for c in chars], pa.int64()), pa.array([c[1] for c in chars], pa.int64()), texts,
                ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of which ``transform`` made output. Parts hold no sentinel, so the marks part them."""
    p, s, m = SENTINELS
    middle = F.split_part(output, F.lit(m), F.lit(2))
    rest = F.split_part(output, F.lit(m), F.lit(1))
    psm = F.concat(F.substring_index(F.substr(rest, F.lit(len(p) + 1)), s, 1), middle, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), middle, F.substring_index(F.substr(rest, F.lit(len(s) + 1)), p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
