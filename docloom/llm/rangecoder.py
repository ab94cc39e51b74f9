"""Adaptive context-mixing range coder for token ids, in blocks that stand alone.

A block is cut into lanes, runs of ids that are coded in step: step t of all lanes is one round of numpy operations, with one model that
all lanes of the block feed. The model starts anew with each block:

- order 2: the id that last followed the two ids before, and a record of how often it was right in a row;
- order 1: the same for the one id before;
- order 0: adaptive counts over all ids of the block.

What an id is coded by is a mixture: the order-2 id gets one part of the range, the order-1 id another, and the rest is dealt by the
order-0 counts. The first two parts are mixed in the logistic domain from two estimates each, one by the order's own record and one by
both records together, with weights that follow the error online. All of it is whole numbers, so that every machine decodes alike.

A block is a header (the number of ids, of lanes, and the distinct ids as ascending differences) and 16-bit words in the order in which
the decoder asks for them. The coder keeps a range of 32 to 48 bits; a carry is added to the words before at the end.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
#: Ids are below this.
ID_LIMIT = 1 << 32
#: Lanes of a block at most, and ids of a lane at least, where there are so many.
LANES, LANE_IDS = 4096, 256
#: Places of the order-2 table at most, as a power of two, and the highest record.
SLOT_BITS, RECORD = 18, 7
#: An order-0 count begins at FIRST and grows by STEP; all are halved beyond TOTAL.
FIRST, STEP, TOTAL = 1, 6, 1 << 22
_LEAST, _LOW = 1 << 32, (1 << 32) - 1
#: ln(p / (1 - p)) of p in 4096ths, in 256ths; and its inverse in 65536ths, kept off 0 and 1.
_LOGIT = np.array([round(256 * math.log((2 * p + 1) / (8191 - 2 * p))) for p in range(4096)], np.int64)
_REACH = 2047
_CHANCE = np.array([min(max(round(65536 / (1 + math.exp(-x / 256))), 24), 65512) for x in range(-_REACH, _REACH + 1)], np.int64)
#: A context of the mixture: the records of order 2 and order 1, three bits each, and whether the two agree.
_CONTEXT = np.arange(128)
_OWN, _SAME = np.stack([_CONTEXT >> 4, (_CONTEXT >> 1) & 7]), _CONTEXT & 1
#: By record and hit (the lowest bit): what is added to an entry, and whether the new id takes its place.
_STEP = np.array([x for r in range(8) for x in (-(r - (r >> 1)), int(r < RECORD))], np.int64)
#: By whether order 2 and order 1 (twice) are right: 2 for order 2, 1 for order 1 alone.
_OUTCOME = np.array([0, 2, 1, 2])
_REPLACE = np.array([x for r in range(8) for x in (r <= 1, False)])


class Model:
    """What coder and decoder know of a block so far; ids are numbered by rank among the block's distinct ones.

    Pairs of values are of order 2 and order 1, in this order.
    """

    def __init__(self, total: int, lanes: int, distinct: int):
        self.slots = 1 << min(SLOT_BITS, max(8, total.bit_length()))
        self.table = np.zeros(self.slots + distinct + 1, np.int64)  # both orders' entries: rank and record together
        self.count = np.full(distinct, FIRST, np.int64)
        self.hits, self.seen = np.ones((2, 128), np.int64), np.full((2, 128), 8, np.int64)
        self.weights = np.full((2, 2, 2), 1 << 15, np.int64)  # by order, whether the two agree, and estimate; 16 bits behind the point
        self.a = self.b = np.full(lanes, distinct, np.int64)  # a lane's beginning has a context of its own
        self.outcomes: list[np.ndarray] = []
        self.others: list[np.ndarray] = []
        self.t = 0
        self.renew()

    def renew(self) -> None:
        """Takes in the outcomes since the last time: estimates, weights and counts, then the parts of the range."""
        if self.outcomes:
            n = np.bincount(np.concatenate(self.outcomes), minlength=512).reshape(128, 4)
            hits, seen = np.stack([n[:, 2], n[:, 1]]), np.stack([n.sum(1), n[:, 0] + n[:, 1]])
            error = ((hits << 16) - seen * self.chance)[:, None, :] * self.inputs  # order, estimate, context
            for same in (0, 1):
                some = seen[:, same::2].sum(1)
                self.weights[:, same] += error[:, :, same::2].sum(2) // (np.maximum(some, 1) << 6)[:, None]
            self.hits += hits
            self.seen += seen
            old = self.seen > 1 << 16
            self.hits[old] = (self.hits[old] + 1) >> 1
            self.seen[old] >>= 1
            self.count += STEP * np.bincount(np.concatenate(self.others), minlength=len(self.count))
            self.outcomes, self.others = [], []
        self.cum = np.zeros(len(self.count) + 1, np.int64)
        np.cumsum(self.count, out=self.cum[1:])
        if self.cum[-1] > TOTAL:
            self.count = (self.count + 1) >> 1
            np.cumsum(self.count, out=self.cum[1:])
        each = [np.stack([x[0].reshape(8, 16).sum(1), x[1].reshape(8, 8, 2).sum((0, 2))]) for x in (self.hits, self.seen)]
        own = 4095 * each[0] // each[1]
        self.inputs = _LOGIT[np.stack([4095 * self.hits // self.seen, np.take_along_axis(own, _OWN, 1)], 1)]  # order, estimate, context
        x = (self.weights[:, _SAME] * self.inputs.transpose(0, 2, 1)).sum(2) >> 16
        self.chance = _CHANCE[np.clip(x, -_REACH, _REACH) + _REACH]
        f2 = self.chance[0]
        f1 = np.where(_SAME == 1, 0, np.maximum((65536 - f2) * self.chance[1] >> 16, 1))  # below 65536 - f2, as chances are below 1
        self.f2, self.both = f2, f2 + f1
        self.start = np.stack([f2 + f1, f2, 0 * f2, 0 * f2], 1).ravel()  # by context and outcome: neither, order 1, order 2
        self.width = np.stack([65536 - f2 - f1, f1, f2, f2], 1).ravel()

    def look(self, n: int) -> None:
        """Predictions for the first n lanes: ranks in guess, of both orders, and the context of the mixture."""
        a, b = self.a[:n], self.b[:n]
        self.slot = np.empty((2, n), np.int64)
        np.bitwise_and((b * 0x9E3779B1 + a * 0x85EBCA6B) >> 20, self.slots - 1, out=self.slot[0])
        np.add(b, self.slots, out=self.slot[1])
        self.entry = self.table.take(self.slot)
        self.guess, self.record = self.entry >> 3, self.entry & 7
        self.context = (self.record[0] << 4) | (self.record[1] << 1) | (self.guess[0] == self.guess[1])

    def learn(self, x: np.ndarray, right: np.ndarray, outcome: np.ndarray, rest: np.ndarray) -> None:
        """x: the ids' ranks; right: which guesses held; outcome: context and outcome; rest: lanes coded by order 0."""
        self.outcomes.append(outcome)
        self.others.append(x[rest])
        # Right: the record grows. Wrong: it halves, and from 1 or less the new id takes the place.
        kind = (self.record << 1) | right
        new = self.entry + _STEP.take(kind)
        np.copyto(new, x << 3, where=_REPLACE.take(kind))
        self.table[self.slot] = new
        self.a, self.b = self.b[: len(x)], x
        self.t += 1
        if self.t < 8 or self.t % (4 if self.t < 64 else 8) == 0:
            self.renew()


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the upper bit says that more follow."""
    v = values.astype(U)
    size = np.maximum(1, sum((v >> U(7 * k) > 0).astype(np.int64) for k in range(1, 5)) + 1)
    out, first = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - size
    for k in range(5):
        own = size > k
        out[first[own] + k] = ((v[own] >> U(7 * k)) & U(127)).astype(np.uint8) | ((size[own] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def _read_varints(raw: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """(count values, bytes read)."""
    ends = np.flatnonzero(raw[: 5 * count] < 128)[:count] + 1
    first = np.concatenate([[0], ends[:-1]])
    out = np.zeros(count, np.int64)
    for k in range(5):
        own = first + k < ends
        out[own] |= (raw[first[own] + k].astype(np.int64) & 127) << (7 * k)
    return out, int(ends[-1])


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the rank of each id among them."""
    if ids.max() >= 1 << 22:
        distinct, rank = np.unique(ids, return_inverse=True)
        return distinct.astype(np.int64), rank
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[ids]


def _live(total: int, length: int, t: int) -> int:
    """Lanes that have an id at step t."""
    return -(-(total - t) // length)


def encode_block(ids: np.ndarray) -> bytes:
    distinct, rank = _ranks(ids)
    total = len(ids)
    lanes = int(min(LANES, max(1, total // LANE_IDS)))
    length = -(-total // lanes)
    lanes = -(-total // length)
    rows = np.zeros(lanes * length, np.int64)
    rows[:total] = rank
    steps = np.ascontiguousarray(rows.reshape(lanes, length).T)
    del rows, rank  # as large as the block
    model, low, span = Model(total, lanes, len(distinct)), np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []

    def shift(due: np.ndarray) -> None:
        if len(due):
            lo = low[due]
            out_lane.append(due.astype(np.uint16))
            out_word.append((lo >> 32).astype(np.int32))  # 17 bits: a carry may be among them
            low[due] = (lo & _LOW) << 16
            span[due] <<= 16

    for t in range(length):
        n = _live(total, length, t)
        x = steps[t, :n]
        model.look(n)
        right = model.guess == x
        outcome = (model.context << 2) | _OUTCOME.take(right[0] + 2 * right[1])
        r = span[:n] >> 16
        low[:n] += model.start.take(outcome) * r
        np.multiply(model.width.take(outcome), r, out=span[:n])
        shift(np.flatnonzero(span[:n] < _LEAST))
        rest = np.flatnonzero(outcome & 3 == 0)
        if len(rest):
            own = x[rest]
            first = model.cum.take(own)
            r = (span[rest].view(U) // U(model.cum[-1])).view(np.int64)
            low[rest] += first * r
            span[rest] = r = (model.cum.take(own + 1) - first) * r
            due = rest[r < _LEAST]
            shift(due)
            shift(due[span[due] < _LEAST])
        model.learn(x, right, outcome, rest)
    lane = np.concatenate(out_lane) if out_lane else np.zeros(0, np.uint16)
    order = np.argsort(lane, kind="stable")  # by radix
    events = np.bincount(lane, minlength=lanes)
    first = np.cumsum(events + 3) - (events + 3)  # a lane's words: those of its shifts, then its last three
    place = np.empty(len(lane), np.int64)
    place[order] = np.arange(len(lane)) - np.repeat(np.cumsum(events) - events, events)  # a shift's number within its lane
    words = np.zeros(len(lane) + 3 * lanes, np.int64)
    if len(lane):
        words[first[lane] + place] = np.concatenate(out_word)
    for k in range(3):
        words[first + events + k] = low >> 32
        low = (low & _LOW) << 16
    while (carry := words >> 16).any():  # a lane's first word has none
        words &= 0xFFFF
        words[:-1] += carry[1:]
    stream = np.concatenate([words[first], words[first + 1], words[first + 2], words[first[lane] + place + 3]])
    head = np.concatenate([[total, lanes, len(distinct)], np.diff(distinct, prepend=0)])
    return _varints(head) + stream.astype("<u2").tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    (total, lanes, n_distinct), skip = _read_varints(data, 3)
    gaps, more = _read_varints(data[skip:], int(n_distinct))
    distinct = np.cumsum(gaps)
    flat = np.frombuffer(raw, "<u2", offset=skip + more).astype(np.int64)
    total, lanes, length = int(total), int(lanes), -(-int(total) // int(lanes))
    model, span = Model(total, lanes, len(distinct)), np.full(lanes, (1 << 48) - 1, np.int64)
    code = (flat[:lanes] << 32) | (flat[lanes : 2 * lanes] << 16) | flat[2 * lanes : 3 * lanes]
    at = 3 * lanes
    out = np.zeros((length, lanes), np.int64)

    def shift(due: np.ndarray) -> None:
        nonlocal at
        if len(due):
            code[due] = (code[due] << 16) | flat[at : at + len(due)]
            span[due] <<= 16
            at += len(due)

    for t in range(length):
        n = _live(total, length, t)
        model.look(n)
        r, value = span[:n] >> 16, code[:n]
        kind = (value >= model.f2.take(model.context) * r) + (value >= model.both.take(model.context) * r).view(np.int8)  # 0: order 2, 1: order 1, 2: neither
        outcome = (model.context << 2) | (2 - kind)
        value -= model.start.take(outcome) * r
        np.multiply(model.width.take(outcome), r, out=span[:n])
        shift(np.flatnonzero(span[:n] < _LEAST))
        x = np.where(kind == 0, model.guess[0], model.guess[1])
        rest = np.flatnonzero(kind == 2)
        if len(rest):
            whole = int(model.cum[-1])
            r = (span[rest].view(U) // U(whole)).view(np.int64)
            own = np.searchsorted(model.cum, np.minimum((code[rest].view(U) // r.view(U)).view(np.int64), whole - 1), "right") - 1
            first = model.cum.take(own)
            code[rest] -= first * r
            span[rest] = r = (model.cum.take(own + 1) - first) * r
            due = rest[r < _LEAST]
            shift(due)
            shift(due[span[due] < _LEAST])
            x[rest] = own
        model.learn(x, model.guess == x, outcome, rest)
        out[t, :n] = x
    return distinct[out.T.ravel()[:total]]


def encode(ids: np.ndarray, block: int) -> list[bytes]:
    """The coded bytes of each run of ``block`` ids (the last may be shorter). Ids are whole numbers from 0 to ID_LIMIT - 1; no ids, no blocks."""
    if len(ids) and (ids.min() < 0 or ids.max() >= ID_LIMIT):
        raise ValueError("ids must be of 32 bits")
    return [encode_block(ids[a : a + block]) for a in range(0, len(ids), block)]


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids again, of 32 bits."""
    return np.concatenate([decode_block(b) for b in blocks] or [np.zeros(0, np.int64)]).astype(np.uint32)
