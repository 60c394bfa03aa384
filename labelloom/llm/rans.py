"""Static range asymmetric numeral systems for token ids: one shared frequency table, interleaved lanes, checkpoints.

A block of ids is dealt to ``LANES`` coder states in turn (id i to lane i mod LANES); all lanes share one stream of 32-bit words. A
block depends on no other one. Inside a block the coder's states are kept every ``CHECKPOINT`` ids, with the place in the stream,
so decoding can begin at any checkpoint.

States are 64-bit numbers in [2^31, 2^63). Frequencies of a table add up to 2^``SCALE_BITS``, and every id that occurs has one at least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
LANES = 1024
BLOCK = 1 << 20
CHECKPOINT = 1 << 18

_U = np.uint64
_LOW = _U(1 << 31)
_WORD = _U(32)
_MASK = _U((1 << SCALE_BITS) - 1)
_BITS = _U(SCALE_BITS)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to whole numbers of sum 2^``SCALE_BITS``; ids with a count keep 1 at least, others have 0."""
    total, size = int(counts.sum()), 1 << SCALE_BITS
    used = counts > 0
    if not total:
        return np.zeros(len(counts), np.uint32)
    if used.sum() > size:
        raise ValueError("more ids than the table has room for")
    f = np.where(used, np.maximum((counts * (size / total)).astype(np.int64), 1), 0)
    # what rounding leaves goes to, or comes from, the most frequent ids
    rest = size - int(f.sum())
    order = np.argsort(-f, kind="stable")
    while rest:
        room = f[order] - 1 if rest < 0 else np.full(len(f), rest)
        room[~used[order]] = 0
        before = np.cumsum(room) - room
        take = np.clip(abs(rest) - before, 0, room)
        f[order] += np.sign(rest) * take
        rest = size - int(f.sum())
    return f.astype(np.uint32)


class Table:
    """Frequencies, their running sums, and the id of each slot."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(_U)
        self.start = np.cumsum(self.frequency) - self.frequency
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.frequency) <= 1 << 16 else np.uint32
            self._slots = np.repeat(np.arange(len(self.frequency), dtype=kind), self.frequency.astype(np.int64))
        return self._slots


@dataclass(frozen=True)
class Block:
    """``states``: for each checkpoint the lanes' states before its first id; ``at``: the word of the stream that comes next there."""

    n: int
    states: np.ndarray
    at: np.ndarray
    words: np.ndarray


def encode(ids: np.ndarray, table: Table) -> Block:
    steps = -(-len(ids) // LANES)
    f, c = table.frequency[ids], table.start[ids]
    limit, gap = f << (_U(63) - _BITS), (_U(1 << SCALE_BITS) - f)
    x = np.full(LANES, _LOW, dtype=_U)
    words, states, left = [], [], []
    written = 0
    every = CHECKPOINT // LANES
    for step in range(steps - 1, -1, -1):
        part = slice(step * LANES, min((step + 1) * LANES, len(ids)))
        y = x[:part.stop - part.start]
        full = np.flatnonzero(y >= limit[part])
        out = y[full]
        words.append(out.astype(np.uint32))
        written += len(out)
        y[full] = out >> _WORD
        # (y // f) * 2^bits + y % f + c
        y += y // f[part] * gap[part]
        y += c[part]
        if step % every == 0:
            states.append(x.copy())
            left.append(written)
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    at = written - np.array(left[::-1], dtype=np.int64)
    return Block(len(ids), np.array(states[::-1], dtype=_U).reshape(-1, LANES), at, stream)


def decode(block: Block, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive), from the checkpoint at or before the first."""
    last = block.n if last is None else min(last, block.n)
    if first >= last:
        return np.empty(0, np.uint32)
    mark = first // CHECKPOINT
    x, at = block.states[mark].copy(), int(block.at[mark])
    begin, end = mark * (CHECKPOINT // LANES), -(-last // LANES)
    out = np.empty((end - begin) * LANES, dtype=np.uint32)
    words, slots = block.words.astype(_U), table.slots
    for i, step in enumerate(range(begin, end)):
        y = x[:min(LANES, block.n - step * LANES)]
        slot = y & _MASK
        got = slots.take(slot)
        out[i * LANES:i * LANES + len(y)] = got
        y >>= _BITS
        y *= table.frequency.take(got)
        y += slot
        y -= table.start.take(got)
        low = np.flatnonzero(y < _LOW)
        y[low] = (y[low] << _WORD) | words[at:at + len(low)]
        at += len(low)
    return out[first - mark * CHECKPOINT:last - mark * CHECKPOINT]
