"""A run-length index of repetitive texts: the Burrows-Wheeler transform in runs, with text positions at run ends.

The texts of a bucket repeat each other, so their transform has few runs. Kept are, for each run, its symbol, where it
starts, where its first row leads to, and the text positions of its first and last row. Matching statistics of other
texts are streamed over it from right to left: as long as the current row carries the wanted symbol the match grows by
one; otherwise the nearest run of that symbol above or below takes over, whose sampled end says where in the text to
look up how much of the match remains. All streams advance in step, so each step is a few array operations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: symbol of all text ends; no stream ever wants it
_END = 256
_PACKED = 4
#: matches up to this length are looked up in short rows
_SHORT = 12


def suffix_array(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each with an end; start positions of its suffixes in order). Ends are ordered by text."""
    flat = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    code = flat + len(texts)
    code[ends] = np.arange(len(texts))
    symbols = flat.astype(np.int16)
    symbols[ends] = _END
    n, base = len(code), len(texts) + _END
    # several symbols at once as the first key
    width = _PACKED if base < 50_000 else 2
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([code, np.zeros(width, np.int64)])
    for j in range(width):
        key = key * base + padded[j:j + n]
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    # a group of suffixes that are equal so far has the place of its first as rank; only groups of several are sorted again
    left, ranked = np.arange(n), key[order]
    while True:
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        rank[order[left]] = left[new][np.cumsum(new) - 1]
        several = ~(new & np.append(new[1:], True))
        left = left[several]
        if not len(left):
            return symbols, order
        some = order[left]
        ahead = some + width
        key = rank[some] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[left], ranked = some[by], key[by]
        width *= 2


class RunLengthIndex:
    def __init__(self, texts: Sequence[bytes]):
        self.text, order = suffix_array(texts)
        n = len(order)
        transform = self.text[order - 1]  # what precedes a text's start is an end
        first = np.flatnonzero(np.concatenate(([True], transform[1:] != transform[:-1])))
        last = np.append(first[1:], n) - 1
        self.first, self.symbol = first, transform[first].astype(np.int64)
        self.at_first, self.at_last = order[first], order[last]
        self.last = last
        # rows are sorted by their first symbol, equal ones keep their order: ends come first
        rank = np.where(self.symbol == _END, -1, self.symbol)
        by_symbol = np.argsort(rank, kind="stable")
        size = (last - first + 1)[by_symbol]
        self.leads_to = np.empty(len(first), dtype=np.int64)
        self.leads_to[by_symbol] = np.cumsum(size) - size
        n_runs = len(first)
        self.keys = self.symbol[by_symbol] * n_runs + by_symbol
        self.keys.sort()
        # room for look-ups beyond the last text
        self.padded = np.concatenate([self.text, np.full(512, _END, np.int16)])

    def _common(self, at: np.ndarray, pattern: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common start of the text at ``at`` and the pattern at ``p``, up to ``most``."""
        if not len(at):
            return most
        width = int(most.max())
        if not width:
            return most
        span = np.arange(width)
        same = self.padded[at[:, None] + span] == pattern[p[:, None] + span]
        run = np.where(same.all(axis=1), width, same.argmin(axis=1))
        return np.minimum(run, most)

    def longest_matches(self, patterns: Sequence[bytes], cap: int) -> list[np.ndarray]:
        """For each position of each pattern the length of the longest match in the texts that starts there; lengths
        from ``cap`` on are only known to be at least ``cap``."""
        by_length = sorted(range(len(patterns)), key=lambda i: -len(patterns[i]))
        size = np.array([len(patterns[i]) for i in by_length], dtype=np.int64)
        flat = np.frombuffer(b"".join(patterns[i] for i in by_length), dtype=np.uint8).astype(np.int16)
        pattern = np.concatenate([flat, np.full(cap + 1, -1, np.int16)])
        ends = np.cumsum(size)
        out = np.zeros(len(flat), dtype=np.int64)
        row, length = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        active = len(size)
        n_runs = len(self.first)
        for step in range(1, int(size[0]) + 1 if len(size) else 1):
            while size[active - 1] < step:
                active -= 1
            p = ends[:active] - step
            want = pattern[p].astype(np.int64)
            r, match = row[:active], length[:active]
            run = np.searchsorted(self.first, r, side="right") - 1
            jump = np.flatnonzero(self.symbol[run] != want)
            if len(jump):
                c, here = want[jump], run[jump]
                k = np.searchsorted(self.keys, c * n_runs + here)
                below = self.keys[np.minimum(k, n_runs - 1)] - c * n_runs
                above = self.keys[np.maximum(k - 1, 0)] - c * n_runs
                has_below = (k < n_runs) & (below >= 0) & (below < n_runs)
                has_above = (k > 0) & (above >= 0) & (above < n_runs)
                below, above = np.where(has_below, below, 0), np.where(has_above, above, 0)
                most = np.minimum(np.minimum(match[jump], cap), step - 1)
                rest = p[jump] + 1
                got_below, got_above = np.full(len(jump), -1), np.full(len(jump), -1)
                for short in (True, False):
                    part = (most <= _SHORT) if short else (most > _SHORT)
                    i = np.flatnonzero(part & has_below)
                    got_below[i] = self._common(self.at_first[below[i]], pattern, rest[i], most[i])
                    i = np.flatnonzero(part & has_above)
                    got_above[i] = self._common(self.at_last[above[i]], pattern, rest[i], most[i])
                down = got_below >= got_above
                run[jump] = np.where(down, below, above)
                r[jump] = np.where(down, self.first[below], self.last[above])
                match[jump] = np.maximum(got_below, got_above)  # -1: the symbol does not occur
            length[:active] = match = match + 1
            known = match > 0
            row[:active] = np.where(known, self.leads_to[run] + r - self.first[run], 0)
            out[p] = match
        parts = np.split(out, ends[:-1]) if len(size) else []
        result: list[np.ndarray] = [out] * len(patterns)
        for i, part in zip(by_length, parts):
            result[i] = part
        return result
