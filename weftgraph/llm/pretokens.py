"""Splits whole batches of texts into pre-tokens with array operations, and remembers what each became.

The rule is the byte-level pre-tokeniser's: contractions, runs of letters, digits or other signs with
one space before them, and white space whose last character stays with what follows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from weftgraph.llm.common import blocks_of, ragged_index

OTHER, LETTER, DIGIT, SPACE, MARK = range(5)
#: Stand for the end of a text and for the special token; no text can hold a surrogate.
END, SPECIAL = "\ud800", "\ud801"
BLOCK_CHARS = 1_000_000

# Letters and digits that Unicode 16.0 added to 15.1. The tokenisers follow 16.0, this Python 15.1,
# the regex module a later version; what 16.0 leaves unassigned counts as other signs.
ADDED_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
ADDED_DIGITS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for rx, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(rx, chars):
            table[m.start() : m.end()] = kind
    added = {c for ranges in (ADDED_LETTERS, ADDED_DIGITS) for a, b in ranges for c in range(a, b + 1)}
    for c in np.flatnonzero((table == LETTER) | (table == DIGIT)).tolist():
        if unicodedata.category(chr(c)) == "Cn" and c not in added:
            table[c] = OTHER
    table[0xD800:0xE000] = MARK
    return table


def boundaries(c: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points c."""
    k = class_table()[c]
    start = np.empty(len(c), bool)
    if not len(c):
        return start
    start[0] = True
    np.not_equal(k[1:], k[:-1], out=start[1:])
    start |= k == MARK
    word = k < SPACE
    follows = word[1:] & (k[:-1] == SPACE)
    start[:-1] |= follows  # the last of a run of white space parts from it
    start[1:] &= ~(follows & (c[:-1] == 0x20))  # and joins what follows if it is a plain space
    at = np.flatnonzero(c[:-1] == 0x27)
    if len(at):
        before = np.where(at > 0, k[at - 1], MARK)
        at = at[(before != OTHER) & ~((at > 0) & (c[at - 1] == 0x20))]
        one = c[at + 1]
        two = c[np.minimum(at + 2, len(c) - 1)]
        two = np.where(at + 2 < len(c), two, 0)
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, n in ((at[short], 2), (at[long], 3)):
            start[hit + 1] = False
            after = hit + n
            start[after[after < len(c)]] = True
    return start


class WordTable:
    """Open addressing from 64-bit word hashes to integer rows; bounded, and emptied when full."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.rows = np.zeros(1 << 16, np.int32)
        self.n = 0
        self.starts = np.zeros(1 << 15, np.int64)
        self.lens = np.zeros(1 << 15, np.int32)
        self.flat = np.zeros(1 << 17, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot, mask = self._slots(keys), len(self.keys) - 1
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.rows[slot], -1)
        live = np.flatnonzero(~hit & (there != 0))
        step = 0
        while len(live):
            step += 1
            s = (slot[live] + step) & mask
            there = self.keys[s]
            hit = there == keys[live]
            out[live[hit]] = self.rows[s[hit]]
            live = live[~hit & (there != 0)]
        return out

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot, mask = self._slots(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]] = keys[put]
            self.rows[slot[put]] = rows[put]
            left = left[~np.isin(left, put, assume_unique=True)]
            slot[left] = (slot[left] + 1) & mask

    def add(self, keys: np.ndarray, values: list[list[int]]) -> np.ndarray:
        """keys are distinct and new."""
        lens = np.fromiter(map(len, values), np.int32, len(values))
        flat = np.fromiter((x for v in values for x in v), np.int32, int(lens.sum()))
        n, used = self.n + len(keys), self.used + len(flat)
        while n > len(self.starts):
            self.starts, self.lens = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lens))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = flat
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        self.lens[self.n : n] = lens
        rows = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, used
        while 2 * n > len(self.keys):
            old = self.keys != 0
            k, r = self.keys[old], self.rows[old]
            self.keys, self.rows = np.zeros(2 * len(self.keys), np.uint64), np.zeros(2 * len(self.rows), np.int32)
            self._place(k, r)
        self._place(keys, rows)
        return rows


@lru_cache(1)
def _symbol_hashes() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 0x110000, np.uint64)


class _Powers:
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (self.BASE, self.INVERSE)
            )


_powers = _Powers()


def word_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of c: polynomials over random symbol values, never 0."""
    _powers.upto(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(_symbol_hashes()[c] * _powers.up[: len(c)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers.down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h[h == 0] = 1
    return h


class BatchEncoder:
    """Encodes texts through encode_word, which sees each distinct pre-token once as long as it is remembered."""

    def __init__(self, encode_word: Callable[[str], list[int]], special: str, special_id: int, limit: int = 1 << 20):
        self.encode_word, self.special, self.special_id = encode_word, special, special_id
        self.table = WordTable(limit)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        flats, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for a, b in blocks_of([len(t) for t in texts], BLOCK_CHARS):
            flat, n = self._block(texts[a:b])
            flats.append(flat)
            counts.append(n)
        return np.concatenate(flats), np.concatenate(counts)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = END.join(texts) + END
        if self.special in joined:
            joined = joined.replace(self.special, SPECIAL)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(boundaries(c))
        ends = np.append(starts[1:], len(c))
        end_mark = c[starts] == 0xD800
        keys = word_hashes(c, starts, ends)
        if self.table.n > self.table.limit:
            self.table.clear()
        rows = self.table.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first]
            said = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            values = [[] if w == END else [self.special_id] if w == SPECIAL else self.encode_word(w) for w in said]
            rows[missing] = self.table.add(new, values)[back]
        lens = self.table.lens[rows]
        flat = self.table.flat[ragged_index(self.table.starts[rows], lens)]
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        stops = total[np.flatnonzero(end_mark)]
        return flat, np.diff(stops, prepend=0)
