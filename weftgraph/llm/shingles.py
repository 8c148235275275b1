"""Word shingle sets of texts as sorted 64-bit hashes, and HyperMinHash registers over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from weftgraph.llm.common import blocks_of

WORDS = 5
REGISTERS = 128
BUCKET_BITS = 7
MANTISSA_BITS = 10
BANDS = 32
ROWS = REGISTERS // BANDS
BLOCK_BYTES = 1_000_000

_rng = np.random.default_rng(20_240_905)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
#: For each register, the other registers in the order in which it borrows when it is empty.
_PROBES = np.array([_rng.permutation(REGISTERS) for _ in range(REGISTERS)])
_BASE = 0x9E3779B97F4A7C15
_up = _down = np.ones(1, np.uint64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> None:
    global _up, _down
    if len(_up) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _up, _down = (
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
            for b in (_BASE, inverse)
        )


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes], separators: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text, byte starts and ends of the words in the joined texts).

    Words are runs of bytes that are no separators (a table of 256; ASCII white space unless given), A-Z in lower case.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _FOLD[raw]
    blank = separators[data]
    edge = np.empty(len(data), bool)
    edge[0] = not blank[0]
    np.not_equal(blank[1:], blank[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _up[: len(data)], out=total[1:])
    h = mixed((total[ends] - total[starts]) * _down[starts] + (ends - starts).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(starts, stops), prepend=0)
    return h, n, starts, ends


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes; a text with fewer words has its whole sequence, one without none."""
    for a, b in blocks_of([len(t) for t in texts], BLOCK_BYTES):
        h, n, _, _ = word_hashes(texts[a:b])
        if len(h) >= words:
            run = len(h) - words + 1
            s = h[:run] * _PLACE[0]
            for k in range(1, words):
                s += h[k : k + run] * _PLACE[k]
            s = mixed(s)
        else:
            s = np.empty(0, np.uint64)
        first = np.cumsum(n) - n
        for f, m in zip(first.tolist(), n.tolist()):
            if m >= words:
                own = np.sort(s[f : f + m - words + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif m:
                with np.errstate(over="ignore"):
                    yield mixed(np.array([(h[f : f + m] * _PLACE[:m]).sum() + np.uint64(m)], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def hyperminhash(hashes: np.ndarray) -> np.ndarray:
    """128 registers of a sorted, non-empty set: the leading-zero count and ten mantissa bits of each bucket's least hash.

    The bucket is the hash's first seven bits, so a bucket's least hash comes first in the sorted set; as a
    floating-point number's exponent and mantissa, its leading zeros and the bits behind them make one code.
    Empty buckets borrow from the first filled one in an order of their own, which keeps each register's chance
    of agreement equal to the Jaccard similarity.
    """
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.empty(len(hashes), bool)
    first[0] = True
    np.not_equal(bucket[1:], bucket[:-1], out=first[1:])
    least = (hashes[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64) + 1.0
    code = (least.view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)) - np.uint64(1023 << MANTISSA_BITS)
    filled = bucket[first]
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = code
    if len(filled) < REGISTERS:
        there = np.zeros(REGISTERS, bool)
        there[filled] = True
        empty = np.flatnonzero(~there)
        probe = _PROBES[empty]
        out[empty] = out[probe[np.arange(len(empty)), there[probe].argmax(axis=1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of four registers (16 bits each, so a key is the band itself)."""
    return registers.reshape(BANDS, ROWS).view(np.uint64).ravel()


def corrected_jaccard(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of agreeing registers, less the chance agreements of registers of sets of n and m."""
    r = n / np.maximum(m, 1)
    chance = 0.169919487159739 * (4 * r / (1 + r) ** 2) * 2.0 ** (BUCKET_BITS - MANTISSA_BITS)
    return np.maximum(0.0, (agree - chance) / (REGISTERS - chance))
