"""Token counts by a finite-state transducer whose transitions carry emitted-token counts.

The byte-level pre-tokeniser and BPE are compiled together, transition by transition as texts need
them. Within a pre-token BPE has a deterministic form: exactly one vocabulary token that ends at a
place is compatible with the token that ends where it begins (BPE of the two together gives just
these two), and it is the last token of that prefix's encoding. So a state holds, for every place
where a longer token may still have begun, the node it has reached in the vocabulary's trie, the
last token before it, and how many tokens later the encoding now is; a transition adds the change of
the prefix's token count. Around that lie the pre-tokeniser's modes. States are interned, so runs
need array gathers only.

A text is cut into chunks. A chunk's state map says for each of some entry states in which state the chunk is left and
how many tokens it adds. The first entry state of a chunk is a guess: the state that a run from shortly before the chunk
arrives at, since states soon forget where a run began. All maps are made side by side; neighbours are then composed
pairwise in a segmented parallel prefix scan, in as many steps as the logarithm of the number of chunks. Where an exit is
no entry of the next map yet, it becomes one, again for all chunks side by side, until the composition from each text's
first state is defined. So counts are exact whatever the guesses, and need no blanks or other landmarks in the text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import Vocabulary, vocabulary
from weftgraph.llm.common import blocks_of, map_texts
from weftgraph.llm.pretokens import LETTER, OTHER, SPACE, class_table

CHUNK_BYTES = 768
#: Bytes before a chunk from which its first entry state is guessed.
LOOKBACK = 48
#: Entry states that a map holds at most; beyond them the last one is replaced.
ENTRIES = 8
#: Texts are run in blocks of so many bytes, a longer one piece by piece.
BLOCK_BYTES = 2_000_000
#: States after which the compiled tables are dropped and begun anew before the next block. A block adds at most one state
#: for each of its bytes and entry states; of prose, three in a hundred bytes while the tables are new.
STATE_LIMIT = 400_000


class _Trie:
    def __init__(self, v: Vocabulary):
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [True]
        for i, b in enumerate(v.bytes):
            if i == v.special_id:
                continue
            node = 0
            for x in b:
                key = node << 8 | x
                if (nxt := self.child.get(key)) is None:
                    nxt = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = i


class CountTransducer:
    """Lazily compiled; run() is exact for any bytes that are valid UTF-8."""

    START = 0

    def __init__(self, v: Vocabulary, state_limit: int = STATE_LIMIT):
        self.v, self.trie, self.limit = v, _Trie(v), state_limit
        self.kinds = class_table()
        self.reset()

    def reset(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.intern(("B",))
        self.keys = np.zeros(1 << 16, np.int64)
        self.to = np.zeros(1 << 16, np.int32)
        self.adds = np.zeros(1 << 16, np.int16)
        self.n = 0

    def intern(self, state: tuple) -> int:
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
        return i

    # --- BPE within a pre-token: dp = ((node, last token, tokens since), ...)

    ROOT = ((0, -1, 0),)

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            bs = self.v.bytes
            ok = self.pairs[key] = self.v.merge(bs[a] + bs[b]) == [a, b] if a >= 0 else self.v.merge(bs[b]) == [b]
        return ok

    def _extend(self, dp: tuple, data: bytes) -> tuple[tuple, int]:
        """dp after data, and by how much the token count of the prefix has changed."""
        total = 0
        child, token, inner = self.trie.child, self.trie.token, self.trie.inner
        for x in data:
            moved, last, delta = [], -1, 0
            for node, before, since in dp:
                nxt = child.get(node << 8 | x)
                if nxt is None:
                    continue
                t = token[nxt]
                if last < 0 and t >= 0 and self._compatible(before, t):
                    last, delta = t, 1 - since
                if inner[nxt]:
                    moved.append((nxt, before, since))
            dp = (*((n, b, s + delta) for n, b, s in moved), (0, last, 0))
            total += delta
        return dp, total

    # --- modes: B (nothing pending), W class dp, A dp (an apostrophe that may begin a contraction),
    # C letter dp (an apostrophe and r, v or l), S last dp change (white space), P state bytes (part of a character)

    def _begin(self, kind: int, char: bytes, space: bool = False) -> tuple[tuple, int]:
        dp, n = self._extend(self.ROOT, b" " + char if space else char)
        if kind == SPACE:
            return ("S", char, dp, n), n
        if char == b"'" and not space:
            return ("A", dp), n
        return ("W", kind, dp), n

    def _char(self, state: tuple, char: bytes) -> tuple[tuple, int]:
        kind = int(self.kinds[ord(char.decode("utf-8"))])
        mode = state[0]
        if mode == "A" and kind == LETTER:
            if char in (b"s", b"t", b"m", b"d"):
                return ("B",), self._extend(self.ROOT, b"'" + char)[1] - 1
            dp, n = self._extend(self.ROOT, char)
            return (("C", char, dp) if char in (b"r", b"v", b"l") else ("W", LETTER, dp)), n
        if mode == "C":
            if state[1] + char in (b"re", b"ve", b"ll"):
                return ("B",), self._extend(self.ROOT, b"'" + state[1] + char)[1] - 2
            state, mode = ("W", LETTER, state[2]), "W"
        elif mode == "A":
            state, mode = ("W", OTHER, state[1]), "W"
        if mode == "W" and kind == state[1]:
            dp, n = self._extend(state[2], char)
            return ("W", kind, dp), n
        if mode == "S":
            _, last, dp, change = state
            if kind == SPACE:
                dp, n = self._extend(dp, char)
                return ("S", char, dp, n), n
            alone = 0 if last == b" " else self._extend(self.ROOT, last)[1]
            new, n = self._begin(kind, char, last == b" ")
            return new, n + alone - change
        return self._begin(kind, char)

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """One byte of UTF-8; a character takes effect with its last byte."""
        base, part = (state[1], state[2]) if state[0] == "P" else (state, b"")
        part += bytes([byte])
        if len(part) < (1 if part[0] < 0x80 else 2 if part[0] < 0xE0 else 3 if part[0] < 0xF0 else 4):
            return ("P", base, part), 0
        return self._char(base, part)

    # --- compiled transitions

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def _insert(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        slot, mask, left = self._slots(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            s = slot[put]
            self.keys[s], self.to[s], self.adds[s] = keys[put], to[put], adds[put]
            left = left[~np.isin(left, put, assume_unique=True)]
            slot[left] = (slot[left] + 1) & mask

    def _compile(self, keys: np.ndarray) -> None:
        to, adds = np.empty(len(keys), np.int32), np.empty(len(keys), np.int16)
        for i, key in enumerate((keys - 1).tolist()):
            state, n = self.step(self.states[key >> 8], key & 255)
            to[i], adds[i] = self.intern(state), n
        self.n += len(keys)
        if 3 * self.n > len(self.keys):
            old = np.flatnonzero(self.keys)
            kept = self.keys[old], self.to[old], self.adds[old]
            size = 4 * len(self.keys)
            self.keys, self.to, self.adds = np.zeros(size, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
            self._insert(*kept)
        self._insert(keys, to, adds)

    def _lookup(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Slots of the transitions, compiled where they were not yet."""
        keys = (state.astype(np.int64) << 8 | byte) + 1
        while True:
            slot = self._slots(keys)
            there = self.keys[slot]
            live = np.flatnonzero(there != keys)
            absent = []
            mask = len(self.keys) - 1
            while len(live):
                gone = there[live] == 0
                if gone.any():
                    absent.append(live[gone])
                    live = live[~gone]
                slot[live] = (slot[live] + 1) & mask
                there[live] = self.keys[slot[live]]
                live = live[there[live] != keys[live]]
            if not absent:
                return slot
            self._compile(np.unique(keys[np.concatenate(absent)]))

    def lanes(self, data: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run data[lo:hi] from the states start, all side by side: (exit states, counts)."""
        n = hi - lo
        order = np.argsort(-n, kind="stable")
        state, at = start[order].astype(np.int64), lo[order].copy()
        count = np.zeros(len(order), np.int64)
        ends = np.searchsorted(-n[order], -np.arange(1, int(n.max(initial=0)) + 1), side="right")
        for live in ends.tolist():
            slot = self._lookup(state[:live], data[at[:live]])
            state[:live] = self.to[slot]
            count[:live] += self.adds[slot]
            at[:live] += 1
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count

    def counts(self, texts: list[bytes], chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
        """Tokens of each text (no special strings inside)."""
        out = np.zeros(len(texts), np.int64)
        for a, b in blocks_of([len(t) for t in texts], block_bytes):
            state = self.states[self.START]
            for at in range(0, len(texts[a]), block_bytes) if b == a + 1 else [None]:
                if len(self.states) > self.limit:
                    self.reset()
                pieces = texts[a:b] if at is None else [texts[a][at : at + block_bytes]]
                n, exits = self._block(pieces, self.intern(state), chunk_bytes)
                out[a:b] += n
                state = self.states[exits[-1]]
        return out

    def _block(self, texts: list[bytes], start: int, chunk_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, exit state) of each text run from the state start."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        per = -(-size // chunk_bytes)
        exits, total = np.full(len(texts), start, np.int64), np.zeros(len(texts), np.int64)
        some = np.flatnonzero(per)
        if not len(some):
            return total, exits
        begin = (np.cumsum(size) - size)[some]
        size, per = size[some], per[some]
        last = np.cumsum(per) - 1
        doc = np.repeat(np.arange(len(some)), per)
        nth = np.arange(len(doc)) - (last + 1 - per)[doc]
        lo = begin[doc] + nth * chunk_bytes
        hi = np.minimum(lo + chunk_bytes, (begin + size)[doc])
        first = nth == 0
        entry, out, adds = self._maps(data, start, begin[doc], lo, hi, first)
        while True:
            goes = self._matches(entry, out, first)
            reached, sums = scan(goes, adds, first)
            before = np.concatenate([[0], reached[:-1]])
            before[first] = 0  # the entry that is taken, or -1 where it is not known yet
            if (before >= 0).all():
                break
            entry, out, adds = self._widened(data, entry, out, adds, goes, before, lo, hi, first)
        exits[some] = out[last, before[last]]
        total[some] = sums[last]
        return total, exits

    def _maps(self, data, start, begin, lo, hi, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry states, exit states and counts of all chunks, a column for each entry: here the guessed one."""
        back = np.maximum(lo - LOOKBACK, begin)
        for _ in range(3):  # to where a character begins
            back += (back < lo) & (back > begin) & ((data[np.minimum(back, len(data) - 1)] & 0xC0) == 0x80)
        # Better still from a blank behind a visible ASCII byte, where a pre-token begins whatever came before.
        blank = (data == 0x20) | (data == 0x0A) | (data == 0x0D) | (data == 0x09)
        fresh = np.flatnonzero(blank[1:] & ~blank[:-1] & (data[:-1] > 0x20) & (data[:-1] < 0x7F)) + 1
        if len(fresh):
            back = np.maximum(back, fresh[np.maximum(np.searchsorted(fresh, lo, side="right") - 1, 0)] * (fresh[0] <= lo))
        origin = np.where(back == begin, start, self.START)
        entry, _ = self.lanes(data, origin, back, lo)
        entry[first] = start
        out, adds = self.lanes(data, entry, lo, hi)
        return entry[:, None], out[:, None], adds[:, None]

    @staticmethod
    def _matches(entry: np.ndarray, out: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each exit its place among the next chunk's entries; -1 if it is none, 0 at the end of a text."""
        goes = np.zeros(out.shape, np.int64)
        same = out[:-1, :, None] == entry[1:, None, :]
        goes[:-1] = np.where(same.any(axis=2), same.argmax(axis=2), -1)
        goes[:-1][first[1:]] = 0
        goes[out < 0] = -1
        return goes

    def _widened(self, data, entry, out, adds, goes, before, lo, hi, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Another entry for each chunk that is left of undefined: its left neighbour's exit, the one that is taken if that is known."""
        left = np.arange(len(lo) - 1)
        known = before[:-1] >= 0
        k = np.where(known, np.maximum(before[:-1], 0), (goes[:-1] < 0).argmax(axis=1))
        need = np.flatnonzero((goes[left, k] < 0) & (out[left, k] >= 0) & ~first[1:])
        state = out[need, k[need]]
        if entry.shape[1] == ENTRIES:  # only for those that are certainly taken, or maps would change each other for ever
            need, state = need[known[need]], state[known[need]]
        else:
            blank = np.full((len(lo), 1), -1, np.int64)
            entry, out, adds = (np.concatenate([x, blank], axis=1) for x in (entry, out, adds))
        chunk = need + 1
        entry[chunk, -1] = state
        out[chunk, -1], adds[chunk, -1] = self.lanes(data, state, lo[chunk], hi[chunk])
        return entry, out, adds


def scan(goes: np.ndarray, adds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segmented prefix scan of maps: for each chunk, where entry 0 of its text's first chunk has led behind it, and the sum on the way.

    goes[c, k] and adds[c, k] are chunk c's map of its k-th entry; -1 is undefined. In step d each chunk's map, which covers
    d chunks by then, is composed with that of the d chunks before.
    """
    goes, adds, done = goes.copy(), adds.copy(), first.copy()
    d = 1
    while d < len(goes) and not done.all():
        now = np.flatnonzero(~done[d:]) + d
        via, far = goes[now - d], goes[now]
        sums = adds[now - d] + np.take_along_axis(adds[now], np.maximum(via, 0), axis=1)
        far = np.where(via < 0, -1, np.take_along_axis(far, np.maximum(via, 0), axis=1))
        ended = done[now - d]
        goes[now], adds[now] = far, sums
        done[now] = ended
        d *= 2
    return goes[:, 0], adds[:, 0]


@lru_cache(2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(vocabulary(path))


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit (more than limit tokens).

    A null text counts as empty: 0 bytes, 0 tokens. The special string counts as one token and parts what
    stands on its sides. Very long texts are run piece by piece; repeated rows are counted each. An empty table gives no
    rows. Other columns are left out, so their names may be any.
    """
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(path)
        special = machine.v.special.encode()
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.binary())]
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = t.split(special) if special in t else [t]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        n = np.bincount(owner, machine.counts(pieces), len(texts)).astype(np.int64) + extra
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(n)], ["id", "n_bytes", "n_tokens"]
        )

    out = map_texts(df, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, schema, run)
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)


__all__ = ["CountTransducer", "token_counts", "transducer"]
