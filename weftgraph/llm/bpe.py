"""Byte-pair encoding with a queue of merge ranks over a doubly linked symbol list, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import map_texts, ragged_index
from weftgraph.llm.pretokens import BatchEncoder


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for s, i in vocab.items():
            self.bytes[i] = s.encode() if s in special else bytes(to_byte[ch] for ch in s)
        for s, i in special.items():
            self.bytes[i] = s.encode()
        if len(special) != 1:
            raise ValueError(f"{path} has {len(special)} added tokens; files with one are supported")
        self.special, self.special_id = next(iter(special.items()))
        self.of_byte = [0] * 256
        for ch, b in to_byte.items():
            self.of_byte[b] = vocab[ch]
        #: (left id, right id) as one integer -> rank << 32 | merged id
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 32 | vocab[a + b])
        self.lens = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        sym = [self.of_byte[b] for b in data]
        n = len(sym)
        if n < 2:
            return sym
        get = self.merges.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if (m := get(sym[i] << 20 | sym[i + 1])) is not None:
                # rank, place (leftmost first), and the pair it was queued for
                queue.append((m >> 32, i, sym[i], sym[i + 1], m & 0xFFFFFFFF))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # stale: a neighbour has merged meanwhile
            sym[i], sym[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := get(merged << 20 | sym[k])) is not None:
                    heapq.heappush(queue, (m >> 32, i, merged, sym[k], m & 0xFFFFFFFF))
            if (h := before[i]) >= 0 and (m := get(sym[h] << 20 | merged)) is not None:
                heapq.heappush(queue, (m >> 32, h, sym[h], merged, m & 0xFFFFFFFF))
        return [x for x in sym if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        return self.merge(word.encode("utf-8"))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Vocabulary strings one after another."""
        return self.flat[ragged_index(self.starts[ids], self.lens[ids])].tobytes()


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(4)
def encoder(path: str) -> BatchEncoder:
    v = vocabulary(path)
    return BatchEncoder(v.encode_word, v.special, v.special_id)


@lru_cache(4)
def _decimal(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    said = [b"%d," % i for i in range(vocabulary(path).size)]
    lens = np.array(list(map(len, said)), np.int64)
    return np.frombuffer(b"".join(said), np.uint8), np.cumsum(lens) - lens, lens


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids array<int>. A null or empty text has no ids. Other columns are left out."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = encoder(path).encode([t or "" for t in batch.column("text").to_pylist()])
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "ids"]
        )

    out = map_texts(df, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, schema, run)
    return out.withColumnRenamed("id", id_col)


def bpe_decode(ids: np.ndarray, path: str) -> str:
    return vocabulary(path).decode_bytes(ids).decode("utf-8", "replace")


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode, then decode; per row the number of ids and SHA-256 digests of the ids and of the decoded text.

    A null text counts as empty; ids joined by commas. Ids never leave the task. Columns named in keep stay beside
    the digests, but those named like a digest give way to it; others are left out. Repeated rows are encoded each, very
    long texts whole; an empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in DIGESTS)
    kept = [f"keep_{k}" for k in range(len(keep))]
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            *(T.StructField(k, df.schema[c].dataType) for k, c in zip(kept, keep)),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, (flat, starts, lens) = vocabulary(path), _decimal(path)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        counts, of_ids, of_text = [], [], []
        step = 256
        for a in range(0, len(texts), step):
            ids, n = encoder(path).encode(texts[a : a + step])
            ends = np.cumsum(n)
            for s, e in zip((ends - n).tolist(), ends.tolist()):
                own = ids[s:e]
                joined = flat[ragged_index(starts[own], lens[own])]
                of_ids.append(hashlib.sha256(joined[:-1].tobytes()).hexdigest())
                said = v.decode_bytes(own).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(said.encode("utf-8")).hexdigest())
            counts.append(n)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), *map(batch.column, kept), pa.array(np.concatenate(counts)), pa.array(of_ids), pa.array(of_text)],
            schema.names,
        )

    columns = {"id": F.col(id_col), "text": F.col(text_col).cast("string")} | {k: F.col(c) for k, c in zip(kept, keep)}
    return map_texts(df, columns, schema, run).withColumnsRenamed({"id": id_col} | dict(zip(kept, keep)))
