"""Byte-level BPE by public ranks: encoding with a segment tree, and decoding (operator 10).

The tree's leaves are the byte positions of a pre-token. A leaf holds the rank of the pair that
starts there (and the position, so that the minimum is the leftmost), the root the least of all.
Each merge takes the root's pair and updates the two live neighbours and the vanished position:
O(log n) each, so a run of 100,000 equal letters costs n log n, not n squared.

Defined cases: null and empty texts have no ids; doc_id may be null or repeated (a row each);
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import workers
from .chunked import WordIds

NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    bits = n.bit_length()
    mask = (1 << bits) - 1
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 2))
    before = list(range(-1, n + 1))
    while (least := tree[1]) != NONE:
        i = least & mask
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        changed = [(j, NONE)] if j < n - 1 else []
        r = get(piece[i : after[k]]) if k < n else None
        changed.append((i, NONE if r is None else r << bits | i))
        p = before[i]
        if p >= 0:
            r = get(piece[p:k])
            changed.append((p, NONE if r is None else r << bits | p))
        for at, value in changed:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Bpe:
    """Encoder and decoder of one ranks file; words already seen are kept (see WordIds)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.dtype = np.dtype("<u2" if max(self.ranks.values()) < 1 << 16 else "<u4")
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        find, ranks, kind = regex.compile(pattern).findall, self.ranks, self.dtype

        def encode(words: list[str], lead: str) -> list[bytes]:
            return [np.array([i for piece in find(lead + w) for i in merge_piece(piece.encode("utf-8", "surrogatepass"), ranks)], kind).tobytes() for w in words]

        self.words = WordIds(encode, kind.str, blank=True, most=900_000)

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for ids, number in self.words(texts):
            yield from np.split(ids, np.cumsum(number)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def worker_bpe(path: str, pattern: str) -> Bpe:
    return workers.kept((path, pattern), lambda: Bpe(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, its ids as little-endian 32-bit integers, and the bytes decoded from them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = list(bpe.encode_batch(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(key, text).mapInArrow(work, f"{_key_type(docs, key)}, n_tokens long, ids binary, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_documents, with SHA-256 digests in place of ids and bytes (those stay in the worker)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode_batch(batch.column(1)):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(work, f"{_key_type(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _key_type(docs: DataFrame, key: str) -> str:
    return f"doc_id {docs.schema[key].dataType.simpleString()}"
