"""Token ids as binary files (operator 1).

Ids are replaced by their rank of frequency over all documents (ties: smaller id first), so the
commonest 256 take one byte, the next 65,280 two. Four ranks share a control byte of two-bit
lengths; control bytes and data bytes stand apart. A page holds whole documents:

    "RID1", u32 documents, u64 ids, u64 ids before it in its part, u32 control bytes,
    i64 doc_id x documents, u8 null flag x documents, u32 ids x documents, control, data

Pages are the BINARY column of a Parquet table (the container that every store reads), ordered by
(part, page); a part holds a range of doc_id, parts and pages ascend. Decoding looks lengths up
in a 256 x 4 table and ranks in the vocabulary's table; no loop over ids.

Defined cases: a null text counts as empty (only the end id); null doc_ids come first; rows that
share a doc_id stay apart, ordered by a hash of their ids; an empty table gives no pages; other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .chunked import with_end, worker_words

HEAD = struct.Struct("<4sIQQI")
#: Ids a page gathers before it is closed; a longer document has a page of its own.
PAGE_IDS = 1 << 16
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks (below 2**32)."""
    ranks = ranks.astype("<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(data, np.uint8)
    out = raw[ends - lengths].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[ends[more] - lengths[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def make_page(keys: list, ids: list[np.ndarray], rank_of: np.ndarray, before: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    control, data = pack(rank_of[flat])
    return b"".join((
        HEAD.pack(b"RID1", len(keys), len(flat), before, len(control)),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(),
        control, data,
    ))


def read_page(page: bytes, id_of: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, ids of each, all ids, ids before the page in its part."""
    magic, docs, n, before, c = HEAD.unpack_from(page)
    if magic != b"RID1":
        raise ValueError("not a page of ids")
    at = HEAD.size
    keys = np.frombuffer(page, "<i8", docs, at).tolist()
    null = np.frombuffer(page, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(page, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    ids = id_of[unpack(page[at : at + c], page[at + c :], n)]
    return [None if z else k for k, z in zip(keys, null)], lengths, ids, before


def encode(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (packed, 16 bits where the vocabulary fits) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path, False)
        for batch in batches:
            at = 0
            for ids, number in words(batch.column(1)):
                ids, number = with_end(ids, number, end_id)
                n, edges = len(number), np.concatenate([[0], np.cumsum(number)]) * words.dtype.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n).cast(pa.int64()), packed.cast(pa.binary())], ["doc_id", "ids"])
                at += n

    return docs.select(key, text).mapInArrow(work, "doc_id long, ids binary")


def rank_table(ids: DataFrame, size: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """rank_of[id] and id_of[rank], from the counts over all rows; bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    def count_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined():
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    flat = b"".join(batch.column(0).slice(at, 4096).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([flat], pa.binary())], ["ids"])

        return count(joined())

    found = ids.select("ids").mapInArrow(count_joined, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for row in found:
        total[row.id] = row.n
    id_of = np.lexsort((np.arange(size), -total))
    rank_of = np.empty(size, np.int64)
    rank_of[id_of] = np.arange(size)
    return rank_of.astype(np.uint32), id_of.astype(np.uint32)


def write_pages(ids: DataFrame, rank_of: np.ndarray, dtype: str) -> tuple[DataFrame, str]:
    """Write all rows, ascending by doc_id, as pages; columns part, page, first_doc, n_ids, body."""
    ranks = ids.sparkSession.sparkContext.broadcast(rank_of)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, page, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal page, before, size
            body = make_page(keys, held, ranks.value, before)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([page], pa.int64()), pa.array([keys[0]], pa.int64()), pa.array([size], pa.int64()), pa.array([body], pa.binary())], ["part", "page", "first_doc", "n_ids", "body"])
            page, before, size = page + 1, before + size, 0
            keys.clear()
            held.clear()
            return out

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                held.append(np.frombuffer(x, dtype))
                size += len(held[-1])
                if size >= PAGE_IDS:
                    yield close()
        if keys:
            yield close()

    # The ids' hash parts rows that share a doc_id, or have none, among tasks too.
    dealt = ids.withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    return scratch.written(dealt.mapInArrow(work, "part int, page long, first_doc long, n_ids long, body binary"), "pages", "none")


def read_pages(pages: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone."""
    spark = pages.sparkSession
    parts = pages.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row for each file written
    offsets, total = {}, 0
    for row in parts:
        offsets[row.part] = total
        total += row.n
    shared = spark.sparkContext.broadcast((offsets, id_of))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, id_of = shared.value
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, lengths, ids, before = read_page(body.as_py(), id_of)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(offsets[part] + before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return pages.select("part", "body").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Encode, write the pages in ascending doc_id order, and read the pages back."""
    words = worker_words(path, False)
    size, dtype = words.tokenizer.get_vocab_size(), words.dtype.str
    ids, at = scratch.written(encode(docs, path, end_id), "ids")
    rank_of, id_of = rank_table(ids, size, dtype)
    pages, _ = write_pages(ids, rank_of, dtype)
    scratch.drop(docs.sparkSession, at)
    return read_pages(pages, id_of)
