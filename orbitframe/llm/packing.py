"""Packing of documents into training sequences, in order (operator 9).

Documents follow one another by doc_id. A dynamic programme over possible cuts (ends of documents,
of sentences, and a grid inside longer runs) chooses windows of at most ``size`` ids so that padding
plus penalties for cut sentences is least: best[j] = min over i in the window of best[i] + size -
(pos[j] - pos[i]) + penalty[j]. As best[i] + pos[i] is all that depends on i, a monotone queue gives
the best start; every end of a document or sentence is a cut. Windows whose length is a power of two
aren't padded; starts at these distances, from SHORT ids on, are looked up beside the queue. Each range partition of
doc_id is packed by itself, in runs of RUN ids and a slice of texts at most, which adds one shorter
window for a run.

Defined cases: a null text counts as empty (only the end id); null doc_ids come first; rows that
share a doc_id stay apart, in order of their text's hash; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .chunked import with_end, worker_words

RUN = 1 << 20
#: Penalties in ids: a cut at a sentence's end, and inside a sentence.
AT_SENTENCE, IN_SENTENCE = 2, 12
#: Gaps between cuts longer than LONG get cuts each GRID ids.
LONG, GRID = 48, 24
#: The shortest window that is made for its length's sake: shorter ones need no padding either, but teach little.
SHORT = 64
#: No cut; more than any penalty.
NONE = 255


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and their penalties. The last is the end."""
    cost = np.full(len(ids) + 1, NONE, np.uint8)
    cost[1:][sentence_end[ids]] = AT_SENTENCE
    cost[doc_ends] = 0
    cost[0] = NONE
    known = np.concatenate([[0], np.flatnonzero(cost != NONE)])
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > LONG)
    count = (gaps[wide] - 1) // GRID
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
    cost[np.repeat(known[wide], count) + GRID * step] = IN_SENTENCE
    every = np.flatnonzero(cost != NONE)
    return every, cost[every].astype(np.int64)


def exact_pairs(pos: np.ndarray, size: int, least: int) -> tuple[list[int], list[int]]:
    """(ends, starts) of all pairs of cuts whose distance is a power of two from ``least`` up to below ``size``, by end."""
    place = np.full(int(pos[-1]) + 1, -1, np.int32)
    place[pos] = np.arange(len(pos), dtype=np.int32)
    ends, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for k in range((least - 1).bit_length(), (size - 1).bit_length()):
        first = int(np.searchsorted(pos, 1 << k))
        at = place[pos[first:] - (1 << k)]
        hit = np.flatnonzero(at >= 0)
        ends.append(hit + first)
        starts.append(at[hit])
    end = np.concatenate(ends)
    order = np.argsort(end, kind="stable")
    return end[order].tolist(), np.concatenate(starts)[order].tolist()


def choose(cuts: np.ndarray, penalty: np.ndarray, size: int, least: int = SHORT) -> np.ndarray:
    """The ends of the windows of least padding plus penalty; a window of 2^k ids, ``least`` or more, isn't padded.

    The key of a cut is its best cost plus its position. The queue holds starts by rising key, and
    its first is the best padded start of a whole block of cuts, as far as it reaches. All of them
    cost the same but for their penalties, so only the last of each penalty can be the best start of
    a later window, beside those that an unpadded window reaches more cheaply. Such a window never
    pays from a cut of the same block that was itself reached by padding, so only pairs from earlier
    blocks and from cheaper cuts are looked at. A cut with a lower key than the block's start ends
    the block.
    """
    pos = np.concatenate([[0], cuts])
    reach = (np.searchsorted(pos, pos + size, "right") - 1).tolist()  # the last cut a window can end at
    last = [np.maximum.accumulate(np.concatenate([[0], np.where(penalty == k, np.arange(1, len(pos)), 0)])).tolist() for k in np.unique(penalty).tolist()]
    ends, starts = exact_pairs(pos, size, least)
    ends.append(len(pos))  # past the last cut
    where, cost, goal = pos.tolist(), [0, *penalty.tolist()], len(pos) - 1
    keys, back = {0: 0}, {}
    queue = deque([0])
    blocks, heads = [0], [0]  # last cut and start of each block
    done = at = 0
    while done < goal:
        i = queue.popleft()
        end = reach[i]
        if end <= done:
            continue
        low, cheaper = keys[i], []
        base = low + size
        while (j := ends[at]) <= end:
            e = starts[at]
            at += 1
            if e in keys or e <= done:
                if e not in keys:
                    head = heads[bisect_left(blocks, e)]
                    value = keys[head] + size + cost[e] - where[e]
                else:
                    head, value = None, keys[e] - where[e]
                key = value + cost[j] + where[j]
                if key < base + cost[j] and key < keys.get(j, base + cost[j]):
                    if head is not None:
                        keys[e], back[e] = value + where[e], head
                    if j not in keys:
                        cheaper.append(j)
                    keys[j], back[j] = key, e
            if cheaper and cheaper[-1] == j and ends[at] != j and keys[j] < low:
                end, cheaper = j, [j]
                break
        else:
            for k in last:
                if (j := k[end]) > done and j not in keys:
                    keys[j], back[j] = base + cost[j], i
                    cheaper.append(j)
            cheaper.sort()
        for j in cheaper:
            key = keys[j]
            while queue and keys[queue[-1]] > key:
                queue.pop()
            queue.append(j)
        blocks.append(end)
        heads.append(i)
        done = end
    out, j = [], goal
    while j:
        out.append(j)
        j = back[j]
    return pos[out[::-1]].astype(np.int64)


def pieces(doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each piece: first and last position, its document's and its window's index."""
    edges = np.unique(np.concatenate([doc_ends, ends]))
    starts = np.concatenate([[0], edges[:-1]])
    return starts, edges, np.searchsorted(doc_ends, starts, "right"), np.searchsorted(ends, starts, "right")


def sentence_table(words) -> np.ndarray:
    """Which ids end a sentence: those whose text ends in a stop or holds a line feed."""
    table = np.zeros(words.tokenizer.get_vocab_size() + 1, bool)
    for token, i in words.tokenizer.get_vocab().items():
        table[i] = token[-1:] in (".", "!", "?", "。", "Ċ")
    return table


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, size: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(path, True)
        table = sentence_table(words)
        sequence = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            ids, lengths = np.concatenate([x for x, _ in held]), np.concatenate([n for _, n in held])
            doc_ends = np.cumsum(lengths)
            ends = choose(*cut_points(ids, doc_ends, table), size)
            a, b, doc, window = pieces(doc_ends, ends)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[x:y]) for x, y in zip((4 * a).tolist(), (4 * b).tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(a - (doc_ends - lengths)[doc]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(sequence + window), pa.array(a - np.concatenate([[0], ends])[window])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(ends)
            keys.clear()
            held.clear()
            return out

        for batch in batches:
            at = 0
            for ids, number in words(batch.column(1)):
                held.append(with_end(ids, number, end_id))
                keys.append(batch.column(0).slice(at, len(number)))
                at += len(number)
                if sum(len(x) for x, _ in held) >= RUN:
                    yield flush()
        if keys:
            yield flush()

    # The text's hash parts rows that share an id, or have none, among tasks too.
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return dealt.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
