"""Join of documents by Jaccard similarity of their word shingles (operator 7).

Two sets with 100 |A and B| >= 75 |A or B| share at least o = ceil(0.75 n) elements, n the size of
either. Under one order of all shingles (rarest first) they therefore share k elements among the
first n - o + k of both. The heavy-light join makes keys of that:
 - light sets (n up to a boundary x) enumerate the subsets of two elements of their prefix (k = 2);
 - heavy sets (n > x) scan the inverted lists of the single elements of their prefix (k = 1);
 - sets of x < n <= 4x/3 do both, so that every pair that can link shares a key of one kind.
The boundary is the x of least cost: subsets enumerated by light sets plus lengths of the lists
scanned by heavy ones, both summed over all documents by size.

How often a shingle occurs is counted exactly: each task packs its shingles by range of hash, lists
meet by range, and what occurs in one set only is dropped there: it can be in no overlap. What is
left of a set is all that verifying needs. Equal sets are one class from the start (copies within a
task before any shuffle). Pairs of a list are not enumerated: in a few turns each set is checked
against one leader of its lists, links are contracted, and lists of one component go. Sets that stay
apart after that meet by pairs, which places in the order rule out before any set is fetched, and in
long lists block by block within a task. So a group of m copies that link costs about m checks and m
links, and no link between components is lost.

A shingle is a 64-bit hash; lists and overlaps use its upper 40 + log2(ranges) bits. A range keeps
its lists packed, about four bytes for each set that holds a shingle, but a shingle that many sets of
a chunk hold is one entry for the chunk, whose sets never leave it.

Defined cases: null and empty texts have the empty set and link with nothing; repeated rows are one
class; doc_id may be null (the least id of a component ignores nulls); an empty table gives no
rows; other columns are ignored by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import graph, scratch, workers

WORDS = 5
PERCENT = 75
#: Shingles and documents that a task packs at a time; shingles of a range, about.
CHUNK, CHUNK_DOCS, RANGE = 2_000_000, 60_000, 500_000
#: Sets of a chunk that make a shingle a common one; what stands for all of them.
COMMON, EVERY = 512, 0xFFFF
#: Bits of a hash beyond its range's; ranges are at most 2 ** MOST_BITS.
BITS, MOST_BITS = 40, 24
#: Largest set size tried as boundary.
MOST_LIGHT = 48
#: Lists up to this length are joined by pairs, longer ones in blocks of this many members.
BLOCK = 512
#: Turns in which each set that stands apart is checked against one leader; members that a leader's copy serves.
TURNS, SALTED = 3, 1024

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_FIVE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of 64-bit shingle hashes, vectorised over the bytes of a text."""

    def __init__(self):
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(1 << n.bit_length(), 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)  # lower() of bytes: A-Z alone
        n = len(raw)
        if n >= len(self.powers):
            self._grow(n + 1)
        inside = np.concatenate([[False], ~_SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:n])])
            words = _mix((sums[ends] - sums[starts]) * self.inverse[starts])
            k = min(WORDS, len(words))
            count = len(words) - k + 1
            total = np.full(count, np.uint64(k))
            for i in range(k):
                total = total + words[i : i + count] * _FIVE[i]
            return np.unique(_mix(total))


def required(n):
    """Least overlap of a set of n with any set it links with."""
    return (PERCENT * n + 99) // 100


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte, compressed."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = [], 0
    for kind in kinds:
        w = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + w * n].reshape(w, n).T).view(kind).ravel())
        at += w * n
    return out


ROW = "range int, src long, n int, blob binary"
_NAMES = ["range", "src", "n", "blob"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _NAMES)


def _pack_lists(bits: int, many: int):
    """Documents -> packed lists by range of hash, a row (range -1) of the chunk's documents, and one (-2) of its common shingles.

    A shingle that ``many`` sets of a chunk hold goes to its range as one entry that says how many;
    its sets stay with the chunk. So no range's task holds a common shingle's list, whatever the input.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        shingler = Shingler()
        src = TaskContext.get().partitionId() << 24
        ids, texts, sets, classes, first, size = [], [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            nonlocal src, size
            lengths = np.array([len(x) for x in sets], np.int64)
            cls = np.array(classes, np.int64)
            own = list(first.values())  # one document of each class
            tokens = np.concatenate([sets[i] for i in own])
            docs = np.repeat(np.array(own, np.uint16), lengths[own])
            order = np.argsort(tokens, kind="stable")
            tokens, docs = tokens[order] >> np.uint64(64 - BITS - bits), docs[order]
            starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            times = np.diff(np.append(starts, len(tokens)))
            common = np.repeat(times >= many, times)
            rows = []
            if common.any():
                part = tokens[common]
                rows.append((-2, src, len(part), _packed(np.diff(part, prepend=np.uint64(0)).astype("<u8"), docs[common].astype("<u2"))))
                stays = ~common
                stays[starts] = True
                docs[starts[times >= many]] = EVERY
                times = np.where(docs[stays] == EVERY, np.repeat(times, times)[stays], 1)
                tokens, docs = tokens[stays], docs[stays]
            else:
                times = np.ones(len(tokens), np.int64)
            cuts = np.searchsorted(tokens >> np.uint64(BITS), np.arange((1 << bits) + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                part = tokens[a:b] & np.uint64((1 << BITS) - 1)
                rows.append((r, src, int(b - a), _packed(np.diff(part, prepend=np.uint64(0)).astype("<u8"), docs[a:b].astype("<u2"), times[a:b].astype("<u2"))))
            flags = np.zeros(len(ids), np.uint8)
            flags[own] = 1
            known = np.array([x if x is not None else 0 for x in ids], "<i8")
            null = np.array([x is None for x in ids], np.uint8)
            rows.append((-1, src, len(ids), _packed(known, null, lengths.astype("<i4"), cls.astype("<i8"), flags, np.array(texts, "<i8"))))
            src, size = src + 1, 0
            for x in (ids, texts, sets, classes, first):
                x.clear()
            return _rows(rows)

        for batch in batches:
            for k, t, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                s = shingler(t.as_py())
                c = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                if (c, len(s)) not in first:
                    first[c, len(s)] = len(ids)
                    size += len(s)
                sets.append(s)
                ids.append(k)
                texts.append(h)
                classes.append(c)
                if size >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield flush()
        if ids:
            yield flush()
        workers.trim()

    return work


def _groups(batches: Iterator[pa.RecordBatch], key: int | tuple[int, ...]) -> Iterator[tuple]:
    """Rows of a sorted partition, by the value of one column or some."""
    now, held = None, []
    of = operator.itemgetter(*key) if isinstance(key, tuple) else operator.itemgetter(key)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and of(row) != now:
                yield now, held
                held = []
            now = of(row)
            held.append(row)
    if held:
        yield now, held


def _list(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, docs, times = _unpacked(blob, n, "<u8", "<u2", "<u2")
    return np.cumsum(step, dtype=np.uint64), docs, times


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lists of a range -> for each chunk, its shingles that occur in two sets or more."""

    def of_ranges() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_numpy() < 0
            if mine.any():
                passed.append(batch.filter(pa.array(mine)))  # rows of chunks pass through
            yield batch.filter(pa.array(~mine))

    passed: list[pa.RecordBatch] = []
    for r, rows in _groups(of_ranges(), 0):
        yield from passed
        passed.clear()
        tokens, counts, waiting, pending = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merge():
            nonlocal tokens, counts, waiting, pending
            every = np.concatenate([tokens, *(a for a, _ in waiting)])
            number = np.concatenate([counts, *(b for _, b in waiting)])
            tokens, inverse = np.unique(every, return_inverse=True)
            counts = np.bincount(inverse, weights=number, minlength=len(tokens)).astype(np.int64)
            waiting, pending = [], 0

        for _, _, n, blob in rows:
            token, _, times = _list(blob, n)
            starts = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            waiting.append((token[starts], np.add.reduceat(times.astype(np.int64), starts)))
            pending += len(starts)
            if pending > 4_000_000:
                merge()
        merge()
        tokens, counts = tokens[counts > 1], counts[counts > 1]
        if not len(tokens):
            continue
        for _, src, n, blob in rows:
            token, docs, _ = _list(blob, n)
            at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
            keep = np.flatnonzero(tokens[at] == token)
            if len(keep):
                yield _rows([(r, src, len(keep), _packed(np.diff(token[keep], prepend=np.uint64(0)).astype("<u8"), docs[keep], np.minimum(counts[at[keep]], 0xFFFF).astype("<u2")))])
    yield from passed
    workers.trim()


SETS = "doc_id long, text_hash long, n int, cls long, own boolean, cost_light long, cost_heavy long, prefix binary, shared binary, n_shared int"


def _collect_sets(bits: int):
    """What a chunk's documents share with others -> a row for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for src, rows in _groups(batches, 1):
            own = next(r for r in rows if r[0] == -1)
            ids, null, size, cls, flags, texts = _unpacked(own[3], own[2], "<i8", "u1", "<i4", "<i8", "u1", "<i8")
            lists = [(r, *_unpacked(blob, n, "<u8", "<u2", "<u2")) for r, _, n, blob in rows if r >= 0]
            token = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(t, dtype=np.uint64) | np.uint64(r << BITS) for r, t, _, _ in lists)])
            doc = np.concatenate([np.zeros(0, np.uint16), *(d for _, _, d, _ in lists)])
            count = np.concatenate([np.zeros(0, np.uint16), *(c for *_, c in lists)])
            if rows[0][0] == -2:  # common shingles: their sets are the chunk's own
                step, held = _unpacked(rows[0][3], rows[0][2], "<u8", "<u2")
                name, common = np.cumsum(step, dtype=np.uint64), np.flatnonzero(doc == EVERY)
                common = common[np.argsort(token[common])]
                found = count[common][np.searchsorted(token[common], name)]
                rest = doc != EVERY
                token, doc, count = np.concatenate([token[rest], name]), np.concatenate([doc[rest], held]), np.concatenate([count[rest], found])
            order = np.lexsort((token, count, doc))
            token, doc, count = token[order], doc[order], count[order].astype(np.int64)
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
            heavy, light, prefix, shared, number = [], [], [], [], []
            for i, n in enumerate(size.tolist()):
                a, b = int(cuts[i]), int(cuts[i + 1])
                alone = n - (b - a)
                p = n - required(n) + 1
                if n < 3 or alone >= p:
                    heavy.append(0), light.append(0), prefix.append(None), shared.append(None), number.append(0)
                    continue
                one = max(0, min(p, n) - alone)
                two = max(0, min(p + 1, n) - alone)
                heavy.append(int(count[a : a + one].sum()))
                light.append(two * (two - 1) // 2)
                prefix.append(token[a : a + two].astype("<u8").tobytes())
                full = np.sort(token[a:b])
                shared.append(_packed(np.diff(full, prepend=np.uint64(0)).astype("<u8")))
                number.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(null, 0, ids), pa.int64(), mask=null.astype(bool)), pa.array(texts, pa.int64()), pa.array(size, pa.int32()), pa.array(cls, pa.int64()), pa.array(flags.astype(bool)), pa.array(light, pa.int64()), pa.array(heavy, pa.int64()), pa.array(prefix, pa.binary()), pa.array(shared, pa.binary()), pa.array(number, pa.int32())],
                ["doc_id", "text_hash", "n", "cls", "own", "cost_light", "cost_heavy", "prefix", "shared", "n_shared"],
            )
        workers.trim()

    return work


def boundary(by_size: dict[int, tuple[int, int]], rest: int) -> int:
    """The x of least cost; by_size: cost as a light and as a heavy set, by set size; rest: heavy costs beyond."""

    def cost(x: int) -> int:
        return sum(c[0] for n, c in by_size.items() if 3 * n <= 4 * x) + sum(c[1] for n, c in by_size.items() if n > x) + rest

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _keys(x: int):
    """Sets -> a row for each key: subsets of two of a light set, single elements of a heavy one.

    pos: its last element's place in the set's order, less k - 1. Two sets
    whose overlap must be o share a key with pos <= n - o on both sides.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, pos = [], [], [], []
            for node, n, m, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                token = np.frombuffer(raw, "<u8")
                place = np.arange(len(token)) + n - m  # elements of no other set come first
                found, where = [], []
                with np.errstate(over="ignore"):
                    if 3 * n <= 4 * x:
                        i, j = np.triu_indices(len(token), 1)
                        found.append(_mix(np.minimum(token[i], token[j]) * _FIVE[0] + np.maximum(token[i], token[j]) * _FIVE[1]))
                        where.append(place[j] - 1)
                    if n > x:
                        found.append(_mix(token[:-1] + np.uint64(1)))  # the prefix for k = 2 has one more
                        where.append(place[:-1])
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                keys.append(flat.view(np.int64))
                pos += where
                nodes.append(np.full(len(flat), node))
                sizes.append(np.full(len(flat), n, np.int32))
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array(join(keys, np.int64)), pa.array(join(nodes, np.int64)), pa.array(join(sizes, np.int32)), pa.array(join(pos, np.int32))], ["key", "node", "n", "pos"])

    return work


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (to, salt, member, node, n, n_shared, shared): a leader's set, then its members'."""
    leader: tuple = ()
    for batch in batches:
        a, b = [], []
        for to, salt, member, node, n, m, blob in zip(*(c.to_pylist() for c in batch.columns)):
            (steps,) = _unpacked(blob, m, "<u8")
            token = np.cumsum(steps, dtype=np.uint64)
            if not member:
                leader = (to, salt, n, token)
                continue
            if leader[:2] != (to, salt):
                raise ValueError("a leader's set is missing")
            other = leader[3]
            at = np.minimum(np.searchsorted(other, token), len(other) - 1)
            both = int((other[at] == token).sum()) if len(other) else 0
            if 100 * both >= PERCENT * (n + leader[2] - both):
                a.append(to)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (to, node), those that link, as (a, b).

    A leader's set is sent once for each SALTED members, so that no leader is one task's.
    """
    many = pairs.groupBy("to").agg(F.count("*").alias("members")).filter(F.col("members") > SALTED)
    salts = F.ceil(F.col("members") / F.lit(float(SALTED))).cast("int")
    pairs = pairs.join(many, "to", "left").select("to", "node", F.coalesce(F.pmod(F.xxhash64("node"), salts), F.lit(0)).cast("int").alias("salt"))
    body = sets.select("node", "n", "n_shared", "shared")
    members = pairs.join(body, "node").select("to", "salt", F.lit(True).alias("member"), "node", "n", "n_shared", "shared")
    leaders = pairs.select("to", "salt").distinct().join(body.withColumnRenamed("node", "to"), "to").select("to", "salt", F.lit(False).alias("member"), F.col("to").alias("node"), "n", "n_shared", "shared")
    dealt = members.union(leaders).repartition("to", "salt").sortWithinPartitions("to", "salt", "member")
    return dealt.mapInArrow(_verify, "a long, b long")


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, i, j, block, node, comp, n, n_shared, shared): all pairs of two blocks of a list.

    Gives a spanning set of the links between different components.
    """

    def tell(rows: list[tuple]) -> tuple[list, list]:
        rows = list({r[4]: r for r in rows}.values())
        sets = [np.cumsum(_unpacked(r[8], r[7], "<u8")[0], dtype=np.uint64) for r in rows]
        size = np.array([r[6] for r in rows], np.int64)
        block = np.array([r[3] for r in rows])
        comp = {c: i for i, c in enumerate(dict.fromkeys(r[5] for r in rows))}
        group = np.array([comp[r[5]] for r in rows])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        flag = np.zeros(len(names), np.int32)
        a, b = [], []
        for i in range(len(rows) - 1):
            later = np.arange(i + 1, len(rows))
            if rows[i][1] != rows[i][2] and not (block[later] != block[i]).any():
                continue
            own = flat[starts[i] : starts[i + 1]]
            flag[own] = 1
            both = np.add.reduceat(flag[flat[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
            flag[own] = 0
            for j in (later[(group[later] != group[i]) & (100 * both >= PERCENT * (size[later] + size[i] - both))]).tolist():
                if group[j] != group[i]:
                    a.append(rows[i][4])
                    b.append(rows[j][4])
                    group[group == group[j]] = group[i]
        return a, b

    for _, rows in _groups(batches, (0, 1, 2)):
        a, b = tell(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _overlap(p, q):
    """Least overlap of two linked sets of p and q."""
    return F.ceil(PERCENT * (p + q) / F.lit(100.0 + PERCENT) - 1e-9)


def _fits(n, pos, to_n, to_pos):
    """Whether sizes and places in the order allow a link."""
    o = _overlap(n, to_n)
    return (F.least(n, to_n) * 100 >= F.greatest(n, to_n) * PERCENT) & (pos <= n - o) & (to_pos <= to_n - o)


def _to_leaders(lists: DataFrame, turn: int) -> DataFrame:
    """(to, node): of each set that stands apart from a leader of its lists, one such leader.

    A list's leader is its set of least hash; the hash differs from turn to turn.
    """
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("to"), F.col("n").alias("to_n"), F.col("pos").alias("to_pos"), F.col("comp").alias("to_comp"))
    leaders = lists.groupBy("key").agg(F.min(order).alias("leader"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("key", "leader.*")
    near = lists.join(leaders, "key").filter((F.col("comp") != F.col("to_comp")) & _fits(F.col("n"), F.col("pos"), F.col("to_n"), F.col("to_pos")))
    return near.groupBy("node").agg(F.min(F.struct("h", "to")).alias("l")).select(F.col("l.to").alias("to"), "node")


def _standing_apart(lists: DataFrame) -> DataFrame:
    """Rows of lists of several components that can still link with one there, and the list's length m.

    Places beyond what the list's smallest set needs are left out.
    """
    mixed, _ = scratch.written(lists.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("low"), F.count("*").alias("m")).filter("c1 <> c2").select("key", "low", "m"), "mixed")
    smallest = F.greatest("low", F.ceil(F.col("n") * (PERCENT / 100) - 1e-9))
    return lists.drop("m").join(scratch.few(mixed), "key").filter(F.col("pos") <= F.col("n") - _overlap(F.col("n"), smallest)).select("key", "node", "n", "pos", "comp", "m")


def _moved(rows: DataFrame, top: DataFrame, name: str = "comp") -> DataFrame:
    """Rows whose column ``name``, a component, is replaced by what ``top`` says of it."""
    at = top.select(F.col("node").alias("was"), F.col("comp").alias("now"))
    return rows.join(at, F.col(name) == F.col("was"), "left").withColumn(name, F.coalesce("now", name)).drop("was", "now")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, node (its class of equal sets), comp (its component) of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = max(4, min(MOST_BITS, (max(1, size // 6 // RANGE)).bit_length()))
    lists = docs.select(docs[key].cast("long"), docs[text], F.xxhash64(docs[text])).mapInArrow(_pack_lists(bits, COMMON), ROW)
    spread = F.when(F.col("range") < 0, F.col("src")).otherwise(F.col("range"))
    counted = lists.repartition(spread).sortWithinPartitions("range", "src").mapInArrow(_count_lists, ROW)
    # Equal sets: one class; node is its hash, ties with the size.
    rows, rows_at = scratch.written(counted.repartition("src").sortWithinPartitions("src", "range").mapInArrow(_collect_sets(bits), SETS).withColumn("node", F.xxhash64("cls", "n")), "rows")
    held = rows.filter("prefix is not null and own")
    sets, _ = scratch.written(held.groupBy("node").agg(*(F.min(c).alias(c) for c in ("n", "cost_light", "cost_heavy", "prefix", "shared", "n_shared"))), "sets")
    named, _ = scratch.written(rows.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "node"), "named")
    scratch.drop(spark, rows_at)
    costs = sets.groupBy(F.least("n", F.lit(4 * MOST_LIGHT)).alias("n")).agg(F.sum("cost_light").alias("a"), F.sum("cost_heavy").alias("b")).collect()  # a row for each size up to the last
    by_size = {r.n: (r.a, r.b) for r in costs if r.n < 4 * MOST_LIGHT}
    x = boundary(by_size, sum(r.b for r in costs if r.n >= 4 * MOST_LIGHT))
    apart, apart_at = scratch.written(sets.select("node", "n", "n_shared", "prefix").mapInArrow(_keys(x), "key long, node long, n int, pos int").withColumn("comp", F.col("node")), "keys")
    comps, comps_at = scratch.written(sets.select("node", F.col("node").alias("comp")), "components")
    tried = None

    def merge(links: DataFrame) -> None:
        """Components after links (a, b): contracted to links between components, which are fewer."""
        nonlocal comps, comps_at
        ends = _moved(_moved(links, comps, "a"), comps, "b")
        new, new_at = scratch.written(_moved(comps, graph.components(ends)), "components")
        scratch.drop(spark, comps_at)
        comps, comps_at = new, new_at

    # Each turn gives a set one leader to be checked against, and goes on with the lists that stay mixed.
    for turn in range(TURNS):
        pairs, pairs_at = scratch.written(_to_leaders(apart, turn), "pairs")
        links, links_at = scratch.written(_checked(pairs, sets), "links")
        some = links.limit(1).count()
        if some:
            merge(links)
        scratch.drop(spark, links_at)
        tried = pairs if tried is None else tried.union(pairs)
        # The rows' components are looked up anew, by node.
        now = apart.drop("comp").join(comps, "node")
        left, left_at = scratch.written(_standing_apart(now), "apart")
        scratch.drop(spark, apart_at)
        apart, apart_at = left, left_at
        if not some:
            break
    # What still stands apart meets by pairs.
    one = apart.filter(F.col("m") <= BLOCK)
    two = one.select("key", *(F.col(c).alias(f"to_{c}") for c in ("n", "pos", "comp")), F.col("node").alias("to"))
    fits = _fits(F.col("n"), F.col("pos"), F.col("to_n"), F.col("to_pos"))
    rest = one.join(two, (one["key"] == two["key"]) & (F.col("to") < F.col("node")) & (F.col("comp") != F.col("to_comp")) & fits)
    rest = rest.select("to", "node").distinct().join(tried.select(F.least("to", "node").alias("to"), F.greatest("to", "node").alias("node")), ["to", "node"], "left_anti")
    rest, rest_at = scratch.written(rest, "pairs")
    # Long lists: blocks against blocks, so that a member is sent once for each block and not for each partner.
    blocks = F.ceil(F.col("m") / F.lit(float(BLOCK))).cast("int")
    long = apart.filter(F.col("m") > BLOCK).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    long = long.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "comp")
    dealt = long.join(sets.select("node", "n", "n_shared", "shared"), "node").select("key", "i", "j", "block", "node", "comp", "n", "n_shared", "shared")
    more = _checked(rest, sets).union(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_verify_blocks, "a long, b long"))
    more, more_at = scratch.written(more, "links")
    if more.limit(1).count():
        merge(more)
    scratch.drop(spark, apart_at, rest_at, more_at)
    return named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    found = classes(docs, key, text)
    least = found.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = found.filter("n_shingles > 0").join(least, "comp").select("doc_id", "n_shingles", "component_id")
    return linked.union(found.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the row of least id (null ids last), all columns; of repeated rows one.

    Rows without words link with nothing, so all of them stay. Columns of the input get names of
    their own here, so that none clashes with the helpers'.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)))
    key, text = (f"in_{docs.columns.index(c)}" for c in (key, text))
    found = classes(own, key, text)
    some = found.filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    stays = some.groupBy("comp").agg(F.min(order).alias("s"), F.count("*").alias("m")).filter("m > 1").select("comp", "s.id", "s.hash")
    # Up to a number of rows that go, the documents stay where they are.
    others = some.join(stays, "comp").filter(~(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))))
    gone, _ = scratch.written(others.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct(), "gone")
    rows = own.withColumn("hash", F.xxhash64(text)).withColumn("id", F.col(key).cast("long"))
    rows = rows.join(scratch.few(gone), F.col("id").eqNullSafe(F.col("g_id")) & (F.col("hash") == F.col("g_hash")), "left_anti")
    names = [f"in_{i}" for i in range(len(docs.columns))]
    # Rows whose id and text both recur are rare: only these are grouped.
    twice = some.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash"))
    twice, _ = scratch.written(twice, "twice")
    if twice.limit(1).count():
        same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("hash") == F.col("t_hash"))
        again = rows.join(twice, same, "left_semi").groupBy("id", "hash").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row")).select("row.*")
        rows = rows.join(twice, same, "left_anti").select(*names).union(again)
    return rows.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
