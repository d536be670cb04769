"""Archives of discs (CHD version 5): header, metadata and hunk map as DataFrames, hunks in parallel.

Paths are local, mounted, or any URI that pyarrow opens. Planning reads a few kilobytes of each
archive on the executors; hunks are then read in stretches of 256, dealt over all tasks, so that
one archive is decoded by many tasks and no decoded byte is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import blocks as B
from ..functions import scalars as S

STRETCH, MOST_LOGICAL, META_ENTRY = 256, 64 << 30, 16
# Symbols of the hunk map. 0 to 3 are the codec slots of the header.
NONE, SELF, PARENT, RUN_SHORT, RUN_LONG, SELF_SAME, SELF_NEXT, PARENT_SELF, PARENT_SAME, PARENT_NEXT = 4, 5, 6, 7, 8, 9, 10, 11, 12, 13
#: Bits of a hunk's length in maps that are written here; hops of a self reference at most.
LENGTH_BITS, MOST_HOPS = 15, 32


class BadArchive(ValueError):
    """An archive that cannot be read."""


@dataclass(frozen=True)
class Head:
    size: int
    codecs: tuple[str, ...]
    logical: int
    map_at: int
    meta_at: int
    hunk_bytes: int
    raw_sha1: bytes
    combined_sha1: bytes

    @property
    def hunks(self) -> int:
        return -(-self.logical // self.hunk_bytes)


@dataclass
class HunkMap:
    """A column for each field; ``source`` is the hunk that holds the data, itself if stored."""

    kind: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    crc: list[int] = field(default_factory=list)
    self_hunk: list[int | None] = field(default_factory=list)

    def source(self, hunk: int) -> int:
        for _ in range(MOST_HOPS + 1):
            target = self.self_hunk[hunk]
            if target is None:
                return hunk
            hunk = target
        raise BadArchive(f"self references of hunk {hunk} run in a circle")


def opened(path: str):
    """A random-access file of any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return pa.OSFile(path, "rb")
    if path.startswith("file:"):
        return pa.OSFile("/" + path[5:].lstrip("/"), "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def read_at(f, at: int, n: int, what: str) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) != n:
        raise BadArchive(f"the file ends within {what}")
    return bytes(data)


def read_head(f) -> Head:
    size = f.size()
    magic, _, version, tags, logical, map_at, meta_at, hunk_bytes, _, raw, combined = struct.unpack(">8sII16sQQQII20s20s", read_at(f, 0, 104, "the header"))
    if magic != b"MComprHD":
        raise BadArchive("not an archive")
    if version != 5:
        raise BadArchive(f"version {version}, not 5")
    codecs = tuple(tags[i : i + 4].decode("latin-1").strip("\0") for i in range(0, 16, 4))
    for i, tag in enumerate(codecs):
        if tag not in B.DECODERS and (tag or i == 0):
            raise BadArchive(f"codec {i} is {tag!r}, which has no decoder")
    if not hunk_bytes or hunk_bytes % B.SLOT:
        raise BadArchive(f"hunks of {hunk_bytes} bytes are no whole slots")
    for at in (map_at, meta_at):
        if at >= size:
            raise BadArchive(f"offset {at} is outside the file")
    if logical > MOST_LOGICAL:
        raise BadArchive(f"{logical} bytes are more than a disc has")
    return Head(size, codecs, logical, map_at, meta_at, hunk_bytes, raw, combined)


def read_meta(f, head: Head) -> list[tuple[str, int, bytes]]:
    """(tag, flags, payload) of each entry of the linked list."""
    out, at = [], head.meta_at
    while at:
        if len(out) >= head.size // META_ENTRY:
            raise BadArchive("the metadata run in a circle")
        tag, flags_length, after = struct.unpack(">4sIQ", read_at(f, at, META_ENTRY, "the metadata"))
        out.append((tag.decode("latin-1"), flags_length >> 24, read_at(f, at + META_ENTRY, flags_length & 0xFFFFFF, "the metadata")))
        at = after
    return out


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits): codes start at the longest length; each shorter one goes on at half."""
    out, start = {}, 0
    for bits in range(max(lengths, default=0), 0, -1):
        symbols = [s for s, n in enumerate(lengths) if n == bits]
        out |= {s: (start + i, bits) for i, s in enumerate(symbols)}
        start += len(symbols)
        if start % 2 and bits > 1:
            raise BadArchive("the code lengths of the map are no tree")
        start //= 2
    return out


class MapBits:
    """Bits of the map as one number: a few hundred kilobytes at most, read from the front in slices."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise BadArchive("the map ends early")
        first, last = self.at // 8, -(-end // 8)
        self.at = end
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - end) & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for bits in range(1, 16):
            code = code << 1 | self.take(1)
            if (code, bits) in codes:
                return codes[code, bits]
        raise BadArchive("the map has a code that is no symbol's")


def tree_lengths(b: MapBits) -> list[int]:
    """Sixteen lengths; 1 escapes: "1 1" is a one, "1 v n" is n + 3 times v."""
    out: list[int] = []
    while len(out) < 16:
        v = b.take(4)
        if v == 1:
            v = b.take(4)
            out += [v] * (1 if v == 1 else b.take(4) + 3)
        else:
            out.append(v)
    return out[:16]


def kinds(b: MapBits, codes: dict[tuple[int, int], int], n: int) -> list[int]:
    """Kind of each hunk; a run repeats the last kind, its own place included."""
    out: list[int] = []
    last = 0
    while len(out) < n:
        s = b.symbol(codes)
        if s == RUN_SHORT:
            out += [last] * (3 + b.symbol(codes))
        elif s == RUN_LONG:
            high = b.symbol(codes)
            out += [last] * (19 + (high << 4) + b.symbol(codes))
        else:
            last = s
            out.append(s)
    return out[:n]


def read_map(f, head: Head) -> HunkMap:
    size, first, _, length_bits, self_bits, _, _ = struct.unpack(">I6sHBBBB", read_at(f, head.map_at, 16, "the map"))
    if head.map_at + 16 + size > head.size:
        raise BadArchive("the map is longer than the file")
    if max(length_bits, self_bits) > 32:
        raise BadArchive("fields of the map are wider than 32 bits")
    b = MapBits(read_at(f, head.map_at + 16, size, "the map"))
    codes = {code: s for s, code in canonical(tree_lengths(b)).items()}
    out, at, target = HunkMap(), int.from_bytes(first, "big"), 0
    for hunk, kind in enumerate(kinds(b, codes, head.hunks)):
        length, crc, ref = 0, 0, None
        if kind <= NONE:
            if kind < NONE and not head.codecs[kind]:
                raise BadArchive(f"hunk {hunk} names the empty codec slot {kind}")
            length = head.hunk_bytes if kind == NONE else b.take(length_bits)
            crc = b.take(16)
        elif kind in (SELF, SELF_SAME, SELF_NEXT):
            target = b.take(self_bits) if kind == SELF else target + (kind == SELF_NEXT)
            ref = target
            if ref >= head.hunks:
                raise BadArchive(f"hunk {hunk} refers to hunk {ref}, past the end")
        elif kind in (PARENT, PARENT_SELF, PARENT_SAME, PARENT_NEXT):
            raise BadArchive(f"hunk {hunk} is in a parent archive")
        else:
            raise BadArchive(f"hunk {hunk} has the unknown kind {kind}")
        out.kind.append(kind)
        out.length.append(length)
        out.offset.append(at)
        out.crc.append(crc)
        out.self_hunk.append(ref)
        at += length
    return out


def decoded(f, name: str, hunk: int, codec: str | None, offset: int, length: int, crc: int, size: int) -> bytes:
    """The bytes of a stored hunk, held against its checksum."""
    block = read_at(f, offset, length, f"hunk {hunk} of {name}")
    try:
        data = block if codec is None else B.DECODERS[codec](block, size)
    except B.BadBlock as e:
        raise BadArchive(f"{name}: hunk {hunk}: {e}") from e
    if B.crc16(data) != crc:
        raise BadArchive(f"{name}: hunk {hunk} fails its checksum")
    return data


def read_hunk(f, head: Head, m: HunkMap, hunk: int, name: str = "archive") -> bytes:
    codec = None if m.kind[hunk] == NONE else head.codecs[m.kind[hunk]]
    return decoded(f, name, hunk, codec, m.offset[hunk], m.length[hunk], m.crc[hunk], head.hunk_bytes)


def stream(f, head: Head, m: HunkMap) -> Iterator[bytes]:
    """All hunks in order. What references repeat is kept, a stretch's worth at most."""
    kept: dict[int, bytes] = {}
    for hunk in range(head.hunks):
        source = m.source(hunk)
        data = kept.pop(source, None) or read_hunk(f, head, m, source)
        kept[source] = data
        if len(kept) > STRETCH:
            kept.pop(next(iter(kept)))
        yield data


# DataFrames

HEADERS = "path string, version int, codecs array<string>, logical_bytes bigint, map_offset bigint, meta_offset bigint, hunk_bytes int, hunks bigint, raw_sha1 string, combined_sha1 string"
META = "path string, ord int, tag string, flags int, payload binary"
MAP = "path string, hunk bigint, comp_type int, length bigint, offset bigint, crc int, self_hunk bigint, source bigint"


def each_path(schema: str, rows):
    """mapInArrow function: the rows that ``rows(path, file, head)`` gives for each path."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as f:
                        cols = rows(path, f, read_head(f))
                except BadArchive as e:
                    raise BadArchive(f"{path}: {e}") from e
                for i in range(0, len(cols[0]), 1 << 16):  # a map may have millions of rows
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)], t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return run


def listed(spark: SparkSession, root: str, ext: str = "chd") -> DataFrame:
    """(path, size) of all files below a folder with that extension in any case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return files.filter(F.lower("path").endswith("." + ext.lower()))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all tasks. The number is given, since small rows that stand for much work would be put in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def dealt(paths: DataFrame) -> DataFrame:
    return spread(paths.select("path"), "path")


def headers(paths: DataFrame) -> DataFrame:
    def rows(path, f, h):
        return [[x] for x in (path, 5, [c for c in h.codecs if c], h.logical, h.map_at, h.meta_at, h.hunk_bytes, h.hunks, h.raw_sha1.hex(), h.combined_sha1.hex())]

    return dealt(paths).mapInArrow(each_path(HEADERS, rows), HEADERS)


def metadata(paths: DataFrame) -> DataFrame:
    def rows(path, f, h):
        m = read_meta(f, h)
        return [[path] * len(m), list(range(len(m))), [x[0] for x in m], [x[1] for x in m], [x[2] for x in m]]

    return dealt(paths).mapInArrow(each_path(META, rows), META)


def hunk_map(paths: DataFrame) -> DataFrame:
    def rows(path, f, h):
        m, n = read_map(f, h), h.hunks
        return [[path] * n, list(range(n)), m.kind, m.length, m.offset, m.crc, m.self_hunk, [m.source(i) for i in range(n)]]

    return dealt(paths).mapInArrow(each_path(MAP, rows), MAP)


def tracks(paths: DataFrame) -> DataFrame:
    """(disc, pos, number, type, total, real, pregap, gdrom, start_lba, frames) from the metadata, pregaps inferred."""
    from ..operators import layout as L

    kv = S.parse_kv(F.col("payload").cast("string"))
    m = metadata(paths).filter(F.col("tag").isin("CHT2", "CHGD")).select(F.col("path").alias("disc"), F.col("ord").alias("pos"), "tag", kv.alias("kv"))

    def number(key: str):
        bad = F.raise_error(F.concat(F.col("disc"), F.lit(f": bad {key}"))).cast("long")
        return F.coalesce(F.col("kv")[key].try_cast("long"), bad)

    frames, pad = number("FRAMES"), F.when(F.col("kv")["PAD"].isNotNull(), number("PAD"))
    t = m.select(
        "disc", (F.row_number().over(L.order())).cast("long").alias("pos"), number("TRACK").alias("number"), S.cue_type(F.coalesce(F.col("kv")["TYPE"], F.lit(""))).alias("type"),
        F.when(pad.isNull(), S.align_up(frames, 4)).otherwise(frames).alias("total"), (frames - F.coalesce(pad, F.lit(0))).alias("real"), (F.col("tag") == "CHGD").alias("gdrom"),
    )
    return L.infer_pregaps(t).withColumn("frames", F.col("real")).withColumnRenamed("inferred", "pregap")


HUNKS = "path string, hunk bigint, data binary"
STRETCHES = "path string, stretch bigint, hunk_bytes int, hunk array<bigint>, source array<bigint>, codec array<string>, offset array<bigint>, length array<bigint>, crc array<int>, error string"
_LONGS = pa.list_(pa.int64())
_STRETCH = pa.schema([("path", pa.string()), ("stretch", pa.int64()), ("hunk_bytes", pa.int32()), ("hunk", _LONGS), ("source", _LONGS), ("codec", pa.list_(pa.string())), ("offset", _LONGS), ("length", _LONGS), ("crc", pa.list_(pa.int32())), ("error", pa.string())])


def stretches(paths: DataFrame, first: int = 0, end: int | None = None) -> DataFrame:
    """Where the bytes of the hunks from ``first`` up to ``end`` lie, a row for each stretch, self references followed.

    ``codec`` is null for bytes stored as they are. An archive that can't be planned has one row with its ``error``.
    """

    size = STRETCH

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with opened(path) as f:
                        h = read_head(f)
                        m = read_map(f, h)
                        last = h.hunks if end is None else min(end, h.hunks)
                        source = {i: m.source(i) for i in range(first, last)}
                except BadArchive as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "stretch": 0, "error": f"{path}: {e}"}], schema=_STRETCH)
                    continue
                for at in range(first // size * size, last, size):
                    own = range(max(first, at), min(at + size, last))
                    parts = [source[i] for i in own]
                    row = {"path": path, "stretch": at // size, "hunk_bytes": h.hunk_bytes, "hunk": list(own), "source": parts, "codec": [None if m.kind[x] == NONE else h.codecs[m.kind[x]] for x in parts]}
                    row |= {"offset": [m.offset[x] for x in parts], "length": [m.length[x] for x in parts], "crc": [m.crc[x] for x in parts]}
                    yield pa.RecordBatch.from_pylist([row], schema=_STRETCH)

    return spread(dealt(paths).mapInArrow(run, STRETCHES), "path", "stretch")


def decoded_stretch(row: dict) -> Iterator[tuple[int, bytes]]:
    """(hunk, data) of a row of ``stretches``; what many hunks refer to is decoded once."""
    if row["error"]:
        raise BadArchive(row["error"])
    uses: dict[int, int] = {}
    for x in row["source"]:
        uses[x] = uses.get(x, 0) + 1
    done: dict[int, bytes] = {}
    with opened(row["path"]) as f:
        for hunk, x, *how in zip(*(row[k] for k in ("hunk", "source", "codec", "offset", "length", "crc"))):
            data = done.get(x) or decoded(f, row["path"], x, *how, row["hunk_bytes"])
            uses[x] -= 1
            if uses[x]:
                done[x] = data
            else:
                done.pop(x, None)
            yield hunk, data


def hunks(paths: DataFrame, first: int = 0, end: int | None = None) -> DataFrame:
    """(path, hunk, data) of all hunks, or of those from ``first`` up to ``end``: no other is planned, read or shuffled.

    A damaged hunk is an error.
    """

    def run(batches):
        arrow = pa.schema([("path", pa.string()), ("hunk", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                some: list[tuple[int, bytes]] = []
                for one in decoded_stretch(row):
                    some.append(one)
                    if len(some) == 32:
                        yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(some)), pa.array([h for h, _ in some], pa.int64()), pa.array([d for _, d in some], pa.binary())], schema=arrow)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(some)), pa.array([h for h, _ in some], pa.int64()), pa.array([d for _, d in some], pa.binary())], schema=arrow)

    return stretches(paths, first, end).mapInArrow(run, HUNKS)


def sectors(paths: DataFrame) -> DataFrame:
    """(path, lba, sector): the slots of all hunks without their subcode, gaps between tracks included."""
    n = S.idiv(F.length("data"), B.SLOT)
    s = hunks(paths).select("path", "hunk", "data", n.alias("n")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return s.select("path", (F.col("hunk") * F.col("n") + F.col("slot")).alias("lba"), F.substring("data", (F.col("slot") * B.SLOT + 1).cast("int"), F.lit(B.SECTOR)).alias("sector"))
