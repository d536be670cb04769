"""Disc images: archives written, extracted and verified, tracks copied, discs described.

Bytes move in stretches of hunks or of files, so that one disc keeps many tasks busy; what has to
be one sequence (a digest, the file of an archive) is one task per disc, in bounded memory. Tasks
write to places of their own or the same bytes to the same place, so a task that runs again, or
twice, does no harm. Targets and the work folder have to be mounted on all executors.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import blocks as B
from ..functions import scalars as S
from ..sources import archive as A
from ..sources import sheets as H
from . import layout as L

CODECS = {"cdzl": ("cdzl",), "cdzl,cdfl": ("cdzl", "cdfl")}
COPY_BYTES = 1024 * S.SECTOR * 16


# Layout of an archive to be written


def write_plan(t: DataFrame) -> DataFrame:
    """(disc, tracks): a disc's tracks as they are stored, at most 99, in order; start_lba is in stored frames.

    With a dense area, a pregap goes to the end of the track before and the bridge is stored up
    to the area's start; else a track is its whole file.
    """
    dense = F.col("bridge").between(1, F.max("pos").over(L.whole()))
    moved = F.when(F.col("dense") & (F.col("pos") > 1), F.col("pregap")).otherwise(0)
    t = t.withColumn("dense", F.coalesce(dense, F.lit(False))).withColumn("frames", F.col("frames") + F.col("pregap")).withColumn("pregap", F.when(F.col("dense"), F.col("pregap")).otherwise(0).cast("long")).withColumn("skip", moved.cast("long"))
    t = L.allocate(L.pad_bridge(L.shift_pregaps(t)))
    row = F.struct("pos", "number", "type", "file", "skip", "frames", "trailing", "stored", "total", "start_lba")
    return t.groupBy("disc").agg(F.array_sort(F.collect_list(row)).alias("tracks"))


def runs(tracks: list[dict]) -> list[tuple[int, int, str, int, bool]]:
    """(first lba, sectors, file, first sector there, audio) of what comes from files; all else is zero."""
    out = []
    for i, t in enumerate(tracks):
        if t["frames"] < 0 or t["frames"] + t["trailing"] > t["total"]:
            raise A.BadArchive(f"track {t['number']} does not fit its place")
        out.append((t["start_lba"], t["frames"], t["file"], t["skip"], t["type"].upper() == "AUDIO"))
        if t["trailing"]:
            after = tracks[i + 1]
            out.append((t["start_lba"] + t["total"] - t["trailing"], t["trailing"], after["file"], 0, after["type"].upper() == "AUDIO"))
    return out


def disc_hunks(tracks: list[dict], first: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """(hunk, holds audio) for a range of hunks."""
    sources = runs(tracks)
    for at in range(first, end, 64):
        n = min(64, end - at) * B.HUNK_SLOTS
        low, slots, audio = at * B.HUNK_SLOTS, np.zeros((n, B.SLOT), np.uint8), np.zeros(n, bool)
        for lba, count, file, skip, is_audio in sources:
            a, b = max(lba, low), min(lba + count, low + n)
            if a >= b:
                continue
            with A.opened(file) as f:
                data = A.read_at(f, (skip + a - lba) * B.SECTOR, (b - a) * B.SECTOR, file)
            data = B.swapped(data) if is_audio else data
            slots[a - low : b - low, : B.SECTOR] = np.frombuffer(data, np.uint8).reshape(-1, B.SECTOR)
            audio[a - low : b - low] = is_audio
        for i in range(0, n, B.HUNK_SLOTS):
            yield slots[i : i + B.HUNK_SLOTS].tobytes(), bool(audio[i : i + B.HUNK_SLOTS].any())


def hunk_count(tracks: list[dict]) -> int:
    return -(-sum(t["total"] for t in tracks) // B.HUNK_SLOTS)


# Writing archives

RECORDS = "target string, hunk bigint, kind int, length bigint, crc int, sha1 binary, file string, at bigint"


def encode_hunks(discs: DataFrame, codecs: tuple[str, ...], work: str) -> DataFrame:
    """RECORDS of all hunks of (target, tracks); the blocks go to a file of each stretch in ``work``."""
    total = F.aggregate(F.transform("tracks", lambda t: t["total"]), F.lit(0).cast("long"), lambda a, x: a + x)
    size = A.STRETCH
    stretches = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), S.idiv(total + 7, 8) - 1).cast("long"), F.lit(size).cast("long"))
    todo = A.spread(discs.select("target", "tracks", F.explode(stretches).alias("first")), "target", "first")

    def run(batches):
        arrow = pa.schema([("target", pa.string()), ("hunk", pa.int64()), ("kind", pa.int32()), ("length", pa.int64()), ("crc", pa.int32()), ("sha1", pa.binary()), ("file", pa.string()), ("at", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                out, at, file = [], 0, os.path.join(work, f"{uuid.uuid4().hex}.blocks")
                with open(file, "wb") as f:
                    for i, (hunk, audio) in enumerate(disc_hunks(row["tracks"], row["first"], min(row["first"] + size, hunk_count(row["tracks"])))):
                        slot, block = B.encode(hunk, audio, codecs)
                        out.append((row["target"], row["first"] + i, A.NONE if slot is None else slot, len(block), B.crc16(hunk), hashlib.sha1(hunk).digest(), file, at))
                        f.write(block)
                        at += len(block)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), arrow)], schema=arrow)

    return todo.mapInArrow(run, RECORDS)


def map_bytes(kinds: list[int], lengths: list[int], crcs: list[int], refs: list[int | None], first: int, codecs: tuple[str, ...]) -> bytes:
    """The map with its header: a fixed tree, all symbols, then what belongs to each."""
    symbols, last, most, plain, at = [], 0, 0, bytearray(), first
    for kind, length, crc, ref in zip(kinds, lengths, crcs, refs):
        if ref is None:
            symbols.append(kind)
            plain += bytes((kind,)) + length.to_bytes(3, "big") + at.to_bytes(6, "big") + crc.to_bytes(2, "big")
            at += length
            continue
        symbols.append(A.SELF_SAME if ref == last else A.SELF_NEXT if ref == last + 1 else A.SELF)
        most, last = max(most, ref if symbols[-1] == A.SELF else 0), ref
        plain += bytes((A.SELF, 0, 0, 0)) + ref.to_bytes(6, "big") + b"\0\0"
    # Bits of each symbol's code.
    bits = [0] * 16
    bits[0], bits[A.NONE], bits[A.SELF], bits[A.SELF_SAME], bits[A.SELF_NEXT] = 1, 3, 3, 3, 3
    if len(codecs) > 1:
        bits[1], bits[A.SELF_SAME], bits[A.SELF_NEXT] = 3, 4, 4
    codes, width = A.canonical(bits), most.bit_length()
    parts = [f"{n:04b}" * (2 if n == 1 else 1) for n in bits]
    parts += [f"{codes[s][0]:0{codes[s][1]}b}" for s in symbols]
    for s, length, crc, ref in zip(symbols, lengths, crcs, refs):
        if s < A.NONE:
            parts.append(f"{length:0{A.LENGTH_BITS}b}{crc:016b}")
        elif s == A.NONE:
            parts.append(f"{crc:016b}")
        elif s == A.SELF and width:
            parts.append(f"{ref:0{width}b}")
    text = "".join(parts)
    body = np.packbits(np.frombuffer(text.encode(), np.uint8) - ord("0")).tobytes()
    return struct.pack(">I6sHBBBB", len(body), first.to_bytes(6, "big"), B.crc16(bytes(plain)), A.LENGTH_BITS, width, 0, 0) + body


def track_text(t: dict, dense: bool) -> bytes:
    kind = "AUDIO" if t["type"].upper() == "AUDIO" else "MODE2_RAW" if t["type"].upper() == "MODE2/2352" else "MODE1_RAW"
    frames = f"FRAMES:{t['total']} PAD:{t['total'] - t['frames']}" if dense else f"FRAMES:{t['frames']}"
    return f"TRACK:{t['number']} TYPE:{kind} SUBTYPE:NONE {frames} PREGAP:0 PGTYPE:{'AUDIO' if kind == 'AUDIO' else 'MODE1'} PGSUB:NONE POSTGAP:0\0".encode()


def combined(raw: bytes, metas: list[tuple[str, int, bytes]]) -> bytes:
    """Digest of the raw digest and of the flagged metadata, whatever their order."""
    return hashlib.sha1(raw + b"".join(sorted(tag.encode("latin-1") + hashlib.sha1(payload).digest() for tag, flags, payload in metas if flags & 1))).digest()


def assemble(target: str, tracks: list[dict], records: list[tuple], codecs: tuple[str, ...]) -> str:
    """Put the archive together beside its target and move it there; returns the raw digest.

    ``records`` are (kind, length, crc, sha1, file, at) in order of hunks. What equals an earlier
    hunk becomes a reference to the first such.
    """
    seen: dict[bytes, int] = {}
    refs: list[int | None] = []
    for i, r in enumerate(records):
        first = seen.setdefault(r[3], i)
        refs.append(None if first == i else first)
    dense = any(t["stored"] for t in tracks)
    metas = [("CHGD" if dense else "CHT2", 1, track_text(t, dense)) for t in tracks]
    meta, at = b"", 124
    for i, (tag, flags, payload) in enumerate(metas):
        at += A.META_ENTRY + len(payload)
        meta += struct.pack(">4sIQ", tag.encode(), flags << 24 | len(payload), at if i + 1 < len(metas) else 0) + payload
    map_at, columns = 124 + len(meta), ([r[0] for r in records], [r[1] for r in records], [r[2] for r in records], refs)
    size = len(map_bytes(*columns, 0, codecs))
    first = -(-(map_at + size) // B.HUNK) * B.HUNK
    digest, n = hashlib.sha1(), len(records)
    for hunk, _ in disc_hunks(tracks, 0, n):
        digest.update(hunk)
    raw = digest.digest()
    tags = b"".join(c.encode() for c in codecs).ljust(16, b"\0")
    head = struct.pack(">8sII16sQQQII20s20s20s", b"MComprHD", 124, 5, tags, n * B.HUNK, map_at, 124, B.HUNK, B.SLOT, raw, combined(raw, metas), bytes(20))
    staged = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{uuid.uuid4().hex}")
    try:
        with open(staged, "wb") as out:
            out.write(head + meta + map_bytes(*columns, first, codecs))
            out.write(bytes(first - out.tell()))
            name, f = None, None
            for r, ref in zip(records, refs):
                if ref is None:
                    if name != r[4]:
                        if f:
                            f.close()
                        name, f = r[4], open(r[4], "rb")
                    f.seek(r[5])
                    out.write(f.read(r[1]))
            if f:
                f.close()
        os.chmod(staged, 0o644)
        os.replace(staged, target)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    return raw.hex()


WRITTEN = "target string, tracks int, bytes bigint, raw_sha1 string"


def write_archives(spark: SparkSession, discs: DataFrame, codec: str = "cdzl,cdfl", force: bool = False, work: str | None = None) -> list[dict]:
    """Write (disc, tracks, target) as archives; returns a row of WRITTEN for each.

    Targets that exist are an error without ``force``. Encoding is dealt in stretches of all
    discs; putting together is one task per disc.
    """
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is none of {', '.join(CODECS)}")
    codecs = CODECS[codec]
    work = work_folder(spark, work)
    try:
        discs.write.parquet(f"{work}/discs")
        discs = spark.read.parquet(f"{work}/discs")

        def check(batches):
            for batch in batches:
                for target in batch.column("target").to_pylist():
                    if os.path.exists(target) and not force:
                        raise FileExistsError(f"{target} exists")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                yield batch

        discs.select("target").mapInArrow(check, "target string").write.format("noop").mode("overwrite").save()
        encode_hunks(discs, codecs, work).write.parquet(f"{work}/records")
        records = spark.read.parquet(f"{work}/records")
        plans = discs.select("target", F.lit(-1).cast("long").alias("hunk"), F.to_json("tracks").alias("plan"))
        both = A.spread(records.withColumn("plan", F.lit(None).cast("string")).unionByName(plans, allowMissingColumns=True), "target").sortWithinPartitions("target", "hunk")

        def run(batches):
            import json

            def done(target, tracks, rows):
                raw = assemble(target, tracks, rows, codecs)
                one = (target, len(tracks), sum(t["frames"] for t in tracks) * B.SECTOR, raw)
                return pa.RecordBatch.from_arrays([pa.array([one[0]]), pa.array([one[1]], pa.int32()), pa.array([one[2]], pa.int64()), pa.array([one[3]])], names=["target", "tracks", "bytes", "raw_sha1"])

            target, tracks, rows = None, [], []
            for batch in batches:
                for r in batch.to_pylist():
                    if r["target"] != target:
                        if target is not None:
                            yield done(target, tracks, rows)
                        target, tracks, rows = r["target"], json.loads(r["plan"]), []
                    else:
                        rows.append((r["kind"], r["length"], r["crc"], r["sha1"], sys.intern(r["file"]), r["at"]))
            if target is not None:
                yield done(target, tracks, rows)

        both.mapInArrow(run, WRITTEN).write.parquet(f"{work}/written")
        return [r.asDict() for r in spark.read.parquet(f"{work}/written").collect()]
    finally:
        shutil.rmtree(work, ignore_errors=True)


def work_folder(spark: SparkSession, work: str | None) -> str:
    """A folder of this job's own, below ``work`` or the session's shared folder."""
    shared = work or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("name a work folder that all executors share, or set spark.checkpoint.dir")
    out = os.path.join(H.local(shared), f"images-{uuid.uuid4().hex}")
    os.makedirs(out)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a session of one machine gets a temporary one where none is set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orbitframe-")
        sc.setCheckpointDir(folder)
    return folder


# Extraction and copies


def archive_spans(paths: DataFrame) -> DataFrame:
    return L.spans(A.tracks(paths)).withColumn("mark_lba", F.col("start_lba"))


def put(folder: str, name: str, at: int, data: bytes) -> None:
    """Bytes at their place of a file, in a folder that is made if need be; writing them again changes nothing."""
    os.makedirs(folder, exist_ok=True)
    fd = os.open(os.path.join(folder, name), os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        os.pwrite(fd, data, at)
    finally:
        os.close(fd)


def extract(hunks: DataFrame, places: DataFrame) -> None:
    """Write the sectors of all hunks to (disc, folder, spans): each task writes whole runs of sectors.

    The spans of a disc, at most 99, come to its hunks by an equi-join on the disc. A hunk past
    all spans is still decoded and checked.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, n = row["data"], len(row["data"]) // B.SLOT
                sectors, low = B.split(data)[0], row["hunk"] * n
                for t in row["spans"]:
                    a, b = max(t["span_start"], low), min(t["span_end"], low + n)
                    if a < b:
                        part = sectors[a - low : b - low].tobytes()
                        put(row["folder"], t["name"], (a - t["span_start"]) * B.SECTOR, B.swapped(part) if t["audio"] else part)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    joined = hunks.withColumnRenamed("path", "disc").join(F.broadcast(places) if small(places) else places, "disc")
    joined.mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


def small(t: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of discs, a few kilobytes each, has few enough rows to send to every executor."""
    return t.limit(most + 1).count() <= most


def copy_tracks(t: DataFrame) -> None:
    """Copy (file, pregap, folder, name, size) without the pregap, in pieces; a part sector at the end goes too."""
    length = F.greatest(F.col("size") - F.col("pregap") * S.SECTOR, F.lit(0))
    pieces = t.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), length, F.lit(COPY_BYTES).cast("long")))).withColumn("n", F.least(F.lit(COPY_BYTES), length - F.col("at")))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                with A.opened(r["file"]) as f:
                    put(r["folder"], r["name"], r["at"], A.read_at(f, r["pregap"] * S.SECTOR + r["at"], r["n"], r["file"]) if r["n"] else b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    A.spread(pieces.select("file", "pregap", "folder", "name", "at", "n"), "file", "at").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


class Staged:
    """A folder beside the target that takes its place on success, and goes otherwise."""

    def __init__(self, target: str, force: bool):
        self.target = H.local(target).rstrip("/")
        if os.path.exists(self.target) and not os.path.isdir(self.target):
            raise FileExistsError(f"{self.target} is a file")
        if os.path.isdir(self.target) and os.listdir(self.target) and not force:
            raise FileExistsError(f"{self.target} is not empty")
        self.work = os.path.join(os.path.dirname(self.target), f".{os.path.basename(self.target)}.{uuid.uuid4().hex}")
        os.makedirs(self.work)

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            old = f"{self.work}.old"
            if os.path.isdir(self.target):
                os.rename(self.target, old)
            os.rename(self.work, self.target)
            shutil.rmtree(old, ignore_errors=True)
        else:
            shutil.rmtree(self.work, ignore_errors=True)


# Digests

REPORT = "path string, hunks bigint, tracks int, logical_bytes bigint, raw_sha1 string, combined_sha1 string, track_sha1 array<string>, error string"
DECODED = "path string, stretch bigint, file string, error string"


def decode_stretches(paths: DataFrame, folder: str) -> DataFrame:
    """DECODED of all stretches: their hunks decoded and checked, packed in a file of their own in ``folder``."""

    def run(batches):
        import zstandard

        for batch in batches:
            for row in batch.to_pylist():
                file, error = os.path.join(folder, f"{uuid.uuid4().hex}.hunks"), None
                try:
                    with open(file, "wb") as f, zstandard.ZstdCompressor(level=1).stream_writer(f) as out:
                        for _, data in A.decoded_stretch(row):
                            out.write(data)
                except A.BadArchive as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["stretch"]], pa.int64()), pa.array([file]), pa.array([error], pa.string())], names=["path", "stretch", "file", "error"])

    return A.stretches(paths).mapInArrow(run, DECODED)


def read_decoded(files: list[dict], hunk_bytes: int) -> Iterator[bytes]:
    """The hunks of an archive's rows of DECODED, in order; the first damage is raised where it stands."""
    import zstandard

    for row in sorted(files, key=lambda r: r["stretch"]):
        if row["error"]:
            raise A.BadArchive(row["error"])
        with open(row["file"], "rb") as f, zstandard.ZstdDecompressor().stream_reader(f) as r:
            while data := r.read(hunk_bytes):
                yield data


def verify(paths: DataFrame, work: str | None = None) -> DataFrame:
    """A row of REPORT for each archive: every hunk decoded, checked and hashed.

    With ``work``, a folder that all executors share, hunks are decoded and checked in stretches by
    all tasks and only the digests, which are one sequence each, are folded by one task per archive;
    the reports stay in that folder. Without, an archive is one task's. ``error`` says what is wrong
    (null: nothing); the digests found are given where all hunks decode.
    """
    spark = paths.sparkSession
    spans = L.spans(A.tracks(paths)).groupBy(F.col("disc").alias("path")).agg(F.array_sort(F.collect_list(F.struct("pos", "span_start", "span_end", S.is_audio(F.col("type")).alias("audio")))).alias("spans"))

    def one(path: str, spans: list[dict], files: list[dict] | None) -> tuple:
        with A.opened(path) as f:
            head = A.read_head(f)
            m, metas = A.read_map(f, head), A.read_meta(f, head)
            raw, sums, left, n = hashlib.sha1(), [hashlib.sha1() for _ in spans], head.logical, head.hunk_bytes // B.SLOT
            for hunk, data in enumerate(A.stream(f, head, m) if files is None else read_decoded(files, head.hunk_bytes)):
                data = data[:left]
                left -= len(data)
                raw.update(data)
                whole, low = len(data) // B.SLOT, hunk * n
                sectors = B.split(data[: whole * B.SLOT])[0]
                for t, h in zip(spans, sums):
                    a, b = max(t["span_start"], low), min(t["span_end"], low + whole)
                    if a < b:
                        part = sectors[a - low : b - low].tobytes()
                        h.update(B.swapped(part) if t["audio"] else part)
        if left:
            raise A.BadArchive(f"{path}: {left} bytes of its hunks are missing")
        own = raw.digest(), combined(raw.digest(), metas)
        error = "the data's digest is not the header's" if own[0] != head.raw_sha1 else "the metadata's digest is not the header's" if own[1] != head.combined_sha1 else None
        return path, head.hunks, len(spans), head.logical, own[0].hex(), own[1].hex(), [h.hexdigest() for h in sums], error

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        names = [c.split()[0] for c in REPORT.split(", ")]
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    row = one(r["path"], r["spans"], r["files"])
                except A.BadArchive as e:
                    row = (r["path"], None, len(r["spans"]), None, None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    if work is None:
        return A.spread(spans.withColumn("files", F.lit(None).cast("array<struct<stretch:bigint,file:string,error:string>>")), "path").mapInArrow(run, REPORT)
    folder = work_folder(spark, work)
    try:
        os.makedirs(f"{folder}/hunks")
        decode_stretches(paths, f"{folder}/hunks").write.parquet(f"{folder}/decoded")
        files = spark.read.parquet(f"{folder}/decoded").groupBy("path").agg(F.collect_list(F.struct("stretch", "file", "error")).alias("files"))
        whole = spans.join(files, "path", "left").select("path", "spans", F.coalesce("files", F.array().cast("array<struct<stretch:bigint,file:string,error:string>>")).alias("files"))
        A.spread(whole, "path").mapInArrow(run, REPORT).write.parquet(f"{folder}/reports")
    finally:
        for part in ("hunks", "decoded"):
            shutil.rmtree(f"{folder}/{part}", ignore_errors=True)
    return spark.read.schema(REPORT).parquet(f"{folder}/reports")


def file_sha1(t: DataFrame) -> DataFrame:
    """(file, sha1) of whole files, pregaps included, a task for each."""

    def run(batches):
        for batch in batches:
            for path in batch.column("file").to_pylist():
                digest = hashlib.sha1()
                with A.opened(path) as f:
                    while part := f.read(1 << 22):
                        digest.update(part)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["file", "sha1"])

    return A.spread(t.select("file").distinct(), "file").mapInArrow(run, "file string, sha1 string")
