"""Sheets of discs: CUE and GDI text, read and written, and the boot header of a disc.

Sheets are a few kilobytes, so they come as (path, content) rows; their lines are exploded and
the file and track that a line belongs to are running counts over one sheet's lines.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators import layout as L
from .archive import opened, read_at, spread

HEAD_AT, HEAD_BYTES = 16, 256
#: Sectors that a task reads of a file at a time.
STRETCH = 1 << 14
# First byte and end of each text field of the boot header.
HEAD_FIELDS = {"hardware_id": (0x00, 0x10), "maker_id": (0x10, 0x20), "device": (0x20, 0x30), "area": (0x30, 0x38), "peripherals": (0x38, 0x40), "product_no": (0x40, 0x4A), "version": (0x4A, 0x50), "date": (0x50, 0x60), "boot_file": (0x60, 0x70), "maker": (0x70, 0x80), "title": (0x80, 0x100)}
HEADER = ("hardware_id", "maker_id", "title", "maker", "product_no", "version", "release_date", "disc_no", "regions", "peripherals", "boot_file")


def read_sheets(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """(path, content) of the sheets with that extension, in any case, at or below a path; files of no bytes aren't listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", any_case(ext)).load(root)
    return files.filter("length > 0").select("path", "content")


def any_case(ext: str) -> str:
    """A glob of an extension in any case: files beside it are listed but never opened."""
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ext)


def lines(sheets: DataFrame) -> DataFrame:
    text = F.split(F.col("content").cast("string"), "\r\n|\n")
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    return sheets.select(F.col("path").alias("disc"), F.posexplode(text).alias("at", "line")).select("disc", "at", trimmed.alias("line"))


def checked(t: DataFrame, is_track: Column, keep: Column, what: str) -> DataFrame:
    """Lines that ``keep`` keeps; a sheet without tracks is an error, not an absent disc.

    Both are one condition, so that no line is dropped before its sheet is judged.
    """
    n = F.sum(F.when(is_track, 1).otherwise(0)).over(Window.partitionBy("disc"))
    bad = F.raise_error(F.concat("disc", F.lit(f": no tracks, not a {what} sheet"))).cast("boolean")
    return t.withColumn("n_tracks", n).filter(F.when(F.col("n_tracks") == 0, bad).otherwise(keep)).drop("n_tracks")


def fail(why: str, what: Column) -> Column:
    return F.raise_error(F.concat(F.col("disc"), F.lit(f": {why} "), what))


def cue_lines(sheets: DataFrame) -> DataFrame:
    """Each line with what it is, its file and its track (0: none yet)."""
    order = Window.partitionBy("disc").orderBy("at")
    upper, words = F.upper("line"), F.split("line", r"\s+")
    kind = F.when(upper.startswith("FILE "), "file").when(upper.startswith("TRACK "), "track").when(upper.startswith("INDEX "), "index").when(upper.startswith("REM "), "rem")
    short = F.col("kind").isin("track", "index") & (F.size("words") < 3)
    t = lines(sheets).withColumn("kind", kind).withColumn("words", words).withColumn("kind", F.when(~short, F.col("kind")))
    t = t.withColumn("file", F.sum(F.when(F.col("kind") == "file", 1).otherwise(0)).over(order))
    t = checked(t, (F.col("kind") == "track") & (F.col("file") > 0), F.expr("kind is not null and file > 0"), "CUE")
    in_file = Window.partitionBy("disc", "file").orderBy("at")
    return t.withColumn("track", F.sum(F.when(F.col("kind") == "track", 1).otherwise(0)).over(in_file))


def cue_tracks(sheets: DataFrame) -> DataFrame:
    """(disc, file_pos, track_pos, name, rem, number, type, indexes) of all tracks; indexes in frames, in order."""
    t = cue_lines(sheets)
    files = t.groupBy("disc", "file").agg(F.max(F.when(F.col("kind") == "file", S.quoted(F.col("line")))).alias("name"), F.max_by(F.when(F.col("kind") == "rem", F.expr("substr(line, 5)")), F.when(F.col("kind") == "rem", F.col("at"))).alias("rem"))
    number = F.coalesce(F.col("words")[1].try_cast("int"), F.when(F.col("kind") == "track", fail("bad track number", F.col("line")).cast("int")))
    index = F.coalesce(S.parse_msf(F.col("words")[2]), fail("bad timecode", F.col("line")).cast("long"))
    index = F.when(F.col("words")[1].try_cast("int").isNull(), fail("bad index number", F.col("line")).cast("long")).otherwise(index)
    tracks = t.filter("track > 0 and kind in ('track', 'index')").groupBy("disc", "file", "track").agg(
        F.max(F.when(F.col("kind") == "track", number)).alias("number"), F.max(F.when(F.col("kind") == "track", F.col("words")[2])).alias("type"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "index", F.struct("at", index.alias("frames"))))), lambda x: x["frames"]).alias("indexes"),
    )
    return files.join(tracks, ["disc", "file"]).select("disc", F.col("file").alias("file_pos"), F.col("track").alias("track_pos"), "name", F.coalesce("rem", F.lit("")).alias("rem"), "number", "type", "indexes")


def beside(disc: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(disc, "[^/]*$", ""), name)


def sized(t: DataFrame) -> DataFrame:
    """With ``size``, the bytes of ``file``; only the store's metadata are read."""

    def run(batches):
        for batch in batches:
            sizes = []
            for path in batch.column("file").to_pylist():
                with opened(path) as f:
                    sizes.append(f.size())
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "size"])

    return t.join(t.select("file").distinct().mapInArrow(run, "file string, size bigint"), "file")


LAYOUT = ("disc", "pos", "number", "type", "start_lba", "frames", "pregap", "file", "gdrom", "bridge")


def cue_layout(sheets: DataFrame) -> DataFrame:
    """The layout rows of CUE sheets: the first track of each file, marks of the dense area from REM."""
    first = cue_tracks(sheets).filter("track_pos = 1")
    t = first.select(
        "disc", F.row_number().over(Window.partitionBy("disc").orderBy("file_pos")).cast("long").alias("pos"), "number", "type", beside(F.col("disc"), F.col("name")).alias("file"),
        F.coalesce(F.get("indexes", F.lit(1)), F.lit(0)).cast("long").alias("pregap"), F.contains(F.upper("rem"), F.lit("HIGH-DENSITY")).alias("hda"),
    )
    t = sized(t).withColumn("frames", S.idiv(F.col("size"), S.SECTOR) - F.col("pregap"))
    return L.cue_layout(t).select(*LAYOUT)


def gdi_tracks(sheets: DataFrame) -> DataFrame:
    """(disc, pos, number, lba, type, file) of GDI sheets; the first line is not trusted, bad lines are skipped."""
    words = S.split_fields(F.col("line"))
    n = lambda i: F.get("w", F.lit(i)).try_cast("long")
    good = (F.col("at") > 0) & (F.size("w") >= 6) & n(0).isNotNull() & n(1).isNotNull() & n(2).isNotNull() & n(3).isNotNull()
    t = checked(lines(sheets).withColumn("w", words), good, good, "GDI")
    at = F.row_number().over(Window.partitionBy("disc").orderBy("at")).cast("long")
    return t.select("disc", at.alias("pos"), n(0).cast("int").alias("number"), n(1).alias("lba"), S.gdi_cue_type(n(2)).alias("type"), F.col("w")[4].alias("name"))


def gdi_layout(sheets: DataFrame) -> DataFrame:
    """The layout rows of GDI sheets: starts as listed; the bridge is before the first dense track that has one before it."""
    t = gdi_tracks(sheets).withColumn("file", beside(F.col("disc"), F.col("name")))
    dense = F.col("lba") >= S.HDA
    t = sized(t).withColumn("bridge", F.min(F.when(dense & (F.col("pos") > 1), F.col("pos"))).over(L.whole()) - 1).withColumn("gdrom", F.max(dense).over(L.whole()))
    return t.withColumn("frames", S.idiv(F.col("size"), S.SECTOR)).withColumn("start_lba", F.col("lba")).withColumn("pregap", F.lit(0).cast("long")).select(*LAYOUT)


def track_sectors(t: DataFrame) -> DataFrame:
    """(disc, pos, sector, data) of all sectors of layout rows' files, pregaps included; a part sector at the end is left out.

    Files are read in stretches, so that one disc keeps many tasks busy.
    """
    size = STRETCH
    first = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))
    todo = sized(t).withColumn("n", S.idiv(F.col("size"), S.SECTOR)).filter("n > 0").select("disc", "pos", "file", "n", F.explode(first).alias("first"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file"]) as f:
                    for at in range(row["first"], min(row["first"] + size, row["n"]), 256):
                        n = min(256, row["first"] + size - at, row["n"] - at)
                        data = read_at(f, at * S.SECTOR, n * S.SECTOR, row["file"])
                        parts = [data[i * S.SECTOR : (i + 1) * S.SECTOR] for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array([row["disc"]] * n), pa.array([row["pos"]] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(parts, pa.binary())], names=["disc", "pos", "sector", "data"])

    return spread(todo, "file", "first").mapInArrow(run, "disc string, pos bigint, sector bigint, data binary")


# Writing


def cue_text(t: DataFrame) -> DataFrame:
    """(disc, text): a CUE sheet; the dense area is marked before the track that starts there."""
    name = S.track_file_name(F.col("number"), F.col("type"))
    mark = F.when(F.col("gdrom") & (F.col("mark_lba") == S.HDA), F.lit("REM HIGH-DENSITY AREA\n")).otherwise("")
    index = F.when(F.col("pregap") > 0, F.concat(F.lit("    INDEX 00 00:00:00\n    INDEX 01 "), S.frames_as_msf(F.col("pregap")))).otherwise("    INDEX 01 00:00:00")
    stanza = F.concat(mark, F.lit('FILE "'), name, F.lit('" BINARY\n  TRACK '), F.format_string("%02d", "number"), F.lit(" "), F.col("type"), F.lit("\n"), index)
    return texts(t, stanza)


def gdi_text(t: DataFrame) -> DataFrame:
    """(disc, text): a GDI sheet; each line ends with the offset 0 and a blank."""
    name = S.track_file_name(F.col("number"), F.col("type"))
    line = F.format_string("%d %d %d 2352 %s 0 ", "number", "mark_lba", F.when(S.is_audio(F.col("type")), 0).otherwise(4), name)
    return texts(t, line, count=True)


def texts(t: DataFrame, part: Column, count: bool = False) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"])
    head = F.concat(F.count("*").cast("string"), F.lit("\n")) if count else F.lit("")
    return t.groupBy("disc").agg(F.concat(head, F.array_join(rows, "\n"), F.lit("\n")).alias("text"))


# The boot header


def boot_header(sector: Column) -> list[Column]:
    """Columns of HEADER from the bytes of a disc's first sector; a short sector gives empty fields."""
    raw = lambda k: F.substring(sector, HEAD_AT + HEAD_FIELDS[k][0] + 1, HEAD_FIELDS[k][1] - HEAD_FIELDS[k][0]).cast("string")
    text = lambda k: F.regexp_replace(F.regexp_replace(raw(k), r"\x00+$", ""), r"^\s+|\s+$", "")
    found = {k: text(k) for k in HEAD_FIELDS} | {"release_date": S.release_date(text("date")), "disc_no": S.disc_number(text("device")), "regions": S.regions(raw("area")), "peripherals": S.peripherals(text("peripherals"))}
    return [found[k].alias(k) for k in HEADER]


def first_bytes(t: DataFrame) -> DataFrame:
    """(disc, sector): the sector past the pregap of track 1 of sheets; null where it can't be read."""
    one = t.filter("number = 1").withColumn("k", F.row_number().over(Window.partitionBy("disc").orderBy("pos"))).filter("k = 1").select("disc", "file", "pregap")

    def run(batches):
        for batch in batches:
            out = []
            for path, pregap in zip(batch.column("file").to_pylist(), batch.column("pregap").to_pylist()):
                try:
                    with opened(path) as f:
                        f.seek(pregap * S.SECTOR)
                        out.append(bytes(f.read(S.SECTOR)))
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("disc"), pa.array(out, pa.binary())], names=["disc", "sector"])

    return one.mapInArrow(run, "disc string, sector binary")


def local(path: str) -> str:
    """A path that open() takes; other stores have to be mounted to be written to."""
    plain = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
    if "://" in plain:
        raise ValueError(f"{path}: only mounted folders can be written to")
    return os.path.abspath(plain)
