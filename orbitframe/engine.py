"""The commands: convert, describe, verify. Each takes one path or a collection and returns DataFrames or rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import scalars as S
from .operators import chunks as C
from .operators import images as I
from .operators import layout as L
from .sources import archive as A
from .sources import sheets as H

FORMATS = ("cue", "gdi", "chd")


def detect(path: str) -> tuple[str, str]:
    """(path, format) of a file by its extension, or of the one image of a folder: CUE first, then GDI, then CHD."""
    path = H.local(path)
    if os.path.isfile(path):
        ext = os.path.splitext(path)[1][1:].lower()
        if ext not in FORMATS:
            raise ValueError(f"{path}: not one of {', '.join(FORMATS)}")
        if not os.path.getsize(path):
            raise ValueError(f"{path}: the file is empty")
        return path, ext
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    names = sorted(os.path.join(d, n) for d, _, files in os.walk(path) for n in files)
    for ext in FORMATS:
        found = [n for n in names if n.lower().endswith(f".{ext}")]
        if len(found) > 1:
            raise ValueError(f"{path}: {len(found)} {ext} files, name one")
        if found:
            return detect(found[0])
    raise FileNotFoundError(f"{path}: no image there")


def images(spark: SparkSession, root: str, fmt: str) -> DataFrame:
    """The images of a format at or below a path: sheets with their content, archives with their size."""
    return A.listed(spark, root, fmt) if fmt == "chd" else H.read_sheets(spark, root, fmt)


def layout(spark: SparkSession, root: str, fmt: str) -> DataFrame:
    """(disc, pos, number, type, start_lba, frames, pregap, file, gdrom) of all tracks."""
    found = images(spark, root, fmt)
    if fmt == "chd":
        t = A.tracks(found).withColumn("file", F.lit("")).withColumn("gdrom", F.first("gdrom").over(L.order()))
    else:
        t = H.cue_layout(found) if fmt == "cue" else H.gdi_layout(found)
    return t.select("disc", "pos", "number", "type", "start_lba", "frames", "pregap", "file", "gdrom")


def describe(spark: SparkSession, root: str, fmt: str) -> tuple[DataFrame, DataFrame]:
    """(discs, tracks): a row for each disc with its boot header, empty where there is none to read."""
    t = L.with_bytes(layout(spark, root, fmt))
    discs = t.groupBy("disc").agg(F.max("gdrom").alias("gdrom"), F.count("*").cast("int").alias("tracks"), F.sum("bytes").alias("bytes"))
    if fmt == "chd":
        found = images(spark, root, fmt)
        first = A.hunks(found, 0, 1).select(F.col("path").alias("disc"), F.substring("data", 1, S.SECTOR).alias("sector"))
        heads = A.headers(found).join(found, "path").select(F.col("path").alias("disc"), F.array_join("codecs", ", ").alias("codec"), "hunks", F.col("size").alias("stored"))
        discs = discs.join(heads, "disc", "left")
    else:
        first = H.first_bytes(t)
        discs = discs.withColumns({"codec": F.lit(None).cast("string"), "hunks": F.lit(None).cast("long"), "stored": F.lit(None).cast("long")})
    discs = discs.join(first, "disc", "left").withColumn("sector", F.coalesce("sector", F.lit(b"")))
    return discs.select("disc", F.lit(fmt).alias("format"), "gdrom", "tracks", "bytes", "codec", "hunks", "stored", *H.boot_header(F.col("sector"))), t


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def named_file(t: DataFrame) -> Column:
    """A track's file as its sheet names it."""
    folder = F.regexp_replace("disc", "[^/]*$", "")
    return F.when(F.col("file").startswith(folder), F.expr("substr(file, length(regexp_replace(disc, '[^/]*$', '')) + 1)")).otherwise(F.col("file"))


#: Keys of a report, each with its column of ``describe``; empty ones but the first four are left out.
INFO_KEYS = (
    ("name", "title"), ("format", "format"), ("gdrom", "gdrom"), ("hardware_id", "hardware_id"), ("maker_id", "maker_id"), ("maker", "maker"),
    ("product_number", "product_no"), ("version", "version"), ("release_date", "release_date"), ("disc", "disc_no"), ("regions", "regions"),
    ("peripherals", "peripherals"), ("boot_filename", "boot_file"), ("codec", "codec"), ("hunks", "hunks"), ("stored_bytes", "stored"), ("bytes", "bytes"),
)
KEPT_KEYS = ("format", "gdrom", "bytes")


def filled(name: str, kind: str) -> Column:
    """A value, or null where it is empty, zero or has no elements."""
    c = F.col(name)
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit("") if kind == "string" else F.lit(0))


def as_json(discs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(disc, json): one object for each disc; empty fields are left out."""
    kinds = dict(discs.dtypes)
    track = F.struct("pos", "number", "type", F.col("start_lba").alias("lba"), "frames", "bytes", F.nullif(named_file(tracks), F.lit("")).alias("file"))
    plain = F.transform(F.array_sort(F.collect_list(track)), lambda x: x.dropFields("pos"))
    nested = tracks.groupBy("disc").agg(plain.alias("layout"))
    fields = [(F.col(c) if key in KEPT_KEYS else filled(c, kinds[c])).alias(key) for key, c in INFO_KEYS]
    return discs.join(nested, "disc").select("disc", F.to_json(F.struct(base_name(F.col("disc")).alias("file"), *fields, F.col("layout").alias("tracks"))).alias("json"))


def verify_json(reports: DataFrame, version: str | None = None) -> DataFrame:
    """(disc, error, json) of the rows of ``verify``; ``version`` is the catalogue's, None where there was none."""
    kinds = dict(reports.dtypes)
    own = ("hunks", "logical_bytes", "raw_sha1", "combined_sha1")
    fields = [filled(k, kinds[k]).alias(k) if k in kinds else F.lit(None).cast("string").alias(k) for k in own]
    fields.insert(1, F.col("tracks"))
    if version is not None:
        match = F.struct(F.nullif(F.lit(version), F.lit("")).alias("dat_version"), "titles", F.col("known").alias("tracks_known"))
        fields.append(match.alias("redump"))
    error = F.col("error") if "error" in kinds else F.lit(None).cast("string").alias("error")
    return reports.select("disc", error, F.to_json(F.struct(base_name(F.col("disc")).alias("file"), *fields)).alias("json"))


def verify(spark: SparkSession, root: str, fmt: str, catalogue: DataFrame | None = None, work: str | None = None) -> DataFrame:
    """A row for each disc: archives with their digests, sheets only against a catalogue.

    With a catalogue, ``titles`` are the games whose files are exactly the disc's tracks, and
    ``known`` counts the tracks that it holds. Archives are decoded by many tasks each where there
    is a work folder that all executors share (``work``, or the session's checkpoint folder).
    """
    if fmt == "gdi" or fmt == "cue" and catalogue is None:
        raise ValueError(f"{fmt} images hold no digests" + (" of whole tracks" if fmt == "gdi" else "; name a catalogue"))
    if fmt == "chd":
        shared = work or spark.conf.get("spark.checkpoint.dir", None) or ""
        mounted = shared if shared.startswith("file:") or "://" not in shared else ""
        out = I.verify(images(spark, root, fmt), mounted or None).withColumnRenamed("path", "disc")
        sums = out.select("disc", F.explode("track_sha1").alias("sha1"))
    else:
        t = layout(spark, root, fmt)
        sums = t.join(I.file_sha1(t), "file").select("disc", "pos", "sha1")
        out = sums.groupBy("disc").agg(F.count("*").cast("int").alias("tracks"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha1"))), lambda x: x["sha1"]).alias("track_sha1"))
        sums = sums.select("disc", "sha1")
    if catalogue is None:
        return out
    hit = C.match_sets(sums, catalogue, "disc", "title", "sha1").groupBy("disc").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    known = C.known(sums, catalogue, "sha1").groupBy("disc").agg(F.count_if("known").alias("known"))
    return out.join(known, "disc", "left").join(hit, "disc", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>"))).withColumn("known", F.coalesce("known", F.lit(0)))


def convert(spark: SparkSession, source: str, target: str, to: str | None = None, codec: str = "cdzl,cdfl", force: bool = False, work: str | None = None) -> dict:
    """Convert one disc; returns its path, tracks and bytes.

    Sheets are written as a folder with disc.cue or disc.gdi and a file for each track, which
    takes the target's place only when all is there.
    """
    path, fmt = detect(source)
    ext = os.path.splitext(target)[1][1:].lower()
    to = (to or (ext if ext in FORMATS else "gdi")).lower()
    if to not in FORMATS or to == fmt:
        raise ValueError(f"cannot convert {fmt} to {to}")
    if codec not in I.CODECS:
        raise ValueError(f"codec {codec!r} is none of {', '.join(I.CODECS)}")
    if to == "chd":
        target = H.local(target)
        shared = work or spark.conf.get("spark.checkpoint.dir", None) or os.path.dirname(target)
        found = images(spark, path, fmt)
        t = H.cue_layout(found) if fmt == "cue" else H.gdi_layout(found)
        row = I.write_archives(spark, I.write_plan(t).withColumn("target", F.lit(target)), codec, force, shared)[0]
        return {"path": target, "tracks": row["tracks"], "bytes": row["bytes"]}
    with I.Staged(target, force) as staged:
        if fmt == "chd":
            found = images(spark, path, fmt)
            t = I.archive_spans(found)
            place = F.struct(S.track_file_name(F.col("number"), F.col("type")).alias("name"), "span_start", "span_end", S.is_audio(F.col("type")).alias("audio"))
            I.extract(A.hunks(found), t.groupBy("disc").agg(F.collect_list(place).alias("spans")).withColumn("folder", F.lit(staged.work)))
            total = F.sum("frames") * S.SECTOR
        else:
            t = H.cue_layout(images(spark, path, fmt)) if fmt == "cue" else H.gdi_layout(images(spark, path, fmt))
            t = H.sized(t).withColumn("folder", F.lit(staged.work)).withColumn("name", S.track_file_name(F.col("number"), F.col("type"))).withColumn("mark_lba", F.col("start_lba"))
            I.copy_tracks(t)
            total = F.sum(F.col("size") - F.col("pregap") * S.SECTOR)
            if to == "cue":  # a sheet of starts says where the dense area begins, whatever lies between
                t = t.withColumn("mark_lba", F.when(F.col("pos") == F.coalesce("bridge", F.lit(0)) + 1, F.lit(S.HDA)).otherwise(F.lit(0)))
        text = (H.cue_text if to == "cue" else H.gdi_text)(t).first()["text"]
        done = t.agg(F.count("*").alias("n"), total.alias("bytes")).first()
        with open(os.path.join(staged.work, f"disc.{to}"), "w") as f:
            f.write(text)
    return {"path": os.path.join(staged.target, f"disc.{to}"), "tracks": done["n"], "bytes": done["bytes"]}


def write_name(spark: SparkSession, sheet: str) -> str:
    """The title of a GDI's track 1 as name.txt beside it; returns the title."""
    discs, _ = describe(spark, sheet, "gdi")
    title = discs.first()["title"]
    if not title:
        raise ValueError(f"{sheet}: no title")
    with open(os.path.join(os.path.dirname(H.local(sheet)), "name.txt"), "w") as f:
        f.write(title)
    return title
