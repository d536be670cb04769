"""Queries over archives and sheets that are written from the tables and read back, against plain SQL.

A disc is a supplier. It has one to three tracks of a few sectors; all sectors of a track are alike, so
that SQL can say every byte: the data track's hold a boot header, the others' a number over and over.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import engine
from ..functions import blocks as B
from ..functions import scalars as S
from ..operators import images as I
from ..sources import archive as A
from ..sources import catalogue as K
from ..sources import sheets as H
from .suite import LAID, query, read, laid

#: The discs in SQL: each track's sector as text (archived: as it lies in an archive), and its place there.
DISCS = """t AS (SELECT s_suppkey AS disc, pos, 4 + s_suppkey * pos % 9 AS frames, CASE WHEN pos = 1 THEN 'MODE1/2352' ELSE 'AUDIO' END AS type,
    CASE WHEN pos = 1 THEN repeat('.', 16) || rpad('HARDWARE', 16, ' ') || rpad('MAKER ID', 16, ' ') || rpad('A1B2 GD-ROM1/2', 16, ' ') || rpad('JUE', 8, ' ') || rpad('E000F10', 8, ' ')
      || rpad('T-' || s_suppkey, 10, ' ') || 'V1.000' || rpad('20000131', 16, ' ') || rpad('1ST.BIN', 16, ' ') || rpad('A MAKER', 16, ' ') || rpad(s_name, 128, ' ') || repeat('x', 2080)
      ELSE repeat(lpad(CAST(s_suppkey * 10 + pos AS VARCHAR), 16, '0'), 147) END AS sector
    FROM supplier, (VALUES (1), (2), (3)) p(pos) WHERE pos <= 1 + s_suppkey % 3),
  u AS (SELECT *, (frames + 3) // 4 * 4 AS total, CASE WHEN pos = 1 THEN sector ELSE regexp_replace(sector, '(.)(.)', '\\2\\1', 'g') END AS archived,
    'TRACK:' || pos || ' TYPE:' || CASE WHEN pos = 1 THEN 'MODE1_RAW' ELSE 'AUDIO' END || ' SUBTYPE:NONE FRAMES:' || frames || ' PREGAP:0 PGTYPE:' || CASE WHEN pos = 1 THEN 'MODE1' ELSE 'AUDIO' END || ' PGSUB:NONE POSTGAP:0' AS meta FROM t),
  v AS (SELECT *, CAST(coalesce(sum(total) OVER (PARTITION BY disc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_lba FROM u)"""
#: A row for each disc: its archive's size, and both digests.
SUMS = DISCS + """, w AS (SELECT disc, CAST(count(*) AS INTEGER) AS tracks, CAST((sum(total) + 7) // 8 AS BIGINT) AS hunks, CAST(sum(frames) * 2352 AS BIGINT) AS bytes,
    string_agg(repeat(hex(encode(archived)) || repeat('00', 96), CAST(frames AS BIGINT)) || repeat('00', CAST(2448 * (total - frames) AS BIGINT)), '' ORDER BY pos) || repeat('00', CAST(2448 * ((sum(total) + 7) // 8 * 8 - sum(total)) AS BIGINT)) AS body,
    string_agg(hex(encode('CHT2')) || upper(sha1(meta || chr(0))), '' ORDER BY upper(sha1(meta || chr(0)))) AS metas FROM u GROUP BY disc),
  sums AS (SELECT disc, tracks, hunks, bytes, sha1(unhex(body)) AS raw_sha1, sha1(unhex(sha1(unhex(body)) || metas)) AS combined_sha1 FROM w)"""
NAME = "printf('track%02d.', pos) || CASE WHEN type = 'AUDIO' THEN 'raw' ELSE 'bin' END"

_made: dict[tuple[str, str], str] = {}


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("disc"), "s_name").withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("disc") % 3)))
    pad = lambda text, n: F.rpad(text if not isinstance(text, str) else F.lit(text), n, " ")
    head = F.concat(F.repeat(F.lit("."), 16), pad("HARDWARE", 16), pad("MAKER ID", 16), pad("A1B2 GD-ROM1/2", 16), pad("JUE", 8), pad("E000F10", 8), pad(F.concat(F.lit("T-"), F.col("disc").cast("string")), 10), F.lit("V1.000"), pad("20000131", 16), pad("1ST.BIN", 16), pad("A MAKER", 16), pad(F.col("s_name"), 128), F.repeat(F.lit("x"), 2080))
    audio = F.repeat(F.lpad((F.col("disc") * 10 + F.col("pos")).cast("string"), 16, "0"), 147)
    kind = F.when(F.col("pos") == 1, "MODE1/2352").otherwise("AUDIO")
    return s.select("disc", "pos", (4 + F.col("disc") * F.col("pos") % 9).alias("frames"), kind.alias("type"), F.when(F.col("pos") == 1, head).otherwise(audio).alias("sector"))


def sheets(spark: SparkSession, sf: str, folder: str) -> None:
    """Write each disc's track files and its sheet below ``folder``: one folder a disc."""
    t = tracks(spark, sf).withColumn("number", F.col("pos").cast("int")).withColumn("name", S.track_file_name(F.col("pos"), F.col("type")))
    text = H.cue_text(t.withColumns({"gdrom": F.lit(False), "mark_lba": F.lit(0), "pregap": F.lit(0)}))
    discs = t.groupBy("disc").agg(F.collect_list(F.struct("name", "sector", "frames")).alias("files")).join(text, "disc")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = os.path.join(folder, str(row["disc"]))
                for f in row["files"]:
                    I.put(own, f["name"], 0, f["sector"].encode() * f["frames"])
                I.put(own, "disc.cue", 0, row["text"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    A.spread(discs, "disc").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


def plans(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """(disc, tracks, target) of the sheets below a folder."""
    planned = I.write_plan(H.cue_layout(H.read_sheets(spark, folder, "cue")))
    return planned.withColumn("target", F.concat(F.lit(out + "/"), F.regexp_extract("disc", r"/(\d+)/disc\.cue$", 1), F.lit(".chd")))


def collection(spark: SparkSession, sf: str) -> str:
    """A folder with ``sheets`` and ``archives`` of all discs, made once a session."""
    key = spark.sparkContext.applicationId, sf
    if key not in _made:
        folder = I.work_folder(spark, I.shared_folder(spark))
        sheets(spark, sf, f"{folder}/sheets")
        I.write_archives(spark, plans(spark, f"{folder}/sheets", f"{folder}/archives"), work=folder)
        _made[key] = folder
    return _made[key]


def archives(spark: SparkSession, sf: str) -> DataFrame:
    return A.listed(spark, collection(spark, sf) + "/archives")


def numbered(t: DataFrame, path: str = "path") -> DataFrame:
    """The supplier that a path names, as ``disc``."""
    return t.withColumn("disc", F.regexp_extract(path, r"/(\d+)(\.chd|/[^/]*)$", 1).cast("long"))


@query(f"WITH {SUMS} SELECT disc, tracks, bytes, raw_sha1 FROM sums")
def archive_write(spark, sf):
    """K1, K1a, K1b, K1d, K8, C1, L11a, P5: all discs written as archives, into a folder of its own."""
    out = I.work_folder(spark, I.shared_folder(spark))
    rows = I.write_archives(spark, plans(spark, collection(spark, sf) + "/sheets", out + "/archives"), work=out)
    t = spark.createDataFrame([tuple(r[k] for k in ("target", "tracks", "bytes", "raw_sha1")) for r in rows], I.WRITTEN)
    return numbered(t, "target").select("disc", "tracks", "bytes", "raw_sha1")


@query(f"WITH {SUMS} SELECT disc, 5 AS version, 'cdzl, cdfl' AS codecs, hunks, hunks * 19584 AS logical_bytes, 19584 AS hunk_bytes, raw_sha1, combined_sha1 FROM sums")
def archive_headers(spark, sf):
    """S3, S15, C26, A2."""
    return numbered(A.headers(archives(spark, sf))).select("disc", "version", F.array_join("codecs", ", ").alias("codecs"), "hunks", "logical_bytes", "hunk_bytes", "raw_sha1", "combined_sha1")


@query(f"WITH {DISCS} SELECT disc, CAST(pos - 1 AS INTEGER) AS ord, 'CHT2' AS tag, 1 AS flags, meta AS payload FROM u")
def archive_metadata(spark, sf):
    """S4, K1c, K1d, L12."""
    return numbered(A.metadata(archives(spark, sf))).select("disc", "ord", "tag", "flags", F.regexp_replace(F.col("payload").cast("string"), r"\x00$", "").alias("payload"))


@query(f"WITH {DISCS} SELECT disc, CAST(pos AS BIGINT) AS number, type, total, frames, start_lba, false AS gdrom FROM v")
def archive_tracks(spark, sf):
    """S5, S16, L3, F10."""
    return numbered(A.tracks(archives(spark, sf)).withColumnRenamed("disc", "path")).select("disc", "number", "type", "total", "frames", "start_lba", "gdrom")


SLOTS = DISCS + """, s AS (SELECT disc, start_lba + k AS lba, CASE WHEN k < frames THEN archived END AS sector, CASE WHEN k < frames THEN CAST(pos AS VARCHAR) ELSE '-' END AS mark FROM (SELECT *, unnest(range(total)) AS k FROM v)),
  h AS (SELECT disc, lba // 8 AS hunk, rpad(string_agg(mark, '' ORDER BY lba), 8, '-') AS marks FROM s GROUP BY 1, 2)"""


@query(f"WITH {SLOTS}, f AS (SELECT disc, hunk, min(hunk) OVER (PARTITION BY disc, marks) AS first FROM h) SELECT disc, hunk, CASE WHEN first < hunk THEN first END AS self_hunk, first AS source FROM f")
def archive_map(spark, sf):
    """S6, S6a, S6d, S6e, C2, C20 to C25: which hunks refer to which, from the map's bits."""
    return numbered(A.hunk_map(archives(spark, sf))).select("disc", "hunk", "self_hunk", "source")


@query(f"WITH {SLOTS}, g AS (SELECT disc, max(lba) // 8 * 8 + 8 AS slots FROM s GROUP BY 1), e AS (SELECT disc, unnest(range(slots)) AS lba FROM g) SELECT disc, lba, CASE WHEN sector IS NULL THEN sha1(unhex(repeat('00', 2352))) ELSE sha1(sector) END AS sha1 FROM e LEFT JOIN s USING (disc, lba)")
def archive_sectors(spark, sf):
    """Every sector of every hunk, decoded."""
    return numbered(A.sectors(archives(spark, sf))).select("disc", "lba", F.sha1("sector").alias("sha1"))


@query(f"WITH {DISCS} SELECT disc, sha1(sector) AS sha1 FROM v WHERE pos = 1")
def archive_first_sector(spark, sf):
    """Hunk 0 is planned alone."""
    return numbered(A.hunks(archives(spark, sf), 0, 1)).select("disc", F.sha1(F.substring("data", 1, S.SECTOR)).alias("sha1"))


@query(f"WITH {DISCS} SELECT disc, {NAME} AS name, sha1(repeat(sector, CAST(frames AS BIGINT))) AS sha1 FROM t")
def archive_extract(spark, sf):
    """Tracks written as files again, and the files' digests."""
    out = I.work_folder(spark, I.shared_folder(spark))
    paths = archives(spark, sf)
    place = F.struct(S.track_file_name(F.col("number"), F.col("type")).alias("name"), "span_start", "span_end", S.is_audio(F.col("type")).alias("audio"))
    spans = numbered(I.archive_spans(paths).withColumnRenamed("disc", "path")).withColumn("folder", F.concat(F.lit(out + "/"), F.col("disc").cast("string")))
    places = spans.groupBy(F.col("path").alias("disc"), "folder").agg(F.collect_list(place).alias("spans"))
    I.extract(A.hunks(paths), places)
    files = spans.select("disc", F.concat_ws("/", "folder", S.track_file_name(F.col("number"), F.col("type"))).alias("file"))
    return files.join(I.file_sha1(files), "file").select("disc", engine.base_name(F.col("file")).alias("name"), "sha1")


@query(f"WITH {SUMS}, d AS (SELECT disc, string_agg(sha1(repeat(sector, CAST(frames AS BIGINT))), ',' ORDER BY pos) AS track_sha1 FROM t GROUP BY 1) SELECT disc, hunks, tracks, hunks * 19584 AS logical_bytes, raw_sha1, combined_sha1, track_sha1, '' AS error FROM sums JOIN d USING (disc)")
def archive_verify(spark, sf):
    """Every hunk decoded in stretches, digests folded."""
    found = engine.verify(spark, collection(spark, sf) + "/archives", "chd", work=I.shared_folder(spark))
    return numbered(found.withColumnRenamed("disc", "path")).select("disc", "hunks", "tracks", "logical_bytes", "raw_sha1", "combined_sha1", F.array_join("track_sha1", ",").alias("track_sha1"), F.coalesce("error", F.lit("")).alias("error"))


@query(f"WITH {SUMS}, n AS (SELECT disc, string_agg(pos || ' ' || type || ' ' || start_lba || ' ' || frames || ' ' || frames * 2352, ',' ORDER BY pos) AS tracks FROM v GROUP BY 1) SELECT disc, disc || '.chd' AS file, s_name AS name, 'chd' AS format, false AS gdrom, 'HARDWARE' AS hardware_id, 'MAKER ID' AS maker_id, 'A MAKER' AS maker, 'T-' || disc AS product_number, 'V1.000' AS version, '2000-01-31' AS release_date, '1/2' AS number, 'Japan,USA,Europe' AS regions, 'VMU,jump pack,microphone,other expansions,mouse,keyboard,light gun,VGA box' AS peripherals, '1ST.BIN' AS boot_filename, 'cdzl, cdfl' AS codec, hunks, bytes, true AS stored, n.tracks FROM sums JOIN n USING (disc) JOIN supplier ON s_suppkey = disc")
def archive_info(spark, sf):
    """The report of each archive, by its keys."""
    schema = "file string, name string, format string, gdrom boolean, hardware_id string, maker_id string, maker string, product_number string, version string, release_date string, disc string, regions array<string>, peripherals array<string>, boot_filename string, codec string, hunks bigint, stored_bytes bigint, bytes bigint, tracks array<struct<number: int, type: string, lba: bigint, frames: bigint, bytes: bigint>>"
    found = engine.as_json(*engine.describe(spark, collection(spark, sf) + "/archives", "chd"))
    j = numbered(found.withColumnRenamed("disc", "path")).withColumn("j", F.from_json("json", schema))
    line = F.transform("j.tracks", lambda t: F.concat_ws(" ", t["number"].cast("string"), t["type"], t["lba"].cast("string"), t["frames"].cast("string"), t["bytes"].cast("string")))
    plain = ("file", "name", "format", "gdrom", "hardware_id", "maker_id", "maker", "product_number", "version", "release_date", "boot_filename", "codec", "hunks", "bytes")
    return j.select("disc", *(f"j.{c}" for c in plain), F.col("j.disc").alias("number"), F.array_join("j.regions", ",").alias("regions"), F.array_join("j.peripherals", ",").alias("peripherals"), (F.col("j.stored_bytes") > 0).alias("stored"), F.array_join(line, ",").alias("tracks"))


@query(f"WITH {DISCS} SELECT disc, CAST(pos AS BIGINT) AS pos, CAST(pos AS INTEGER) AS number, type, CAST(coalesce(sum(frames) OVER (PARTITION BY disc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_lba, CAST(frames AS BIGINT) AS frames, {NAME} AS file FROM t")
def sheet_layout(spark, sf):
    """Layouts of all sheets below a folder; track files are only asked for their size."""
    t = engine.layout(spark, collection(spark, sf) + "/sheets", "cue").withColumnRenamed("disc", "path")
    return numbered(t).select("disc", "pos", "number", "type", "start_lba", "frames", engine.base_name(F.col("file")).alias("file"))


@query(f"WITH {DISCS} SELECT disc, CAST(pos AS BIGINT) AS pos, unnest(range(frames)) AS sector, sha1(sector) AS sha1 FROM t")
def track_sectors(spark, sf):
    """The sectors of all track files."""
    t = H.track_sectors(engine.layout(spark, collection(spark, sf) + "/sheets", "cue")).withColumnRenamed("disc", "path")
    return numbered(t).select("disc", "pos", "sector", F.sha1("data").alias("sha1"))


@query(f"WITH {DISCS}, d AS (SELECT disc, pos, sha1(repeat(sector, CAST(frames AS BIGINT))) AS sha1 FROM t) SELECT disc, CAST(count(*) AS INTEGER) AS tracks, CAST(count(*) FILTER (WHERE NOT (disc % 4 = 1 AND pos = 1)) AS BIGINT) AS known, CASE WHEN disc % 4 < 2 THEN '' ELSE 'Again ' || disc || ',Game ' || disc END AS titles FROM d GROUP BY disc")
def sheet_verify(spark, sf):
    """tracks' digests against a catalogue that lacks some files and has others twice."""
    t = tracks(spark, sf).withColumn("sha1", F.upper(F.sha1(F.expr("repeat(sector, cast(frames as int))")))).withColumn("name", S.track_file_name(F.col("pos"), F.col("type")))
    keep = ~((F.col("disc") % 4 == 1) & (F.col("pos") == 1))
    rom = F.concat(F.lit('<rom name="'), "name", F.lit('" sha1="'), "sha1", F.lit('"/>'))
    more = F.when(F.col("disc") % 4 == 0, F.lit('<rom name="extra.bin"/>')).otherwise(F.lit('<rom name="disc.CUE" sha1="00"/>'))
    games = t.filter(keep | (F.col("pos") > 1)).groupBy("disc").agg(F.array_join(F.collect_list(rom), "").alias("roms")).withColumn("title", F.explode(F.array(F.lit("Game "), F.lit("Again "))))
    out = I.work_folder(spark, I.shared_folder(spark))
    game = F.concat(F.lit('<game name="'), "title", F.col("disc").cast("string"), F.lit('">'), "roms", more, F.lit("</game>"))
    whole = games.agg(F.concat(F.lit("<datafile>"), F.array_join(F.collect_list(game), ""), F.lit("</datafile>")))  # one file, as catalogues are
    whole.write.text(f"file://{out}/catalogue")
    found = engine.verify(spark, collection(spark, sf) + "/sheets", "cue", K.read_catalogue(spark, f"file://{out}/catalogue"))
    return numbered(found.withColumnRenamed("disc", "path")).select("disc", "tracks", "known", F.array_join("titles", ",").alias("titles"))


@query(f"WITH {DISCS} SELECT disc, {NAME} AS name, sha1(repeat(sector, CAST(frames AS BIGINT))) AS sha1, CAST(frames * 2352 AS BIGINT) AS size FROM t")
def track_copy(spark, sf):
    """K6: the track files of all sheets copied in pieces, under their names in a new set."""
    out = I.work_folder(spark, I.shared_folder(spark))
    t = H.sized(engine.layout(spark, collection(spark, sf) + "/sheets", "cue"))
    t = numbered(t.withColumnRenamed("disc", "path")).withColumn("folder", F.concat(F.lit(out + "/"), F.col("disc").cast("string"))).withColumn("name", S.track_file_name(F.col("number"), F.col("type")))
    I.copy_tracks(t)
    copies = H.sized(t.select("disc", "name", F.concat_ws("/", "folder", "name").alias("file")))
    return copies.join(I.file_sha1(copies), "file").select("disc", "name", "sha1", "size")


PLANNED = LAID + """, p AS (SELECT *, CASE WHEN gdrom THEN pregap ELSE 0 END AS own, max(CASE WHEN gdrom THEN 2 ELSE 0 END) OVER (PARTITION BY disc) AS bridge FROM laid),
  q AS (SELECT disc, pos, frames + pregap - CASE WHEN pos > 1 THEN own ELSE 0 END AS frames, CAST(lead(own, 1, 0) OVER (PARTITION BY disc ORDER BY pos) AS BIGINT) AS tail, bridge, type FROM p),
  r AS (SELECT *, 45000 - coalesce(sum((frames + tail + 3) // 4 * 4) OVER (PARTITION BY disc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS need FROM q),
  s AS (SELECT *, CASE WHEN pos = bridge AND need >= frames THEN need ELSE 0 END AS stored FROM r),
  z AS (SELECT *, CASE WHEN stored > 0 THEN stored ELSE (frames + tail + 3) // 4 * 4 END AS total FROM s)"""


@query(f"WITH {PLANNED} SELECT disc, pos, frames, tail AS \"trailing\", CAST(stored AS BIGINT) AS stored, CAST(total AS BIGINT) AS total, CAST(coalesce(sum(total) OVER (PARTITION BY disc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_lba FROM z")
def write_plan(spark, sf):
    """The tracks of an archive to be written, with moved pregaps and stored bridges."""
    t = laid(spark, sf).withColumn("number", F.col("pos")).withColumn("file", F.lit(""))
    planned = I.write_plan(t).select("disc", F.explode("tracks").alias("t"))
    return planned.select("disc", *(f"t.{c}" for c in ("pos", "frames", "trailing", "stored", "total", "start_lba")))


@query("WITH o AS (SELECT o_custkey AS disc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey % 3 AS kind, o_orderkey % 60 AS n FROM orders), r AS (SELECT disc, k, kind, 1 + CASE WHEN n < 3 THEN 0 ELSE n END AS n FROM o) SELECT disc, string_agg(repeat(CAST(kind AS VARCHAR), CAST(n AS BIGINT)), '' ORDER BY k) AS kinds FROM r GROUP BY disc")
def map_runs(spark, sf):
    """Kinds of hunks with short and long runs, written as bits of a canonical code and read back."""
    def run(batches):
        codes = A.canonical([4] * 16)  # all sixteen symbols, since runs spell their length in them
        back = {c: s for s, c in codes.items()}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                symbols, total = [], 0
                for x in row["rows"]:
                    symbols.append(x["kind"])
                    n = x["n"] if x["n"] >= 3 else 0
                    total += 1 + n
                    if 3 <= n < 19:
                        symbols += [A.RUN_SHORT, n - 3]
                    elif n >= 19:
                        symbols += [A.RUN_LONG, (n - 19) >> 4, (n - 19) & 15]
                text = "".join(f"{codes[s][0]:0{codes[s][1]}b}" for s in symbols)
                data = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
                out.append("".join(map(str, A.kinds(A.MapBits(data), back, total))))
            yield pa.RecordBatch.from_arrays([batch.column("disc"), pa.array(out, pa.string())], names=["disc", "kinds"])

    o = read(spark, sf, "orders").select(F.col("o_custkey").cast("long").alias("disc"), "o_orderkey")
    rows = o.groupBy("disc").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3).alias("kind"), (F.col("o_orderkey") % 60).alias("n")))).alias("rows"))
    return rows.mapInArrow(run, "disc long, kinds string")


@query("SELECT doc_id, sha1(text) AS lzma, sha1(text) AS zstd FROM documents WHERE text IS NOT NULL")
def other_codecs(spark, sf):
    """Every text as hunks in the two codecs that are only read, decoded again."""

    def run(batches):
        import hashlib
        import lzma

        import zstandard

        from .binary import hunks_of

        kind = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}]
        flags = bytes(1)

        def packed(tag: str, hunk: bytes) -> bytes:
            sectors, sub = B.split(hunk)
            if tag == "cdlz":
                inner, outer = lzma.compress(sectors.tobytes(), lzma.FORMAT_RAW, filters=kind), B.deflate(sub)
            else:
                inner, outer = zstandard.compress(sectors.tobytes()), zstandard.compress(sub)
            return flags + len(inner).to_bytes(2, "big") + inner + outer

        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode()
                back = [b"".join(B.DECODERS[tag](packed(tag, h), len(h)) for h in hunks_of(data))[: len(data)] for tag in ("cdlz", "cdzs")]
                out.append((doc, *(hashlib.sha1(x).hexdigest() for x in back)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "lzma", "zstd"])

    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("long"), "text").filter("text is not null")
    return A.spread(docs, "doc_id").mapInArrow(run, "doc_id long, lzma string, zstd string")
