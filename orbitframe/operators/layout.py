"""Layout of tracks on a disc: DataFrame -> DataFrame over (disc, pos, type, frames, pregap, ...).

Every operator is a window over one disc's tracks in listing order. A disc has at most 99 tracks,
so a window's partition is bounded whatever the number of discs. Sums over slots go through all of
them in Arrow, after the windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import blocks as B
from ..functions import scalars as S
from ..sources.archive import spread


def order():
    return Window.partitionBy("disc").orderBy("pos")


def up_to():
    return order().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy("disc")


def sum_before(c) -> F.Column:
    return F.coalesce(F.sum(c).over(order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def cue_layout(t: DataFrame) -> DataFrame:
    """start of each track of a sheet; the first track marked ``hda`` lifts what follows to 45,000."""
    used = F.col("pregap") + F.col("frames")
    t = t.withColumn("cum", F.sum(used).over(up_to())).withColumn("first_hda", F.min(F.when(F.col("hda"), F.col("pos"))).over(whole())).withColumn("last_hda", F.max(F.when(F.col("hda"), F.col("pos"))).over(whole()))
    t = t.withColumn("c", F.max(F.when(F.col("pos") == F.col("first_hda"), F.col("cum"))).over(whole()))
    before = F.col("cum") - used
    start = F.when(F.col("first_hda").isNull() | (F.col("pos") <= F.col("first_hda")), before + F.col("pregap")).otherwise(F.greatest("c", F.lit(S.HDA)) + (before - F.col("c")) + F.col("pregap"))
    return t.withColumn("start_lba", start).withColumn("gdrom", F.col("first_hda").isNotNull()).withColumn("bridge", F.col("last_hda"))


def with_bytes(t: DataFrame) -> DataFrame:
    return t.withColumn("bytes", F.col("frames") * S.SECTOR)


def allocate(t: DataFrame) -> DataFrame:
    """stored frames (given, or padded to four), start by running sum."""
    padded = S.align_up(F.col("frames") + F.col("trailing"), 4)
    t = t.withColumn("total", F.when(F.col("stored") > 0, F.col("stored")).otherwise(padded))
    return t.withColumn("start_lba", sum_before("total"))


def disc_allocation(t: DataFrame) -> DataFrame:
    s = allocate(t).groupBy("disc").agg(F.sum("total").alias("stored_frames"))
    hunks = S.idiv(F.col("stored_frames") + 7, 8)
    return s.select("disc", "stored_frames", hunks.alias("hunks"), (hunks * 8 * S.SLOT).alias("write_bytes"))


def shift_pregaps(t: DataFrame) -> DataFrame:
    """On a GD-ROM a pregap's sectors move to the end of the track before."""
    own = F.when(F.row_number().over(order()) > 1, F.col("pregap")).otherwise(0)
    return t.withColumn("trailing", F.lead("pregap", 1, 0).over(order())).withColumn("frames", F.col("frames") - own)


def pad_bridge(t: DataFrame) -> DataFrame:
    """The bridge track is stored up to 45,000 if it fits; tracks before it hold their trailing pregap too."""
    need = F.lit(S.HDA) - sum_before(S.align_up(F.col("frames") + F.col("trailing"), 4))
    return t.withColumn("stored", F.when((F.col("pos") == F.col("bridge")) & (need >= F.col("frames")), need).otherwise(F.lit(0)).cast("long"))


def infer_pregaps(t: DataFrame) -> DataFrame:
    """150 where an audio track follows a data track whose padding has room for it."""
    start = sum_before("total")
    room = F.lag(F.col("total") - F.col("real")).over(order()) >= 150
    yes = F.col("gdrom") & ~S.is_audio(F.lag("type").over(order())) & room & (start != S.HDA) & S.is_audio(F.col("type"))
    return t.withColumn("start_lba", start).withColumn("inferred", F.when(yes, 150).otherwise(0).cast("long"))


def spans(t: DataFrame) -> DataFrame:
    """[start - pregap, start + frames), clipped to the next track's start."""
    low = F.col("start_lba") - F.col("pregap")
    t = t.withColumn("span_start", low)
    return t.withColumn("span_end", F.least(F.col("start_lba") + F.col("frames"), F.coalesce(F.lead("span_start").over(order()), F.lit(1 << 40))))


def route(sectors: DataFrame, spans: DataFrame, width: int = 4096) -> DataFrame:
    """Sectors (disc, lba) -> their track, by an equi-join on stretches of LBA; gaps are dropped."""
    filled = spans.filter("span_start < span_end")
    stretch = filled.withColumn("stretch", F.explode(F.sequence(S.idiv(F.col("span_start"), width), S.idiv(F.col("span_end") - 1, width))))
    s = sectors.withColumn("stretch", S.idiv(F.col("lba"), width))
    hit = s.join(stretch, ["disc", "stretch"]).filter("lba >= span_start and lba < span_end")
    return hit.withColumn("sector", F.col("lba") - F.col("span_start"))


def hunk_slots(t: DataFrame) -> DataFrame:
    """A row for each slot of a disc: hunk, place in it, track, whether it is padding."""
    a = allocate(t).filter("total > 0")
    slot = a.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    lba = F.col("start_lba") + F.col("frame")
    return slot.select("disc", "pos", "frame", S.idiv(lba, 8).alias("hunk"), (lba % 8).alias("slot"), (F.col("frame") >= F.col("frames")).alias("padding"))


def slot_sums(t: DataFrame) -> DataFrame:
    """The slots of ``hunk_slots`` summed up by track: a task lays out every slot of its tracks, in blocks, and adds them up."""
    a = allocate(t).filter("total > 0").select("disc", "pos", "start_lba", "total", F.coalesce("frames", "total").alias("frames"))
    sums = ["rows", "first_hunk", "last_hunk", "slot_sum", "hunk_sum", "padding"]

    def added(blocks) -> tuple[int, ...]:
        rows = slot_sum = hunk_sum = padding = 0
        for first, hunk, slot, padded in blocks:
            if not rows:
                first_hunk = first + int(hunk[0])
            last_hunk = first + int(hunk[-1])
            rows += len(hunk)
            slot_sum += int(slot.sum(dtype=np.int32))
            hunk_sum += first * len(hunk) + int(hunk.sum(dtype=np.int32))
            padding += int(np.count_nonzero(padded))
        return rows, first_hunk, last_hunk, slot_sum, hunk_sum, padding

    def run(batches):
        lay = B.slot_blocks()
        for batch in batches:
            tracks = zip(*(batch.column(c).to_pylist() for c in ("start_lba", "total", "frames")))
            table = np.array([added(lay(*x)) for x in tracks], np.int64).reshape(-1, len(sums))
            yield pa.RecordBatch.from_arrays([batch.column("disc"), batch.column("pos"), *map(pa.array, table.T)], names=["disc", "pos", *sums])

    key = ", ".join(f"{c} {a.schema[c].dataType.simpleString()}" for c in ("disc", "pos"))
    return spread(a, "disc", "pos").mapInArrow(run, f"{key}, " + ", ".join(f"{c} long" for c in sums))
