"""Shards of near equal bytes, equal texts together (operator 2).

Longest-processing-time scheduling: items by falling size go to the least loaded shard, through a
heap. An item is a group of equal texts where the group holds at least 1 / (shards x FINE) of all
bytes; there are at most shards x FINE such groups. All other groups are dealt by their digest into
shards x FINE bundles, and a bundle is an item. So the heap sees a bounded number of items at any
size of input, groups stay whole, and no shard differs from another by more than the last item put
on it. Every row reaches its shard through two broadcast tables of bounded size.

Defined cases: a null text is a group with the empty text (size 8); rows may repeat, each gets its
own slot; doc_id may be null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from . import scratch

FINE = 1024
#: Rows numbered together when slots are given out.
SLOT_CHUNK = 50_000


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item name -> shard; items are (size, name)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        out[name] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    rows, _ = scratch.written(
        docs.select(docs[key].alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("group"), F.monotonically_increasing_id().alias("row")),
        "sizes",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundles = shards * FINE
    least = max(1, -(-total // bundles))
    bundle = F.pmod(F.xxhash64("group"), F.lit(bundles)).cast("string")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    item = F.when(F.col("bytes") >= least, F.concat(F.lit("g"), F.hex("group"))).otherwise(bundle)
    found = groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 x bundles
    plan = schedule([(r.bytes, r.item) for r in found], shards)
    whole = spark.createDataFrame([(bytes.fromhex(k[1:]), v) for k, v in plan.items() if k[0] == "g"], "group binary, whole int")
    parts = spark.createDataFrame([(k, v) for k, v in plan.items() if k[0] != "g"], "item string, part int")
    placed = rows.join(F.broadcast(whole), "group", "left").withColumn("item", F.when(F.col("whole").isNull(), bundle)).join(F.broadcast(parts), "item", "left").withColumn("shard", F.coalesce("whole", "part")).drop("whole", "part", "item")
    chunks = max(1, n // SLOT_CHUNK // shards + 1)
    # By the number that a row was written with, so that chunks are even whatever ids and texts are.
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(max(8, chunks))))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1)
    return numbered.join(sizes, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
