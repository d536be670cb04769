"""Queries over whole inputs against brute force on small fixtures."""

import collections
import decimal
import random

from pyspark.sql import functions as F

from orbitframe.functions import blocks as B
from orbitframe.functions import scalars as S
from orbitframe.operators import chunks as C
from orbitframe.operators import layout as L
from orbitframe.plans import suite

TEXTS = {1: "ab" * 200 + "é\n𝄞" + "ba" * 3, 2: "".join(chr(0x4E00 + i) for i in range(300)) + chr(0x4E00 + 290) * 2, 3: "x", 4: "", 5: None}


def references(text):
    first, last = {}, 0
    for i, c in enumerate(text):
        target = first.setdefault(c, i)
        if target < i:
            yield i, target, "SELF_0" if target == last else "SELF_1" if target == last + 1 else "SELF"
            last = target


def test_references_of_whole_texts(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: list(references(t or "")) for d, t in TEXTS.items()}
    got = collections.Counter(tuple(r) for r in suite.letters(spark, str(tmp_path)).select("doc_id", "hunk", "self_hunk", "symbol").collect())
    assert got == collections.Counter((d, *r) for d, rows in want.items() for r in rows)
    sums = {r.doc_id: tuple(r)[1:] for r in suite.queries()["promote_self"](spark, str(tmp_path)).collect()}
    for d, rows in want.items():
        if rows:
            after = [h for h, _, s in rows if s == "SELF_1"]
            assert sums[d] == (len(rows), sum(h for h, _, _ in rows), sum(t for _, t, _ in rows), sum(s == "SELF_0" for _, _, s in rows), len(after), sum(after) if after else None)
    widths = {d: max((t for _, t, s in rows if s == "SELF"), default=0).bit_length() for d, rows in want.items() if rows}
    got = {r.doc_id: r.width for r in suite.queries()["self_width"](spark, str(tmp_path)).collect()}
    assert got == widths and widths[2] == 9  # target 290, far into the text


def test_slots_of_whole_tracks(spark, tmp_path):
    rows = [(7, k, decimal.Decimal(price), "F") for k, price in ((3, "999.50"), (5, "62.00"), (9, "3000.10"))] + [(8, 1, decimal.Decimal("40001.00"), "O")]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice decimal(15,2), o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    want = collections.Counter()
    for disc, lengths in ((7, (1000, 63, 3001)), (8, (2,))):
        at = 0
        for pos, n in enumerate(lengths, 1):
            total = -(-n // 4) * 4
            want.update((disc, pos, f, (at + f) // 8, (at + f) % 8, f >= n) for f in range(total))
            at += total
    slots = L.hunk_slots(suite.plain(spark, str(tmp_path)))
    assert collections.Counter(map(tuple, slots.collect())) == want
    got = {(r.disc, r.pos): (r.rows, r.hunk_sum, r.padding) for r in suite.queries()["hunk_slots"](spark, str(tmp_path)).collect()}
    for key in got:
        own = [x for x in want if x[:2] == key]
        assert got[key] == (len(own), sum(x[3] for x in own), sum(x[5] for x in own))


def test_sums_of_slots(spark, tmp_path):
    """Against the rows of hunk_slots, whatever the start and length of a track; no row for each slot of long ones."""
    rng = random.Random(4)
    rows = [(d, p, rng.randrange(0, 40), rng.randrange(3), rng.choice((0, 0, rng.randrange(1, 30)))) for d in range(40) for p in range(1, 9)]
    t = spark.createDataFrame(rows, "disc long, pos long, frames long, trailing long, stored long")
    sums = L.hunk_slots(t).groupBy("disc", "pos").agg(F.count("*").alias("rows"), F.min("hunk").alias("first_hunk"), F.max("hunk").alias("last_hunk"), F.sum("slot").alias("slot_sum"), F.sum("hunk").alias("hunk_sum"), F.count_if("padding").alias("padding"))
    assert sorted(map(tuple, L.slot_sums(t).collect())) == sorted(map(tuple, sums.collect()))
    long = spark.createDataFrame([(1, 1, 5, 0, 5), (1, 2, 10**10, 0, 0)], t.schema)
    start, n = 5, 10**10
    first = [(lba // 8, lba % 8) for lba in range(start, 8)]
    whole, rest = divmod(start + n - 8, 8)
    hunk_sum = sum(h for h, _ in first) + 8 * whole * (whole + 1) // 2 + rest * (whole + 1)
    slot_sum = sum(s for _, s in first) + 28 * whole + sum(range(rest))
    assert tuple(L.slot_sums(long).filter("pos = 2").first()) == (1, 2, n, 0, (start + n - 1) // 8, slot_sum, hunk_sum, 0)
    rows = [(7, k, 1e3 * k + 0.5, "F") for k in range(1, 9)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    plan = suite.queries()["hunk_slots"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_every_slot_is_laid_out(spark, tmp_path, monkeypatch):
    """Blocks of slots against brute force at any size; the query's sums come from them, one slot after the other."""
    rng = random.Random(11)
    for size in (1, 5, 8, 64, 1 << 16):
        lay = B.slot_blocks(size)
        for start, total, frames in [(3, 70000, 69990), (0, 8, 0), (5, 4, -2), (7, 9, 20)] + [(rng.randrange(99), n := rng.randrange(1, 200), rng.randrange(n + 1)) for _ in range(20)]:
            got = [(first + h, s, p) for first, *columns in lay(start, total, frames) for h, s, p in zip(*(c.tolist() for c in columns))]
            assert got == [((start + f) // 8, (start + f) % 8, f >= frames) for f in range(total)]
    rows = [(d, k, rng.randrange(1, 90000) + 0.5, "F") for d in (1, 2, None) for k in range(1, 9)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    tasks, laid, whole, kind = [], [], B.slot_blocks, type(spark.range(1))
    in_arrow = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema: tasks.append((df, f)) or in_arrow(df, f, schema))
    result = suite.queries()["hunk_slots"](spark, str(tmp_path))
    want = sorted((tuple(r) for r in result.collect()), key=str)

    def counted():
        lay = whole()

        def blocks(*track):
            for block in lay(*track):
                laid.append(len(block[1]))
                yield block

        return blocks

    assert len(tasks) == 1
    tracks, run = tasks[0]
    monkeypatch.setattr(B, "slot_blocks", counted)
    got = [tuple(r.values()) for batch in run(tracks.toArrow().to_batches()) for r in batch.to_pylist()]
    assert sorted(got, key=str) == want and len(want) == len(rows)
    assert sum(laid) == sum(-(-(int(price) % 40000 + 1) // 4) * 4 for _, _, price, _ in rows)


def test_candidates_by_classes(spark):
    rng = random.Random(1)
    probe = [(k, rng.choice("abcdef")) for k in range(200) for _ in range(rng.randrange(1, 4))] + [(999, None)]
    titles = [(t, rng.choice("abcde")) for t in range(60) for _ in range(rng.randrange(1, 6))] + [(61, None)]
    got = {r.key: (r.titles, r.first_title) for r in C.candidates(spark.createDataFrame(probe, "key int, item string"), spark.createDataFrame(titles, "title int, item string"), "key", "title", "item").collect()}
    held, asked = collections.defaultdict(set), collections.defaultdict(set)
    for t, x in titles:
        held[t].add(x)
    for k, x in probe:
        asked[k].add(x)
    want = {k: sorted(t for t, y in held.items() if x <= y) for k, x in asked.items() if None not in x}
    assert got == {k: (len(t), t[0]) for k, t in want.items() if t}


def test_match_keeps_missing_digests(spark):
    probe = spark.createDataFrame([(1, "aa"), (1, "bb")], "disc int, sha1 string")
    files = [("whole", "aa"), ("whole", "bb"), ("one more", "aa"), ("one more", "bb"), ("one more", None), ("twice", "aa"), ("twice", "aa"), ("twice", "bb")]
    got = C.match_sets(probe, spark.createDataFrame(files, "title string, sha1 string"), "disc", "title", "sha1")
    assert [r.title for r in got.collect()] == ["whole"]


def test_peripherals(spark):
    cases = {"        ": None, "0000000 ": [], "0000011 ": ["VGA box", "Windows CE"], "0000F00 ": ["VMU", "jump pack", "microphone", "other expansions"], "007F000 ": ["controller", "C button", "D button", "X button", "Y button", "Z button", "expanded directions"], "E000000 ": ["mouse", "keyboard", "light gun"], "1FFFFFFFF": None}
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", S.peripherals(F.btrim("d")).alias("names"))
    assert {r.d: r.names for r in df.collect()} == cases
