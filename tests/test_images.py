"""Images of discs: formats there and back, pinned digests, damage, catalogues."""

from __future__ import annotations

import hashlib
import io
import json
import lzma
import math
import os
import random
import zipfile
from email.message import Message

import numpy as np
import pytest

from orbitframe import __main__ as commands
from orbitframe import engine, progress, reports
from orbitframe.functions import blocks as B
from orbitframe.operators import images as I
from orbitframe.operators import layout as L
from orbitframe.sources import archive as A
from orbitframe.sources import catalogue as K
from orbitframe.sources import sheets as H


def varied(sectors: int, fill: int) -> bytes:
    return bytes(fill ^ (i % 256) for i in range(256)) * (sectors * 2352 // 256) + bytes(fill ^ i for i in range(sectors * 2352 % 256))


def write(folder, name: str, data) -> str:
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return path


def cue(folder, tracks, mark: int | None = None, pregaps=()) -> str:
    """tracks: (type, bytes); mark: the track that the dense area follows."""
    text = ""
    for i, (kind, data) in enumerate(tracks, 1):
        write(folder, f"t{i}.bin", data)
        pregap = dict(pregaps).get(i, 0)
        index = f"    INDEX 00 00:00:00\n    INDEX 01 00:{pregap // 75:02d}:{pregap % 75:02d}\n" if pregap else "    INDEX 01 00:00:00\n"
        text += f'FILE "t{i}.bin" BINARY\n  TRACK {i:02d} {kind}\n{index}' + ("REM HIGH-DENSITY AREA\n" if i == mark else "")
    return write(folder, "disc.cue", text)


@pytest.fixture
def work(spark, tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    return str(shared)


def test_parity_is_the_pinned_one():
    s = np.zeros((1, 2352), np.uint8)
    s[0, 12:16] = (0, 2, 0x10, 1)
    s[0, 16:2064] = (np.arange(2048) * 7 & 255) ^ 0x5A
    out = B.with_parity(s)
    assert out[0, 2076:2092].tobytes().hex() == "b4e28f2ed109d5ca3f97614eda0aa54b"
    assert out[0, 2248:2264].tobytes().hex() == "b1a4721ce89664dcbebfe277ebdccd06"
    left, gone = B.strip(np.concatenate((out, s)))
    assert gone.tolist() == [True, False]
    assert (B.with_parity(left[:1]) == out).all()


def test_blocks_come_back():
    rng = random.Random(1)
    t = range(4704)
    tones = np.array([[int(9000 * math.sin(i / 20) + 4000 * math.sin(i / 7)), int(4500 * math.sin(i / 20))] for i in t], ">i2")
    noise = np.array([[rng.randrange(-300, 300), rng.randrange(-32768, 32768)] for _ in t], ">i2")
    for samples in (tones, noise, np.zeros((4704, 2), ">i2"), np.full((4704, 2), -32768, ">i2")):
        hunk = B.joined(samples.view(np.uint8).reshape(8, 2352), bytes(768))
        assert B.unflac(B.flac(hunk), len(hunk)) == hunk
        assert B.DECODERS["cdzl"](B.framed(hunk), len(hunk)) == hunk
    assert B.encode(B.joined(tones.view(np.uint8).reshape(8, 2352), bytes(768)), True, ("cdzl", "cdfl"))[0] == 1
    loud = rng.randbytes(B.HUNK)
    assert B.encode(loud, True, ("cdzl", "cdfl")) == (None, loud)


def test_other_codecs_decode():
    import zstandard

    sectors, sub = varied(8, 0x3C), bytes(768)
    kind = [{"id": lzma.FILTER_LZMA1, "lc": 3, "lp": 0, "pb": 2, "dict_size": 1 << 16}]
    for tag, inner, outer in (("cdlz", lzma.compress(sectors, lzma.FORMAT_RAW, filters=kind), B.deflate(sub)), ("cdzs", zstandard.compress(sectors), zstandard.compress(sub))):
        out = B.DECODERS[tag](b"\0" + len(inner).to_bytes(2, "big") + inner + outer, B.HUNK)
        assert out == B.joined(np.frombuffer(sectors, np.uint8).reshape(8, 2352), sub)
        with pytest.raises(B.BadBlock):
            B.DECODERS[tag](b"\0\xff\xff" + inner, B.HUNK)
    with pytest.raises(B.BadBlock):
        B.unzstd(zstandard.compress(bytes(B.ZSTD_MOST + 1)), B.ZSTD_MOST + 1)
    wide = bytes(4) + (len(B.deflate(bytes(27 * 2352)))).to_bytes(3, "big") + B.deflate(bytes(27 * 2352)) + B.deflate(bytes(27 * 96))
    assert B.DECODERS["cdzl"](wide, 27 * 2448) == bytes(27 * 2448)


def test_crc():
    assert B.crc16(b"123456789") == 0x29B1


def test_map_symbols():
    assert A.canonical([1, 3, 3, 0, 3, 3]) == {0: (1, 1), 1: (0, 3), 2: (1, 3), 4: (2, 3), 5: (3, 3)}
    with pytest.raises(A.BadArchive):
        A.canonical([1, 2, 3])
    bits = [0] * 16
    for s in (0, 1, 2, A.RUN_SHORT, A.RUN_LONG, A.NONE, 3, A.SELF):
        bits[s] = 3
    codes = A.canonical(bits)

    def stream(*symbols):
        text = "".join(f"{codes[s][0]:03b}" for s in symbols)
        return A.MapBits(int(text.ljust(64, "0"), 2).to_bytes(8, "big"))

    back = {c: s for s, c in codes.items()}
    assert A.kinds(stream(2, A.RUN_SHORT, 1), back, 5) == [2] * 5
    assert A.kinds(stream(2, A.RUN_LONG, 1, 2), back, 38) == [2] * 38


def test_pinned_digests_and_there_and_back(spark, tmp_path, work):
    src, back = tmp_path / "src", tmp_path / "back"
    src.mkdir()
    tracks = [("MODE1/2352", varied(4, 0x5A)), ("AUDIO", varied(8, 0xA5)), ("AUDIO", varied(8, 0x3C))]
    for codec in I.CODECS:
        out = engine.convert(spark, cue(src, tracks), str(tmp_path / "a.chd"), codec=codec, force=True, work=work)
        assert out["tracks"] == 3 and out["bytes"] == 20 * 2352
        report = engine.verify(spark, str(tmp_path / "a.chd"), "chd").first()
        assert report["error"] is None
        assert report["raw_sha1"] == "891256b36712482670167e1c7f94e07b27b764e8"
        assert report["combined_sha1"] == "b620fb388670ae8e767c328634de0b80bdd34632"
        assert report["track_sha1"] == [hashlib.sha1(d).hexdigest() for _, d in tracks]
    with pytest.raises(Exception, match="exists"):
        engine.convert(spark, str(src), str(tmp_path / "a.chd"), work=work)
    assert os.listdir(work) == []
    for to in ("cue", "gdi"):
        done = engine.convert(spark, str(tmp_path / "a.chd"), str(back), to=to, force=True, work=work)
        assert done["bytes"] == 20 * 2352
        assert [open(back / n, "rb").read() for n in ("track01.bin", "track02.raw", "track03.raw")] == [d for _, d in tracks]
        again = engine.layout(spark, done["path"], to).orderBy("pos").collect()
        assert [(r["number"], r["type"], r["frames"], r["start_lba"]) for r in again] == [(1, "MODE1/2352", 4, 0), (2, "AUDIO", 8, 4), (3, "AUDIO", 8, 12)]
    discs, t = engine.describe(spark, str(tmp_path / "a.chd"), "chd")
    assert discs.first()["codec"] == "cdzl, cdfl" and discs.first()["hunks"] == 3 and not discs.first()["gdrom"]
    report = json.loads(engine.as_json(discs, t).first()["json"])
    assert {"file", "format", "gdrom", "codec", "hunks", "stored_bytes", "bytes", "tracks"} <= set(report) and "pregap" not in report
    assert (report["file"], report["format"], report["codec"], report["hunks"], report["bytes"]) == ("a.chd", "chd", "cdzl, cdfl", 3, 20 * 2352)
    assert report["tracks"][1] == {"number": 2, "type": "AUDIO", "lba": 4, "frames": 8, "bytes": 8 * 2352}


def test_references_and_damage(spark, tmp_path, work):
    block = lambda fill: bytes(fill ^ (i * 13 & 255) for i in range(8 * 2352))
    a, b, c = block(0x11), block(0x22), block(0x33)
    path = str(tmp_path / "r.chd")
    engine.convert(spark, cue(tmp_path, [("MODE1/2352", a + b + c + a + b + a + a)]), path, codec="cdzl", work=work)
    paths = A.listed(spark, path)
    m = A.hunk_map(paths).orderBy("hunk").collect()
    assert [r["self_hunk"] for r in m] == [None, None, None, 0, 1, 0, 0]
    assert [r["comp_type"] for r in m[3:]] == [A.SELF_SAME, A.SELF_NEXT, A.SELF, A.SELF_SAME]
    assert A.hunks(paths).count() == 7
    assert A.sectors(paths).filter("lba = 24").first()["sector"] == a[:2352]
    data = bytearray(open(path, "rb").read())
    for at, what in ((m[1]["offset"] + 40, "hunk 1|checksum|deflate"), (0x40, "data's digest"), (0x54, "metadata's digest")):
        bad = data.copy()
        bad[at] ^= 0xFF
        write(tmp_path, "bad.chd", bytes(bad))
        error = engine.verify(spark, str(tmp_path / "bad.chd"), "chd").first()["error"]
        assert error and any(w in error for w in what.split("|")), (at, error)
    for at, value, what in ((0, b"X", "not an archive"), (0x0F, b"\4", "version"), (0x10, b"avhu", "decoder"), (0x14, b"avhu", "decoder")):
        bad = data.copy()
        bad[at : at + len(value)] = value
        write(tmp_path, "bad.chd", bytes(bad))
        with pytest.raises(Exception, match=what):
            A.headers(A.listed(spark, str(tmp_path / "bad.chd"))).collect()


def test_dense_area_round_trip(spark, tmp_path, work):
    """A disc whose third track is dense: the bridge is stored up to 45,000, a pregap moves and comes back."""
    src = tmp_path / "src"
    src.mkdir()
    tracks = [("MODE1/2352", varied(451, 1)), ("AUDIO", varied(300, 2)), ("MODE1/2352", varied(9, 3))]
    path = str(tmp_path / "g.chd")
    sheet = cue(src, tracks, mark=2, pregaps=[(2, 150)])
    starts = [r["start_lba"] for r in engine.layout(spark, sheet, "cue").orderBy("pos").collect()]
    assert starts == [0, 601, 45000]
    engine.convert(spark, sheet, path, work=work)
    t = A.tracks(A.listed(spark, path)).orderBy("pos").collect()
    assert [(r["start_lba"], r["real"], r["pregap"], r["gdrom"]) for r in t] == [(0, 451, 0, True), (604, 150, 150, True), (45000, 9, 0, True)]
    report = engine.verify(spark, path, "chd").first()
    assert report["error"] is None and report["track_sha1"] == [hashlib.sha1(d).hexdigest() for _, d in tracks]
    done = engine.convert(spark, path, str(tmp_path / "out"), to="cue", work=work)
    text = open(done["path"]).read()
    assert text.index("INDEX 01 00:02:00") < text.index("REM HIGH-DENSITY AREA") < text.index("TRACK 03")
    assert [open(tmp_path / "out" / n, "rb").read() for n in ("track01.bin", "track02.raw", "track03.bin")] == [d for _, d in tracks]
    gdi = engine.convert(spark, sheet, str(tmp_path / "gdi"), work=work)
    assert open(gdi["path"]).read() == "3\n1 0 4 2352 track01.bin 0 \n2 601 0 2352 track02.raw 0 \n3 45000 4 2352 track03.bin 0 \n"
    assert os.path.getsize(tmp_path / "gdi" / "track02.raw") == 150 * 2352
    again = engine.convert(spark, gdi["path"], str(tmp_path / "cue"), to="cue", work=work)
    assert "REM HIGH-DENSITY AREA\nFILE \"track03.bin\"" in open(again["path"]).read()
    with pytest.raises(FileExistsError):
        engine.convert(spark, gdi["path"], str(tmp_path / "cue"), to="cue", work=work)


def test_sheets(spark, tmp_path):
    write(tmp_path, "x.bin", bytes(300 * 2352 + 5))
    sheet = write(tmp_path, "a.cue", 'REM early\r\nfile "x.bin" binary\r\n  TRACK 01 MODE1/2352\r\n PREGAP 00:02:00\r\n\r\n  INDEX 01 00:00:00\r\nTRACK 02 AUDIO\n INDEX 00 00:01:00\n INDEX 01 00:03:00\nREM a\nREM last\n')
    t = H.cue_tracks(H.read_sheets(spark, sheet, "cue")).orderBy("track_pos").collect()
    assert [(r["name"], r["rem"], r["number"], r["type"], r["indexes"]) for r in t] == [("x.bin", "last", 1, "MODE1/2352", [0]), ("x.bin", "last", 2, "AUDIO", [75, 225])]
    assert [(r["pos"], r["frames"]) for r in engine.layout(spark, sheet, "cue").collect()] == [(1, 300)]
    for text in (" \n", "nonsense", 'FILE "x.bin" BINARY\n', 'FILE "x.bin" BINARY\nTRACK xx AUDIO\n', 'FILE "x.bin" BINARY\nTRACK 1 AUDIO\nINDEX 01 00:60:00\n'):
        bad = write(tmp_path, "bad.cue", text)
        with pytest.raises(Exception):
            engine.layout(spark, bad, "cue").collect()
    gdi = write(tmp_path, "a.gdi", '9\nnonsense\n\nx 0 4 2352 x.bin 0\n3 45000 4 2352 "x.bin" 0\n1 0 4 2352 x.bin 0 \n')
    rows = engine.layout(spark, gdi, "gdi").orderBy("pos").collect()
    assert [(r["number"], r["start_lba"], r["gdrom"]) for r in rows] == [(3, 45000, True), (1, 0, True)]
    with pytest.raises(Exception):
        engine.layout(spark, write(tmp_path, "b.gdi", "3\n"), "gdi").collect()


def test_boot_header(spark, tmp_path):
    head = bytearray(b" " * 256)
    for at, text in ((0, b"SEGA"), (0x20, b"1234 GD-ROM1/2"), (0x30, b"JUE"), (0x38, b"0000010"), (0x50, b"20000131"), (0x60, b"1ST.BIN\0"), (0x80, b"A TITLE")):
        head[at : at + len(text)] = text
    cue(tmp_path, [("MODE1/2352", bytes(16) + bytes(head) + bytes(2352 * 4 - 272))])
    discs, _ = engine.describe(spark, str(tmp_path), "cue")
    d = discs.first()
    assert (d["hardware_id"], d["title"], d["disc_no"], d["release_date"], d["regions"], d["peripherals"]) == ("SEGA", "A TITLE", "1/2", "2000-01-31", ["Japan", "USA", "Europe"], ["VGA box"])


def test_catalogue(spark, tmp_path):
    a, b = varied(4, 1), varied(5, 2)
    sums = [hashlib.sha1(x).hexdigest() for x in (a, b)]
    rom = lambda name, s: f'<rom name="{name}" sha1="{s.upper()}"/>'
    games = "".join(f'<game name="{n}">{rom("1.bin", sums[0])}{rom("2.bin", sums[1])}{extra}</game>' for n, extra in (("One", rom("x.CUE", "ab" * 20)), ("Two", "")))
    dat = K.read_catalogue(spark, write(tmp_path, "d.dat", f"<datafile>{games}</datafile>"))
    assert dat.count() == 4
    cue(tmp_path, [("MODE1/2352", b), ("AUDIO", a)])
    row = engine.verify(spark, str(tmp_path), "cue", dat).first()
    assert (row["titles"], row["known"]) == (["One", "Two"], 2)
    cue(tmp_path, [("MODE1/2352", a), ("AUDIO", a)])
    row = engine.verify(spark, str(tmp_path), "cue", dat).first()
    assert (row["titles"], row["known"]) == ([], 2)
    with pytest.raises(ValueError):
        engine.verify(spark, str(tmp_path), "gdi", dat)
    for nothing in ("<datafile></datafile>", f'<datafile><game name="One">{rom("x.cue", "ab" * 20)}</game></datafile>'):
        with pytest.raises(ValueError):
            K.read_catalogue(spark, write(tmp_path, "e.dat", nothing))
    assert K.catalogue_version(spark, write(tmp_path, "f.dat", "<datafile><header><version>2026-01</version></header></datafile>")) == "2026-01"


def zipped(name: str, text: str) -> bytes:
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr(name, text)
    return body.getvalue()


def served(name: str | None, body: bytes = b"", asked: list | None = None) -> K.Opener:
    """An opener of one download; no name: the address can't be asked."""

    def opened(method, address):
        if asked is not None:
            asked.append(method)
        if name is None:
            raise OSError("no network")
        head = Message()
        head["Content-Disposition"] = f'attachment; filename="{name}"'
        return head, b"" if method == "HEAD" else body

    return opened


def test_catalogue_is_fetched_once_a_build(tmp_path):
    folder, asked = str(tmp_path / "cache"), []
    with pytest.raises(OSError):
        K.fetched("x", folder, served(None))
    first = K.fetched("x", folder, served("A - B (1) (2026-06-14 18-25-41).zip", zipped("a.DAT", "one"), asked))
    assert os.path.basename(first) == "A-B-1-2026-06-14-18-25-41.dat" and open(first).read() == "one"
    assert K.fetched("x", folder, served("A - B (1) (2026-06-14 18-25-41).zip", b"", asked)) == first and asked == ["HEAD", "GET", "HEAD"]
    assert K.fetched("x", folder, served(None)) == first
    second = K.fetched("x", folder, served("new.zip", zipped("b.dat", "two")))
    assert os.listdir(folder) == [os.path.basename(second)] and open(second).read() == "two"
    for name, body in (("y.zip", b"no zip"), ("z.zip", zipped("c.txt", "three"))):
        with pytest.raises(ValueError):
            K.fetched("x", folder, served(name, body))
    with pytest.raises(OSError):
        K.fetched("x", str(tmp_path / "none"), served("", b""))


def test_commands(spark, tmp_path, work, capsys, monkeypatch):
    src, out = tmp_path / "src", tmp_path / "out.chd"
    src.mkdir()
    head = bytearray(b" " * 256)
    head[0x80:0x87] = b"A TITLE"
    data = (bytes(16) + bytes(head)).ljust(2352, b"\0") + varied(5, 1)
    cue(src, [("MODE1/2352", data), ("AUDIO", varied(8, 2))])
    assert commands.main(["--work", work, "convert", str(src), str(out)]) == 0
    assert capsys.readouterr().out == f"Converting disc.cue\n  Written: {out} (2 tracks · 32.2 KiB)\n"
    assert commands.main(["--json", "info", str(out)]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["name"] == "A TITLE" and found["stored_bytes"] == os.path.getsize(out)
    assert commands.main(["info", str(out)]) == 0
    text = capsys.readouterr().out
    assert text.startswith("out.chd\n  name    A TITLE\n  format  chd\n  layout  CD\n  codec   cdzl, cdfl\n") and "  #  TYPE        LBA  FRAMES  SIZE\n  1  MODE1/2352  0    6       13.8 KiB\n" in text
    assert commands.main(["info", str(src / "disc.cue")]) == 0
    assert "SIZE      FILE\n" in capsys.readouterr().out
    sums = [hashlib.sha1(x).hexdigest() for x in (data, varied(8, 2))]
    dat = "<datafile><header><version>v7</version></header>" + "".join(f'<game name="{n}"><rom name="1" sha1="{sums[0]}"/><rom name="2" sha1="{s}"/></game>' for n, s in (("Right", sums[1]), ("Wrong", "00"))) + "</datafile>"
    monkeypatch.setattr(commands, "CACHE", str(tmp_path / "cache"))
    assert commands.main(["--json", "--work", work, "verify", "--redump", str(out)], served("c.zip", zipped("c.dat", dat))) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["redump"] == {"dat_version": "v7", "titles": ["Right"], "tracks_known": 2} and set(found) == {"file", "hunks", "tracks", "logical_bytes", "raw_sha1", "combined_sha1", "redump"}
    assert commands.main(["verify", "--dat", write(tmp_path, "w.dat", dat.replace("Right", "Other")), str(src)]) == 0
    assert capsys.readouterr().out == "Verifying disc.cue\n  2 tracks, 32.2 KiB\n  redump         Other\n"
    assert commands.main(["verify", "--dat", write(tmp_path, "x.dat", dat.replace(sums[1], "11")), str(out)]) == 0
    assert "  redump         no match (1 of 2 tracks known)\n" in capsys.readouterr().out
    assert commands.main(["--json", "--work", work, "convert", "--to", "gdi", str(out), str(tmp_path / "g")]) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["format"], found["name"], found["tracks"]) == ("gdi", "A TITLE", 2) and open(tmp_path / "g" / "name.txt").read() == "A TITLE"
    broken = bytearray(out.read_bytes())
    broken[0x40] ^= 1
    assert commands.main(["verify", write(tmp_path, "broken.chd", bytes(broken))]) == 1
    assert "digest" in capsys.readouterr().err


def test_reports_of_sizes():
    assert [reports.size_text(n) for n in (0, 1023, 1024, 1 << 20, 3 << 30)] == ["0 B", "1023 B", "1.0 KiB", "1.0 MiB", "3.00 GiB"]
    assert reports.stored_text(1 << 20, 4 << 20) == "1.0 MiB (25% of 4.0 MiB)" and reports.stored_text(0, 5) == "0 B"
    assert reports.info_text({"file": "a.gdi", "gdrom": True, "format": "gdi", "bytes": 0, "tracks": []}) == "a.gdi\n  format  gdi\n  layout  GD-ROM, high-density area from LBA 45000\n  tracks  0 (0 B)\n\n  #  TYPE  LBA  FRAMES  SIZE\n"


def test_progress_and_cancellation(spark):
    class Terminal(io.StringIO):
        def isatty(self):
            return True

    out = Terminal()
    with progress.step(spark, "Counting", out) as group:
        spark.range(100).repartition(3).count()
        assert progress.tasks_of(spark, group)[0] > 0
    assert "Counting" in out.getvalue() and out.getvalue().endswith("tasks\n")
    quiet = io.StringIO()
    with progress.step(spark, "Counting", quiet):
        spark.range(10).count()
    assert quiet.getvalue() == ""

    import threading

    def slow(batches):
        import time

        for b in batches:
            time.sleep(60)
            yield b

    with pytest.raises(BaseException) as stopped:
        with progress.step(spark, "Waiting") as group:
            threading.Timer(2, lambda: progress.cancel(spark, group, 10)).start()
            spark.range(4).mapInArrow(slow, "id long").count()
    assert "cancelled" in str(stopped.value).lower()


def test_big_files_beside_a_sheet_are_not_read(spark, tmp_path):
    cue(tmp_path, [("MODE1/2352", varied(4, 1))])
    os.rename(tmp_path / "disc.cue", tmp_path / "disc.CuE")
    for name in ("t2.bin", "other.iso"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(3 << 30)
    sheets = H.read_sheets(spark, str(tmp_path), "cue")
    assert [os.path.basename(r["path"]) for r in sheets.collect()] == ["disc.CuE"]
    assert engine.layout(spark, str(tmp_path), "cue").count() == 1


def test_track_sectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "STRETCH", 3)
    cue(tmp_path, [("MODE1/2352", varied(7, 1) + b"tail"), ("AUDIO", varied(2, 2))])
    rows = H.track_sectors(engine.layout(spark, str(tmp_path), "cue")).orderBy("pos", "sector").collect()
    assert [(r["pos"], r["sector"]) for r in rows] == [*((1, i) for i in range(7)), (2, 0), (2, 1)]
    assert b"".join(r["data"] for r in rows[:7]) == varied(7, 1)


def test_one_archive_is_verified_by_many_tasks(spark, tmp_path, work, monkeypatch):
    monkeypatch.setattr(A, "STRETCH", 2)
    noise = random.Random(5).randbytes(8 * 2352 * 9)
    path = str(tmp_path / "a.chd")
    engine.convert(spark, cue(tmp_path, [("MODE1/2352", noise), ("AUDIO", varied(30, 4))]), path, work=work)
    paths = A.listed(spark, path)
    assert A.stretches(paths).count() == 7 and A.stretches(paths, 0, 1).select("hunk").first()["hunk"] == [0]
    with progress.step(spark, "Decoding") as group:
        I.decode_stretches(paths, work).write.format("noop").mode("overwrite").save()
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) > 1
    alone, many = I.verify(paths).first(), I.verify(paths, work).first()
    assert alone == many and many["error"] is None and many["track_sha1"][0] == hashlib.sha1(noise).hexdigest()
    data = bytearray(open(path, "rb").read())
    m = A.hunk_map(paths).orderBy("hunk").collect()
    for hunk in (5, 3):
        data[m[hunk]["offset"] + 30] ^= 0xFF
    write(tmp_path, "bad.chd", bytes(data))
    found = I.verify(A.listed(spark, str(tmp_path / "bad.chd")), work).first()
    assert "hunk 3" in found["error"] and found["raw_sha1"] is None


def test_detect(tmp_path):
    write(tmp_path, "A.GDI", "1\n")
    assert engine.detect(str(tmp_path))[1] == "gdi"
    write(tmp_path, "b.cue", "x")
    assert engine.detect(str(tmp_path))[1] == "cue"
    write(tmp_path, "c.cue", "")
    with pytest.raises(ValueError):
        engine.detect(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        engine.detect(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="empty"):
        engine.detect(write(tmp_path, "d.chd", ""))


def test_layout_columns_of_bridge(spark):
    rows = [("d", 1, 450, 0, 2), ("d", 2, 10068, 150, 2), ("d", 3, 504150, 0, 2)]
    t = spark.createDataFrame(rows, "disc string, pos long, frames long, pregap long, bridge long")
    out = L.pad_bridge(L.shift_pregaps(t)).orderBy("pos").collect()
    assert [(r["frames"], r["trailing"], r["stored"]) for r in out] == [(450, 150, 0), (9918, 0, 44400), (504150, 0, 0)]


def test_arrivals(spark, tmp_path, work):
    from orbitframe.streaming.arrivals import verify_arrivals

    inbox = tmp_path / "in"
    inbox.mkdir()
    sheet = cue(tmp_path, [("MODE1/2352", varied(9, 7))])
    for name in ("a", "b"):
        engine.convert(spark, sheet, str(inbox / f"{name}.chd"), work=work)
        assert verify_arrivals(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("path").collect()
    assert [(os.path.basename(r["path"]), r["error"]) for r in rows] == [("a.chd", None), ("b.chd", None)]
