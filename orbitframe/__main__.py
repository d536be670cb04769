"""python -m orbitframe convert|info|verify: the commands of orbitframe.engine."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession, functions as F

from . import engine, progress, reports
from .operators import layout as L
from .sources import catalogue as K

# Fixed value: where the catalogue of --redump is.
CATALOGUE = "http://redump.org/datfile/dc/"
CACHE = os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "orbitframe")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="orbitframe", description="Convert, describe and verify disc images.")
    p.add_argument("--json", action="store_true", help="write JSON")
    p.add_argument("--work", help="a folder that all executors share")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="convert a disc to another format")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--to", "-t", choices=engine.FORMATS)
    c.add_argument("--force", action="store_true", help="replace what is there")
    c.add_argument("--codec", default="cdzl,cdfl", choices=["cdzl", "cdzl,cdfl"])
    i = sub.add_parser("info", help="describe a disc")
    i.add_argument("path")
    v = sub.add_parser("verify", help="check a disc's digests")
    v.add_argument("path")
    which = v.add_mutually_exclusive_group()
    which.add_argument("--dat", help="a catalogue to match tracks against")
    which.add_argument("--redump", action="store_true", help="fetch the current catalogue, and keep it")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, opener: K.Opener | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("orbitframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out, text = run(spark, a, opener or K.web("orbitframe/1"))
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("cancelled", file=sys.stderr)
        return 130
    print(json.dumps(out, indent=2, ensure_ascii=False) if a.json else text, end="\n" if a.json else "")
    return 0


def run(spark: SparkSession, a: argparse.Namespace, opener: K.Opener) -> tuple[dict, str]:
    """What a command says, as an object and as text."""
    bars = None if a.json else sys.stdout
    if a.command == "convert":
        return converted(spark, a, bars)
    path, fmt = engine.detect(a.path)
    if a.command == "info":
        with progress.step(spark, "Reading image"):
            discs, tracks = engine.describe(spark, path, fmt)
            found = json.loads(engine.as_json(discs, tracks).first()["json"])
        return found, reports.info_text(found)
    dat, version, total = None, None, 0
    if a.dat or a.redump:
        file = a.dat or K.fetched(CATALOGUE, CACHE, opener, lambda text: None if a.json else print(text))
        dat, version = K.read_catalogue(spark, file), K.catalogue_version(spark, file)
    with progress.step(spark, "Reading CHD" if fmt == "chd" else "Hashing tracks", bars):
        found = engine.verify_json(engine.verify(spark, path, fmt, dat, a.work), version).first()
        if fmt != "chd":
            total = L.with_bytes(engine.layout(spark, path, fmt)).agg(F.sum("bytes")).first()[0]
    if found["error"]:
        raise ValueError(f"{os.path.basename(path)}: {found['error']}")
    report = json.loads(found["json"])
    return report, f"Verifying {os.path.basename(path)}\n" + reports.verify_text(report, total)


def converted(spark: SparkSession, a: argparse.Namespace, bars) -> tuple[dict, str]:
    source, _ = engine.detect(a.input)
    with progress.step(spark, "Converting", bars):
        done = engine.convert(spark, a.input, os.path.abspath(a.output), a.to, a.codec, a.force, a.work)
    out = {"output": done["path"], "format": a.to or os.path.splitext(done["path"])[1][1:].lower(), "tracks": done["tracks"], "bytes": done["bytes"]}
    if out["format"] == "gdi":
        try:
            out["name"] = engine.write_name(spark, done["path"])
        except (ValueError, OSError) as e:
            print(f"  warning: could not write name.txt: {e}", file=sys.stderr)
    return out, f"Converting {os.path.basename(source)}\n" + reports.convert_text(out)


if __name__ == "__main__":
    sys.exit(main())
