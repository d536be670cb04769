"""Catalogues of known discs: XML of games and their files, fetched, and a cache of them."""

from __future__ import annotations

import io
import os
import tempfile
import urllib.request
import zipfile
from collections.abc import Callable
from email.message import Message

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "_name string, rom array<struct<_name: string, _sha1: string>>"
MOST_BYTES = 64 << 20
#: Seconds that a request may take.
PATIENCE = 60

#: (method, address) -> (headers, body); any failure is an OSError.
Opener = Callable[[str, str], tuple[Message, bytes]]


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(title, rom, sha1) of all files but sheets; games of one name come together.

    A file without a digest has the empty one: it counts in its game and matches nothing. No game
    with files beside sheets is an error.
    """
    games = spark.read.format("xml").option("rowTag", "game").schema(SCHEMA).load(path)
    roms = games.select(F.coalesce("_name", F.lit("")).alias("title"), F.explode("rom").alias("r"))
    roms = roms.select("title", F.col("r._name").alias("rom"), F.lower(F.coalesce("r._sha1", F.lit(""))).alias("sha1"))
    roms = roms.filter(~F.lower(F.coalesce("rom", F.lit(""))).endswith(".cue"))
    if roms.isEmpty():
        raise ValueError(f"{path}: no games with digests of tracks, not a catalogue")
    return roms


def catalogue_version(spark: SparkSession, path: str) -> str:
    """The version in a catalogue's header, or the empty string."""
    heads = spark.read.format("xml").option("rowTag", "header").schema("version string").load(path).take(1)
    return heads[0]["version"] or "" if heads else ""


def web(agent: str) -> Opener:
    """An opener of plain HTTP."""

    def opened(method: str, address: str) -> tuple[Message, bytes]:
        request = urllib.request.Request(address, method=method, headers={"User-Agent": agent})
        with urllib.request.urlopen(request, timeout=PATIENCE) as reply:  # noqa: S310 - the caller names the address
            if reply.status != 200:
                raise OSError(f"{address}: status {reply.status}")
            return reply.headers, b"" if method == "HEAD" else reply.read(MOST_BYTES)

    return opened


def build_of(headers: Message) -> str:
    """The build that a download's file name tells of, as a slug."""
    name = (headers.get_filename() or "").removesuffix(".zip")
    if not name:
        raise OSError("the download has no name, so its build is unknown")
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in name).split()
    return "-".join(words)


def fetched(address: str, folder: str, opener: Opener, notice: Callable[[str], None] = lambda _: None) -> str:
    """A catalogue's path in the cache; downloaded only where the address has a build that the cache lacks.

    Where the address can't be asked, the newest cached one serves. Nothing proves a catalogue authentic.
    """
    try:
        build = build_of(opener("HEAD", address)[0])
    except OSError:
        if cached := newest(folder):
            return cached
        raise
    target = os.path.join(folder, f"{build}.dat")
    if os.path.exists(target):
        return target
    notice(f"Fetching {address}")
    return stored(unzipped(opener("GET", address)[1]), folder, build)


def unzipped(body: bytes) -> bytes:
    """The first .dat member of a zip, at most MOST_BYTES of it."""
    try:
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            member = next((m for m in z.infolist() if m.filename.lower().endswith(".dat")), None)
            if member is None:
                raise ValueError("the download holds no catalogue")
            with z.open(member) as f:
                return f.read(MOST_BYTES)
    except zipfile.BadZipFile as e:
        raise ValueError(f"the download is no zip: {e}") from e


def stored(data: bytes, folder: str, build: str) -> str:
    """``data`` as ``build``.dat; older catalogues of the folder go."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"{build}.dat")
    fd, staged = tempfile.mkstemp(suffix=".part", dir=folder)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(staged, target)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    for other in os.listdir(folder):
        if other.endswith(".dat") and other != os.path.basename(target):
            try:
                os.remove(os.path.join(folder, other))
            except OSError:
                pass  # an old one that stays does no harm
    return target


def unpacked(archive: str, folder: str, build: str) -> str:
    """A downloaded zip's catalogue, stored as ``build``.dat."""
    with open(archive, "rb") as f:
        return stored(unzipped(f.read()), folder, build)


def newest(folder: str) -> str | None:
    """The latest cached catalogue, or None."""
    found = [os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".dat")] if os.path.isdir(folder) else []
    return max(found, key=os.path.getmtime, default=None)
