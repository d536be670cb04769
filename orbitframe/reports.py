"""Reports of one disc as text: what info, convert and verify print without --json.

They take the JSON objects of ``orbitframe.engine``, so both forms say the same.
"""

from __future__ import annotations

DENSE_START = 45000


def size_text(n: int) -> str:
    for unit, places, least in (("GiB", 2, 1 << 30), ("MiB", 1, 1 << 20), ("KiB", 1, 1 << 10)):
        if n >= least:
            return f"{n / least:.{places}f} {unit}"
    return f"{n} B"


def count_text(n: int, one: str) -> str:
    return f"{n} {one}{'' if n == 1 else 's'}"


def stored_text(stored: int, total: int) -> str:
    if not stored or not total:
        return size_text(stored)
    return f"{size_text(stored)} ({stored * 100 // total}% of {size_text(total)})"


def track_table(tracks: list[dict]) -> str:
    """Columns two blanks apart; FILE only where a track names one."""
    rows = [["  #", "TYPE", "LBA", "FRAMES", "SIZE"]] + [[f"  {t['number']}", t["type"], str(t["lba"]), str(t["frames"]), size_text(t["bytes"])] for t in tracks]
    if any(t.get("file") for t in tracks):
        for row, name in zip(rows, ["FILE", *(t.get("file", "") for t in tracks)]):
            row.append(name)
    wide = [max(len(r[i]) for r in rows) + 2 for i in range(len(rows[0]) - 1)]
    return "".join("".join(c.ljust(w) for c, w in zip(r, wide)) + r[-1] + "\n" for r in rows)


def info_text(d: dict) -> str:
    layout = f"GD-ROM, high-density area from LBA {DENSE_START}" if d["gdrom"] else "CD"
    rows = [
        ("name", d.get("name", "")), ("maker", d.get("maker", "")), ("product", f"{d.get('product_number', '')} {d.get('version', '')}".strip()), ("disc", d.get("disc", "")),
        ("region", ", ".join(d.get("regions", []))), ("date", d.get("release_date", "")), ("boot", d.get("boot_filename", "")), ("input", ", ".join(d.get("peripherals", []))),
        ("format", d["format"]), ("layout", layout),
    ]
    if d["format"] == "chd":
        rows += [("codec", d.get("codec", "")), ("hunks", str(d.get("hunks", 0))), ("stored", stored_text(d.get("stored_bytes", 0), d["bytes"]))]
    head = "".join(f"  {k:<7} {v}\n" for k, v in rows if v)
    return f"{d['file']}\n{head}  tracks  {len(d['tracks'])} ({size_text(d['bytes'])})\n\n" + track_table(d["tracks"])


def convert_text(d: dict) -> str:
    name = f"  Name: {d['name']}\n" if d.get("name") else ""
    return f"  Written: {d['output']} ({count_text(d['tracks'], 'track')} · {size_text(d['bytes'])})\n" + name


def verify_text(d: dict, total: int) -> str:
    """``total``: bytes of a sheet's tracks; an archive's object has its own."""
    if "raw_sha1" in d:
        out = f"  OK: {d.get('hunks', 0)} hunks, {count_text(d['tracks'], 'track')}, {size_text(d.get('logical_bytes', 0))}\n  raw SHA1       {d['raw_sha1']}\n  combined SHA1  {d['combined_sha1']}\n"
    else:
        out = f"  {count_text(d['tracks'], 'track')}, {size_text(total)}\n"
    match = d.get("redump")
    if match is None:
        return out
    if match["titles"]:
        return out + f"  redump         {', '.join(match['titles'])}\n"
    return out + f"  redump         no match ({match['tracks_known']} of {d['tracks']} tracks known)\n"
