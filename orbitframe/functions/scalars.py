"""Scalar functions of disc images, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECTOR, SLOT, HUNK_SLOTS, HDA = 2352, 2448, 8, 45000
# Bit and name of each peripheral, in the order of listing.
PERIPHERALS = (
    (12, "controller"), (13, "C button"), (14, "D button"), (15, "X button"), (16, "Y button"), (17, "Z button"), (18, "expanded directions"),
    (19, "analog R trigger"), (20, "analog L trigger"), (21, "analog horizontal"), (22, "analog vertical"), (23, "expanded analog horizontal"), (24, "expanded analog vertical"),
    (11, "VMU"), (9, "jump pack"), (10, "microphone"), (8, "other expansions"),
    (27, "mouse"), (26, "keyboard"), (25, "light gun"), (4, "VGA box"), (0, "Windows CE"),
)


def idiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def frames_as_msf(n: Column) -> Column:
    """MM:SS:FF at 75 frames a second; minutes are unbounded."""
    return F.format_string("%02d:%02d:%02d", idiv(n, 4500), idiv(n, 75) % 60, n % 75)


def msf_to_frames(m: Column, s: Column, f: Column) -> Column:
    return (m * 60 + s) * 75 + f


def parse_msf(text: Column) -> Column:
    """Frames of a timecode; null where it is none (seconds below 60, frames below 75)."""
    part = lambda i: F.get(F.split(text, ":"), F.lit(i)).try_cast("long")
    m, s, f = part(0), part(1), part(2)
    good = text.rlike(r"^-?\d+:-?\d+:-?\d+$") & (m >= 0) & s.between(0, 59) & f.between(0, 74)
    return F.when(good, msf_to_frames(m, s, f))


def quoted(line: Column) -> Column:
    """Text between the first and the last quote, or the empty string."""
    return F.regexp_extract(line, '"(.*)"', 1)


def split_fields(line: Column) -> Column:
    """Blank-separated fields; quotes protect blanks and are stripped."""
    return F.transform(F.regexp_extract_all(line, F.lit(r'("[^"]*("|$)|[^ "])+'), F.lit(0)), lambda x: F.btrim(x, F.lit('"')))


def is_audio(kind: Column) -> Column:
    return F.upper(kind) == "AUDIO"


def gdi_cue_type(code: Column) -> Column:
    return F.when(code == 0, "AUDIO").otherwise("MODE1/2352")


def track_file_name(number: Column, kind: Column) -> Column:
    return F.concat(F.format_string("track%02d.", number), F.when(is_audio(kind), "raw").otherwise("bin"))


def archive_type(kind: Column) -> Column:
    return F.when(is_audio(kind), "AUDIO").when(F.upper(kind) == "MODE2/2352", "MODE2_RAW").otherwise("MODE1_RAW")


def cue_type(kind: Column) -> Column:
    return F.when(kind == "AUDIO", "AUDIO").when(kind == "MODE2_RAW", "MODE2/2352").otherwise("MODE1/2352")


def parse_kv(text: Column) -> Column:
    """Map of KEY:VALUE fields; fields without a colon are dropped, the last duplicate wins."""
    pairs = F.transform(F.filter(F.split(F.btrim(F.regexp_replace(text, r"[\s\x00]+", " ")), " "), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(x, "^[^:]*:", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    return F.map_from_entries(last)


def align_up(n: Column, to: int) -> Column:
    return idiv(n + (to - 1), to) * to


def be_hex(n: Column, size: int) -> Column:
    """Big-endian bytes of n as hex digits."""
    return F.lower(F.lpad(F.hex(n), 2 * size, "0"))


def from_be_hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def swap_pairs(digits: Column) -> Column:
    """Hex digits with the bytes of each pair swapped; an odd last byte stays."""
    return F.regexp_replace(digits, "([0-9a-fA-F]{2})([0-9a-fA-F]{2})", "$2$1")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), F.lit("-"))


def format_bytes(n: Column) -> Column:
    unit = lambda p, d, name: F.concat(F.format_string(f"%.{d}f", F.bround(n / F.lit(float(1 << p)), d)), F.lit(f" {name}"))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(10, 1, "KiB")).when(n < 1 << 30, unit(20, 1, "MiB")).otherwise(unit(30, 2, "GiB"))


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))


def stored_percent(stored: Column, raw: Column) -> Column:
    return F.when((raw > 0) & (stored > 0), F.floor(stored * 100 / raw).cast("long"))


def release_date(text: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("yyyyMMdd")), "yyyy-MM-dd"), text)


def regions(area: Column) -> Column:
    at = lambda i, x, name: F.when(F.substring(area, i, 1) == x, name)
    return F.filter(F.array(at(1, "J", "Japan"), at(2, "U", "USA"), at(3, "E", "Europe")), lambda x: x.isNotNull())


def peripherals(digits: Column) -> Column:
    """Names of the set bits; null where the digits are no hex number of 32 bits."""
    value = F.conv(digits, 16, 10).cast("long")
    named = F.filter(F.array(*(F.when(value.bitwiseAND(F.lit(1 << bit).cast("long")) != 0, name) for bit, name in PERIPHERALS)), lambda x: x.isNotNull())
    return F.when(digits.rlike("^0*[0-9A-Fa-f]{1,8}$"), named)


def disc_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, "(?s)GD-ROM(.*)$", 1), r"^\s+|\s+$", "")


def output_format(flag: Column, path: Column) -> Column:
    """Flag, else the path's extension, else gdi."""
    known = lambda c: F.when(F.lower(c).isin("cue", "gdi", "chd"), F.lower(c))
    return F.coalesce(known(flag), known(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.lit("gdi"))


def crc16(data: Column) -> Column:
    """CRC-16 (polynomial 0x1021, start 0xFFFF) of a short binary, bit by bit; for sectors use Arrow."""
    codes = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))

    def byte(acc: Column, b: Column) -> Column:
        acc = acc.bitwiseXOR(F.shiftleft(b, 8))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), acc, lambda a, _: F.when(a.bitwiseAND(F.lit(0x8000)) != 0, F.shiftleft(a, 1).bitwiseXOR(F.lit(0x1021))).otherwise(F.shiftleft(a, 1)).bitwiseAND(F.lit(0xFFFF)))

    return F.when(F.length(data) == 0, F.lit(0xFFFF)).otherwise(F.aggregate(codes, F.lit(0xFFFF), byte))
