"""Secrets in texts: patterns, and entropy in sliding windows (operator 4). DataFrame functions only.

Positions come from one split at a pattern's matches: running sums of the lengths of gaps and
matches. Candidate strings (runs of 20 and more key characters that no allow-list entry explains)
are scanned by a window of WINDOW characters. A state holds the counts of the characters in the
window, packed into a few numbers, and the sum of count x log2(count); a step adds one character,
drops one and corrects the sum, so the entropy log2(WINDOW) - sum / WINDOW costs no recount. A
candidate counts as a secret if any window reaches the threshold of its character class, and if no
pattern's span overlaps it.

No step walks a text once for each match: running sums and maxima double their reach in each of
log2(matches) passes, so a text of n characters and m matches costs about n + m log m. No pattern
repeats a group, so none recurses with the length of a match.

Defined cases: a null text counts as empty: no spans, digest of the empty string; rows may repeat
(a row each); doc_id may be null; an empty table gives no rows; other columns, whatever their names,
are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the kinds, in the order that ties are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What is long and varied but no secret: one alphabet only, numbers, UUIDs; and words joined by marks (paths, slugs).
ALLOWED = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
)
MARKS, JOINED = r"[-_/=+]+", r"^[A-Za-z]*[0-9]{0,4}$"
WINDOW = 20
#: Bits a character by class: hexadecimal digits, letters and digits of one case, all others.
THRESHOLDS = {"hex": 3.0, "one_case": 3.6, "mixed": 3.8}
#: Counts of up to 31, so many in a number; numbers for the printable characters of ASCII.
PACKED, NUMBERS = 12, 8
#: Passes of a running value: more than a text can have matches.
PASSES = 31


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], reach: int = 0) -> Column:
    """Of each place of an array, all values up to it joined."""
    if reach == PASSES:
        return values

    def wider(a: Column) -> Column:
        both = F.transform(a, lambda x, i: F.when(i >= 1 << reach, join(x, F.get(a, i - (1 << reach)))).otherwise(x))
        return F.when(F.size(a) <= 1 << reach, a).otherwise(running(both, join, reach + 1))

    return bound(values, wider)


def _add(x: Column, y: Column) -> Column:
    return x + y


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, kind, end) of a pattern's leftmost matches, code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def place(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), _add)
        spans = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), (F.lit(True) if keep is None else keep(h)).alias("keep")))
        return F.transform(F.filter(spans, lambda s: s["keep"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, empty).otherwise(place(hits)))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The most entropy (bits a character) of any window (of at most 31) of a string of printable ASCII that long or more."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32)
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    word = lambda c: F.floor(c / F.lit(PACKED)).cast("int")
    shift = lambda c: (c % PACKED * 5).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), shift(c)).bitwiseAND(F.lit(31).cast("long"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), NUMBERS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def scan(c: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves, full = F.get(c, i), F.get(c, i - window), i >= window
            more, less = count(acc["counts"], enters), count(acc["counts"], leaves)
            change = term(more + 1) - term(more) + F.when(full, term(less - 1) - term(less)).otherwise(0.0)
            total = acc["sum"] + F.when(full & (enters == leaves), 0.0).otherwise(change)
            put = lambda n, k: n + F.when(k == word(enters), one(enters)).otherwise(F.lit(0).cast("long")) - F.when(full & (k == word(leaves)), one(leaves)).otherwise(F.lit(0).cast("long"))
            bits = F.lit(math.log2(window)) - total / window
            return F.struct(F.transform(acc["counts"], put).alias("counts"), total.alias("sum"), F.when(i >= window - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), start, step, lambda acc: acc["best"])

    return bound(codes, scan)


def is_random(hit: Column) -> Column:
    """Whether a candidate passes the allow-list and reaches its class's threshold."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | hit.rlike(pattern)
    allowed = allowed | (hit.rlike(MARKS) & F.forall(F.split(hit, MARKS, -1), lambda part: part.rlike(JOINED)))
    least = F.when(hit.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(hit.rlike("[a-z]") & hit.rlike("[A-Z]"), THRESHOLDS["mixed"]).otherwise(THRESHOLDS["one_case"])
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(hit) >= least)


def _clear(more: Column, base: Column) -> Column:
    """Of the spans ``more``, those that no span of ``base`` overlaps.

    A span is overlapped if the furthest end of all base spans that start before its end lies past
    its start; so ends are a running maximum over starts and ends in order.
    """
    event = lambda at, asks, s: F.struct(at.alias("at"), F.lit(asks).alias("asks"), s.alias("span"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s["start"], 0, s)), F.transform(more, lambda s: event(s["end"] - 1, 1, s))))

    def judge(e: Column) -> Column:
        furthest = running(F.transform(e, lambda x: F.when(x["asks"] == 0, x["span"]["end"]).otherwise(0)), F.greatest)
        told = F.zip_with(e, furthest, lambda x, end: F.when((x["asks"] == 1) & (end <= x["span"]["start"]), x["span"]))
        return F.filter(told, lambda s: s.isNotNull())

    return bound(events, judge)


def _found(rows: DataFrame, text: str) -> DataFrame:
    """All columns plus ``base`` and ``spans``: sorted arrays of (start, kind, end)."""
    body = F.coalesce(F.col(text), F.lit(""))
    assign = _spans(body, ASSIGN, 0, lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= 6)
    found = rows.withColumn("base", F.array_sort(F.concat(assign, _spans(body, ACCESS, 1), _spans(body, HEX, 2))))
    found = found.withColumn("more", _spans(body, CANDIDATE, 3, is_random))
    clear = F.when(F.size("base") == 0, F.col("more")).otherwise(_clear(F.col("more"), F.col("base")))
    return found.withColumn("spans", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", clear))))


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = _found(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), "text")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", put: str = "[SECRET]") -> DataFrame:
    """Every row with its secrets replaced; overlapping spans are replaced as one.

    Columns of the input get names of their own here, so that none clashes with the helpers'.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)))
    body = f"in_{docs.columns.index(text)}"
    found = _found(own, body)

    def cleaned(chars: Column, ends: Column) -> Column:
        between = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        pieces = F.transform("spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(between(before(i), s["start"]), F.lit(put))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), between(F.element_at(ends, -1), F.size(chars)))

    ends = running(F.transform("spans", lambda s: s["end"]), F.greatest)
    clean = bound(F.split(F.col(body), ""), lambda chars: bound(ends, lambda e: cleaned(chars, e)))
    put_back = found.withColumn(body, F.when(F.size("spans") > 0, clean).otherwise(F.col(body)))
    return put_back.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
