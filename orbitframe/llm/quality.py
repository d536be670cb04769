"""Quality rules: a table of thresholds compiled into one projection (operator 5).

Measures are DataFrame functions of the text, rules compare a measure with limits, and the verdict
is one boolean expression; no user functions, no shuffle. Repeated five-word windows are found by
64-bit hashes within the text; only texts whose hashes repeat are sorted.

Defined cases: a null text has no words (and fails the base rule); rows may repeat (a row each);
doc_id may be null; an empty table gives no rows; other columns are ignored by ``measure`` and kept
by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space and symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages, lower case.
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "for", "de", "la", "el", "que", "en", "los", "las", "y", "un", "una", "le", "les", "des", "et", "est", "une", "der", "die", "das", "und", "den", "ist", "von", "mit", "zu")

#: name, measure, least, most; None: no limit. Ratios are by word or by line.
RULES = (
    ("length", "n_words", 10, None),
    ("repeats", "repeat_ratio", None, 0.2),
    ("word length", "mean_word", 1.5, 25.0),
    ("symbols", "symbol_ratio", None, 0.4),
    ("lines", "dup_line_ratio", None, 0.5),
    ("stop words", "stop_ratio", 0.005, None),
    ("capitals", "capital_ratio", None, 0.6),
)


def compile_rules(rules=RULES) -> Column:
    """One boolean: every measure is within its limits (a measure that is null passes)."""
    verdict = F.lit(True)
    for _, measure, least, most in rules:
        if least is not None:
            verdict = verdict & F.coalesce(F.col(measure) >= least, F.lit(True))
        if most is not None:
            verdict = verdict & F.coalesce(F.col(measure) <= most, F.lit(True))
    return verdict


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns plus the measures and ``base_failed`` and ``kept``."""
    given = docs.columns
    a = docs.withColumn("_body", F.coalesce(docs[text], F.lit("")))
    a = a.withColumn("_trim", F.btrim("_body", F.lit(SPACE)))
    a = a.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", "[ \\t-\\r]+")))
    a = a.withColumn("n_words", F.size("_words").cast("long")).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    at = lambda i: F.get("_h", i)
    a = a.withColumn("_grams", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int")), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4)))).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_grams")) < F.size("_grams")
    a = a.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    twin = lambda s, j: (F.get("_sorted", j - 1)["g"] == s["g"]) | (F.get("_sorted", j + 1)["g"] == s["g"])
    a = a.withColumn("_hot", F.array_sort(F.filter(F.transform("_sorted", lambda s, j: F.when(twin(s, j), s["i"])), lambda i: i.isNotNull())))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("_hot", zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    lines = F.filter(F.split("_body", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    a = a.withColumn("_lines", lines)
    without = lambda c, marks: F.length(c) - F.length(F.translate(c, marks, ""))
    a = a.select(
        *given, "n_words",
        (F.length("_body") - without(F.col("_body"), SPACE)).cast("long").alias("word_chars"),
        without(F.col("_body"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
        without(F.col("_body"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        # Keeps the optimizer from copying the measures' expressions into a filter on the verdict.
        F.monotonically_increasing_id().alias("_barrier"),
    )
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y))
    a = a.withColumns({
        "repeat_ratio": ratio("n_repeat_words", "n_words"), "mean_word": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "stop_ratio": F.when(F.col("n_words") >= 50, F.col("n_stop") / F.col("n_words")), "capital_ratio": ratio("n_capitals", "word_chars"),
    })
    a = a.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return a.withColumn("kept", ~F.col("base_failed") & compile_rules())


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = with_measures(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(m for _, m, *_ in RULES if m.endswith("ratio") or m == "mean_word"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that every rule lets pass, with their own columns.

    Measures get names of their own here, so that columns of the input may share them.
    """
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)))
    kept = with_measures(renamed, f"in_{docs.columns.index(text)}").filter("kept and _barrier >= 0")
    return kept.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
