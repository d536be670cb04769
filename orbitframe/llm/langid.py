"""Language identification by fusing evidence (operator 8).

The posterior of a row's language is the product of
 - its text's likelihood under trigram models of the languages (trained here on at most
   ``per_language`` rows of each language, chosen by hash; the rows' labels are ``lang``),
   tempered since trigrams are not independent: beyond ``evidence`` of them their weight grows by
   the root of their number;
 - the likelihood of the declared language, from a table of declared against found languages;
 - a prior for its host, smoothed towards its address suffix, and that towards all rows.
Tables and priors are sums of the texts' own posteriors by grouped aggregation over all rows; a
row's own share is taken out of its host's sum. ``und`` is one more hypothesis, under which all
trigrams are equally likely: text of no known language. A trigram that a language has not been seen
with has the same probability in all languages, however much text each has, and ``und`` is set
relative to it. A row is rejected if ``und`` is likeliest.

Every language that ``lang`` names is modelled; a column with more than ``most_languages`` values is
no column of languages, and an error. A host that many rows share is one row of the priors; the join
with it is broadcast or, beyond Spark's own limit for that, split where it is skewed.

Defined cases: null, empty and letterless texts carry no text evidence, so the rest decides; a null
or unknown declaration, host or suffix is a value of its own; rows may repeat (a row each); an empty
table gives no rows; ``keep_known`` returns all columns it was given.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import scratch, workers

#: Words of letters alone, so that keys and numbers are no evidence.
LETTERS = re.compile(r"\b[^\W\d_]+\b")
OTHER, GONE = "und", "gone"


@dataclass(frozen=True)
class Settings:
    per_language: int = 300
    most_languages: int = 10_000
    evidence: float = 40.0
    #: Log-probability of a trigram unseen in a language, the same for all, and what ``und`` has above it.
    unseen: float = -13.0
    unknown: float = 2.5
    host_weight: float = 5.0
    suffix_weight: float = 50.0


@dataclass
class TextModel:
    """Log-likelihoods by language of each known trigram (row 0: any other)."""

    languages: list[str]
    rows: dict[str, int]
    table: np.ndarray
    settings: Settings


def trigrams(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


def fit(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> TextModel:
    rows = docs.select(F.lower(docs[lang]).alias("lang"), docs[text].alias("text"), docs[key].alias("k")).filter("lang is not null and text is not null and text <> ''")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(s.most_languages + 1).collect()
    if len(counts) > s.most_languages:
        raise ValueError(f"more than {s.most_languages} values of {lang}: no column of languages")
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.5 * s.per_language / r.n)) for r in counts], "lang string, share double")
    languages = [r.lang for r in counts]
    # The text's hash beside the id spreads rows that share an id, or have none.
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("k", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for w in LETTERS.findall(t.as_py().lower()):
                    for g in trigrams(w):
                        total[lang, g] = total.get((lang, g), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.string()), pa.array([b for _, b in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])

    found = sample.select("lang", "text").mapInArrow(work, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted(languages)
    grams = sorted({r.gram for r in found})
    at = {g: i + 1 for i, g in enumerate(grams)}
    column = {x: i for i, x in enumerate(languages)}
    seen = np.zeros((len(grams) + 1, len(languages)))
    for r in found:
        seen[at[r.gram], column[r.lang]] = r.n
    table = np.log(0.95 * seen / np.maximum(seen.sum(0), 1) + math.exp(s.unseen))
    table = np.hstack([table, np.full((len(table), 1), s.unseen + s.unknown)])
    return TextModel([*languages, OTHER], at, table, s)


class Scorer:
    #: Words kept before the table starts anew, at most.
    MOST = 200_000

    def __init__(self, model: TextModel):
        self.model, self.rows, self.vectors, self.used = model, {}, np.zeros((1024, len(model.languages) + 1)), 0
        self.most = min(self.MOST, 20_000_000 // (len(model.languages) + 1))

    def __call__(self, text: str | None) -> list[float]:
        """Tempered log-likelihood of the text by language."""
        words = LETTERS.findall((text or "").lower())
        n = len(self.model.languages)
        if not words:
            return [0.0] * n
        if self.used > self.most:
            self.rows, self.used = {}, 0
        for w in set(words).difference(self.rows):
            if self.used == len(self.vectors):
                self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
            grams = [self.model.rows.get(g, 0) for g in trigrams(w)]
            self.vectors[self.used, :n] = self.model.table[grams].sum(0)
            self.vectors[self.used, n] = len(grams)
            self.rows[w] = self.used
            self.used += 1
        total = self.vectors[list(map(self.rows.__getitem__, words))].sum(0)
        grams, evidence = total[n], self.model.settings.evidence
        return (total[:n] * (min(grams, math.sqrt(grams * evidence)) / grams)).tolist()


def likelihoods(rows: DataFrame, model: TextModel, entities: bool = False) -> DataFrame:
    """rows (key, host, suffix, declared, text) with ``ll``, an array by language, for the text; entities: those of HTML count as their characters."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.release()
        scorer = Scorer(shared.value)
        for batch in batches:
            ll = [scorer(html.unescape(t) if entities and t is not None and "&" in t else t) for t in (x.as_py() for x in batch.column(4))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ll, pa.list_(pa.float64()))], ["key", "host", "suffix", "declared", "ll"])
        del scorer
        workers.trim()

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "host", "suffix", "declared", "text").mapInArrow(work, f"key {kind}, host string, suffix string, declared string, ll array<double>")


def _softmax(ll: Column) -> Column:
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def fuse(found: DataFrame, languages: list[str], s: Settings = Settings()) -> DataFrame:
    """key, host, declared, text_lang, lang, posterior from the rows of ``likelihoods``."""
    n = len(languages)
    names = F.array(*map(F.lit, languages))
    rows = found.withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(F.lit(""))).withColumn("p", _softmax(F.col("ll")))
    sums = lambda *keys: rows.groupBy(*keys).agg(*(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)))
    vector = F.array(*(F.col(f"s{i}") for i in range(n)))
    # Declared against found: at most (languages + 1) x languages numbers.
    table = {r.declared: [r[f"s{i}"] for i in range(n)] for r in sums("declared").collect()}
    every = np.sum(list(table.values()), axis=0) if table else np.zeros(n)
    at_all = (every + 1) / (every.sum() + n)
    likely = F.lit(None).cast("array<double>")
    for name, row in table.items():
        chance = [math.log((row[i] + 1 + 9 * (languages[i] == name)) / (every[i] + 10 + len(table))) for i in range(n)]
        if name:
            likely = F.when(F.col("declared") == name, F.array(*map(F.lit, chance))).otherwise(likely)
    likely = F.coalesce(likely, F.array_repeat(F.lit(0.0), n))
    smooth = lambda own, above, weight: F.zip_with(own, above, lambda a, b: (a + weight * b) / (F.aggregate(own, F.lit(0.0), lambda x, y: x + y) + weight))
    hosts = sums("host", "suffix").withColumn("hosts", vector).drop(*(f"s{i}" for i in range(n)))
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(F.col("hosts")[i]).alias(f"s{i}") for i in range(n))).select(F.col("suffix").alias("of"), smooth(vector, F.array(*map(F.lit, at_all.tolist())), F.lit(s.suffix_weight)).alias("by_suffix"))
    priors = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("of")), "left").select(F.col("host").alias("of_host"), F.col("suffix").alias("of"), "hosts", "by_suffix")
    joined = rows.join(priors, F.col("host").eqNullSafe(F.col("of_host")) & F.col("suffix").eqNullSafe(F.col("of")), "left")
    others = F.zip_with("hosts", "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    joined = joined.withColumn("others", others).withColumn("prior", smooth(F.col("others"), F.col("by_suffix"), F.lit(s.host_weight))).withColumn("likely", likely)
    score = F.transform("ll", lambda x, i: x + F.get("likely", i) + F.log(F.get("prior", i)))
    joined = joined.withColumn("post", _softmax(score))
    best = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return joined.select("key", "host", "declared", best(F.col("p")).alias("text_lang"), best(F.col("post")).alias("lang"), F.array_max("post").alias("posterior"))


def from_pages(pages: DataFrame) -> DataFrame:
    """key, host, suffix, declared, text of web pages (page_id, url, html)."""
    page, url = F.coalesce(F.col("html"), F.lit("")), F.lower(F.coalesce(F.col("url"), F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)", 1)
    return pages.select(
        F.col("page_id").alias("key"), host.alias("host"), F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1).alias("suffix"),
        F.lower(F.regexp_extract(page, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)).alias("declared"),
        F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ").alias("text"),
    )


def identify_pages(pages: DataFrame, docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """page_id, host, declared, text_lang, lang, posterior, kept for every page."""
    model = fit(docs, s)
    found, _ = scratch.written(likelihoods(from_pages(pages), model, entities=True), "likelihoods")
    out = fuse(found, model.languages, s)
    return out.select(F.col("key").alias("page_id"), "host", "declared", "text_lang", "lang", "posterior", (F.col("lang") != OTHER).alias("kept"))


def keep_known(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents (doc_id, text, lang, source, ...) whose language is a known one, all columns.

    The column ``lang`` is the declaration, ``source`` the host; there is no address. Each row is
    decided for itself, also where doc_id is null or repeated.
    """
    model = fit(docs, s)
    # Rows of one digest agree in all that decides, so the verdict of one is that of the others.
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(x).cast("string") for x in ("doc_id", "lang", "source", "text"))]
    digest = F.sha1(F.concat(*parts))
    rows = docs.select(digest.alias("key"), F.col("source").alias("host"), F.lit("").alias("suffix"), F.lower("lang").alias("declared"), "text")
    found, found_at = scratch.written(likelihoods(rows, model), "likelihoods")
    decided, decided_at = scratch.written(fuse(found, model.languages, s).select("key", "lang"), "languages")
    # Up to a number of rows that go, the documents stay where they are.
    gone, _ = scratch.written(decided.filter(F.col("lang") == OTHER).select(F.col("key").alias(GONE)).distinct(), "gone")
    scratch.drop(docs.sparkSession, found_at, decided_at)
    own = docs.select(*(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)), digest.alias("digest"))
    kept = own.join(scratch.few(gone), F.col("digest") == F.col(GONE), "left_anti")
    return kept.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))
