"""The corpus operators against libraries, brute force and round trips."""

import base64
import collections
import hashlib
import random
import re
import time
import types
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitframe.llm import bpe, chunked, classifier, graph, jaccard, langid, packing, quality, queries, scratch, secrets, sharding, token_ids, vectors

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a  b", "it's we'll 'sabc", "a\n\nb \n c\t d", "İ ΣΑΣ <|endoftext|> x", "a\x1cb\x85c\xa0d", "  lead", "trail ", "ÀÉ\nÿ", "x" * 5000, "the the the", "one two three four five six", "a\0b", "end\n", "<|startoftext|>A <|ENDOFTEXT|>"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n long, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns."""
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None, "x", 1, "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[2], rows[12], (None, "no id here at all", "en", "s", 1, "x", 1, "y")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def library(path):
    """The library itself, not the instance that the operators keep."""
    return Tokenizer.from_file(path)


def ids_of(words, texts):
    out = []
    for ids, number in words(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(number)[:-1])]
    return out


@pytest.mark.parametrize("name,blank", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_equal_whole_texts(name, blank):
    rng = random.Random(3)
    mixed = ["".join(rng.choices("aB é.,\n\t'0<|ß中 \x85-", k=rng.randrange(40))) for _ in range(3000)]
    t = library(P.path(name))
    for texts in (ODD, mixed):
        want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert ids_of(chunked.library_words(P.path(name), blank), texts) == want


def test_strings_of_added_tokens():
    texts = ["a <|endoftext|> b", "<|startoftext|>A", "x<|endoftext|>", "<|ENDOFTEXT|> plain", "<|endoftext"]
    for name, blank, ids in (("word_bpe_49k.json", False, {49406, 49407}), ("byte_bpe_50k.json", True, {50256})):
        got = ids_of(chunked.library_words(P.path(name), blank), texts)
        assert got == [e.ids for e in library(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        assert ids & set(got[0]) and ids & set(got[2]) and not ids & set(got[3] + got[4])


def test_table_that_overflows():
    w = chunked.library_words(P.path("byte_bpe_50k.json"), True)
    w.most = 50
    texts = [f"word{i} other{i}, the\nnext{i}." for i in range(300)]
    want = [e.ids for e in library(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert [x for at in range(0, 300, 30) for x in ids_of(w, texts[at : at + 30])] == want


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (token_ids.unpack(*token_ids.pack(x), n) == x).all()


def test_token_ids(odd, empty):
    path = P.path("word_bpe_49k.json")
    got = sorted((r for r in token_ids.round_trip(odd, path, 2).collect()), key=lambda r: r.start)
    t = library(path)
    want = collections.Counter()
    for d, x in texts_of(odd):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    assert token_ids.round_trip(empty, path, 2).count() == 0


def test_shards(odd, empty):
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == odd.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id in (0, 1)}) == 1  # null and empty are one group
    assert sharding.shard_documents(empty, 4).count() == 0
    assert sharding.schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


def longest_first(sizes, shards):
    """Loads of plain longest-processing-time scheduling."""
    loads = [0] * shards
    for x in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += x
    return loads


@pytest.mark.parametrize("fine", [1024, 4])
def test_shards_equal_brute_force(spark, monkeypatch, fine):
    """fine 1024: every group is scheduled by itself; 4: most go by bundles."""
    monkeypatch.setattr(sharding, "FINE", fine)
    rng = random.Random(6)
    texts = ["x" * rng.randrange(1, 400) + str(rng.randrange(30)) for _ in range(300)] + ["hot" * 40] * 60 + [None, "", ""]
    rows = [(None if i % 3 else i, t) for i, t in enumerate(texts)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.size, r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in groups.values())
    loads = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    whole = collections.Counter()
    for _, t in rows:
        whole[t or ""] += size(t)
    want = longest_first(whole.values(), 5)
    if fine == 1024 and all(x >= sum(want) / (5 * fine) for x in whole.values()):
        assert sorted(loads) == sorted(want)
    # No shard differs from another by more than the largest item.
    bundle = 2 * max(sum(want) / (5 * fine), max(whole.values()))
    assert max(loads) - min(loads) <= bundle and {r.law for r in got} == {"bytes"}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * 0.03 * (i >= 60)).tolist(), int(i % 60 % 2), "c") for i in range(240)]
    rows += [(1000, None, 0, "c"), (1001, [0.0] * 16, 0, "c"), (1002, [float("nan")] * 16, 0, "c"), (1003, base[0].tolist(), None, "c"), (1004, base[0].tolist(), 0, "c"), (1005, base[0].tolist(), 0, "c"), (1006, [], 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df, vectors.Settings(cell=40)).collect()}
    check_vectors(got, rows)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (1000, 1001, 1002, 1003, 1006))
    assert got[1005].component_id == 0 and got[1005].n_links == got[1004].n_links
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def check_vectors(got, rows):
    """Each row against brute force."""
    good = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and np.any(r[1])]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good]))
    np.fill_diagonal(link, False)
    least = list(range(len(good)))
    for _ in good:
        new = [min([least[i], *(least[j] for j in np.flatnonzero(link[i]))]) for i in range(len(good))]
        if new == least:
            break
        least = new
    names = [r[0] for r in good]
    smallest = [min(n for n, z in zip(names, least) if z == y) for y in least]
    assert link.sum() > 0
    assert [got[n].n_links for n in names] == link.sum(1).tolist()
    assert [got[n].component_id for n in names] == smallest
    assert all(r.kept == (r.vec_id == r.component_id) and r.audit_recall >= 0.95 for r in got.values())


@pytest.mark.parametrize("most", [4000, 60])
def test_vectors_across_cells(spark, most):
    """Tight groups larger than a point's candidates, loose pairs, chains; most 60: large cells go block against block."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 24))
    rows = []
    for g in range(40):
        for _ in range(100 if g < 3 else 5):
            rows.append((len(rows), (base[g] + rng.normal(size=24) * 0.05).tolist(), g % 2, "c"))
    turn = rng.normal(size=24)
    for i in range(30):  # a chain: neighbours link, ends do not
        rows.append((len(rows), (np.cos(i * 0.15) * base[0] / np.linalg.norm(base[0]) + np.sin(i * 0.15) * turn / np.linalg.norm(turn)).tolist(), 0, "c"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    check_vectors({r.vec_id: r for r in vectors.near_duplicates(df, vectors.Settings(cell=50, most_points=most)).collect()}, rows)


def one_by_one(points, starts, lists, s):
    """Each query's search alone, step by step."""
    start, floor = vectors.medoids(points, s.medoids), s.least - s.slack
    for q in range(len(points)):
        seen = np.zeros(len(points), bool)
        seen[start] = True
        ids, sims, done = start, points[start] @ points[q], np.zeros(len(start), bool)
        while True:
            order = np.argsort(-sims, kind="stable")
            ids, sims, done = ids[order], sims[order], done[order]
            width = max(s.beam, int(np.searchsorted(-sims, -floor, "right")))
            ids, sims, done = ids[:width], sims[:width], done[:width]
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            inside = todo[sims[todo] >= floor]
            take = inside if len(inside) else todo[:4]
            done[take] = True
            new = np.unique(np.concatenate([lists[starts[i] : starts[i + 1]] for i in ids[take].tolist()]))
            new = new[~seen[new]]
            seen[new] = True
            ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, points[new] @ points[q]]), np.concatenate([done, np.zeros(len(new), bool)])
        yield from ((q, i) for i in ids[sims >= s.least - 1e-5].tolist())


@pytest.mark.parametrize("beam", (2, 24))
def test_vectors_searched_together(beam):
    """The same pairs as one query after the other finds, each once, in less than two thirds of its time."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1500, 48))
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 48)) * 0.08, base[0] + rng.normal(size=(200, 48)) * 0.08]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = vectors.Settings(beam=beam)
    for points in (x, x[:1], x[:3], x[-200:]):
        starts, lists = vectors.build_graph(points, s)
        began = time.process_time()
        want = list(one_by_one(points, starts, lists, s))
        alone, began = time.process_time() - began, time.process_time()
        got = [pair for q, p in vectors.range_search(points, starts, lists, np.arange(len(points)), s) for pair in zip(q.tolist(), p.tolist())]
        together = time.process_time() - began
        assert sorted(got) == sorted(want)
        assert len(points) < len(x) or together < alone / 1.5
    many = vectors._unseen(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([0, 3, 5]), np.array([0, 1, 1, 0, 1]), 2, np.array([True, False, False, False]), np.zeros(4, np.int32), most=2)
    assert sorted(many.tolist()) == [1, 2, 3]


def test_secrets(spark, odd, empty):
    key = "Zx9" + "aB3kQ7wLp0RtY5uMn2VsE8dF"
    text = f"id {key} and password= 'hunter2hunter' token: ab AKIA{'Q' * 16} {'0af3' * 8}"
    df = spark.createDataFrame([(1, text), (2, None), (3, "just-a-long-slug-of-many-words 550e8400-e29b-41d4-a716-446655440000")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 1)
    at = text.index(key)
    assert f"entropy:{at}:{at + len(key)}" in got[1].spans
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert key not in clean[1] and "hunter2" not in clean[1] and clean[2] is None
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.redact(empty).count() == 0


def python_secrets(text):
    """Base spans by Python's re, as (start, kind, end)."""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secrets_equal_re(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rng = random.Random(8)
    mixed = ["".join(rng.choices(["token=", "AKIA", "SECRET : ", "deadbeef", "0123", "A1b2C3", " ", "\n", "é𝄞", "api_key='", "password", "=", "XYZ"], k=60)) for _ in range(300)]
    docs = docs.union(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(mixed)], docs.schema))
    texts = dict(texts_of(docs))
    for r in secrets.find_secrets(docs).collect():
        want = python_secrets(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        extra = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("entropy")]
        assert len(extra) == len([x for x in r.spans.split(",") if x]) - len(want)
        assert not any(a < e and s < b for a, b in extra for s, _, e in want)


def test_secrets_in_very_long_texts(spark):
    rng = random.Random(4)
    base64ish = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    many = "token=abc123 x " * 40_000
    texts = {1: base64ish, 2: "a1-" * 350_000 + "b12345", 3: many, 4: "é" * 100_000 + " AKIA" + "Q" * 16}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert got[1].spans == "entropy:0:1000000" and got[2].spans == "" and got[3].n_assign == 40_000
    assert got[3].base_sha256 == hashlib.sha256(",".join(f"assign:{s}:{e}" for s, _, e in python_secrets(many)).encode()).hexdigest()
    assert got[4].spans == "access:100001:100021"
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean == {1: "[SECRET]", 2: texts[2], 3: "[SECRET] x " * 40_000, 4: "é" * 100_000 + " [SECRET]"}


def test_redact_keeps_columns_of_any_name(spark):
    schema = "doc_id long, text string, base string, spans string, more string, _base string, _spans string, _more string, in_0 string, `a.b` string"
    rows = [(1, "password=hunter2x é", *"abcdefgh"), (None, None, *"abcdefgh"), (1, "password=hunter2x é", *"abcdefgh")]
    got = secrets.redact(spark.createDataFrame(rows, schema))
    assert got.columns[-1] == "a.b"
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((d, t and "[SECRET] é", *rest) for d, t, *rest in rows)


def test_window_entropy(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choices("abcdef0123XYZ", k=n)) for n in (20, 21, 40, 200)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(secrets.window_entropy(F.col("t"))).collect()]
    for x, g in zip(rows, got):
        best = max(-sum(c / 20 * np.log2(c / 20) for c in collections.Counter(x[i : i + 20]).values()) for i in range(len(x) - 19))
        assert abs(best - g) < 1e-9


def test_quality(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    seen = collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.measure(docs).collect())
    want = collections.Counter()
    for _, x in texts_of(docs):
        w = re.findall("[^\x20\x09-\x0d]+", x)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = collections.Counter(g)
        hot = {j for i, k in enumerate(g) if c[k] > 1 for j in range(i, i + 5)}
        lines = [y for y in x.split("\n") if re.search("[^\x20\x09-\x0d]", y)]
        want[len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), len(lines) - len(set(lines)), len(hot), len(w) < 10 or 100 * len(hot) > 20 * len(w)] += 1
    assert seen == want
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0


def test_classifier(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.9
    assert all(0 <= r.score <= 1 for r in classifier.score(odd, model).collect())
    assert classifier.fit(empty, labels.limit(0)).bias == 0


def brute(rows):
    sets = []
    for d, x in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def test_jaccard(spark, odd, empty):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        n = rng.choice([3, 6, 8, 12, 20, 40, 90])
        words = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(rng.randrange(1, 30)):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, n // 10) + 1)):
                copy[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame([(*r, "en", "s", 1, "x", 1, "y") for r in rows], SCHEMA).union(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect())
    assert got == brute(texts_of(df))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 1000) == sorted({c for d, n, c in got if d is not None and d < 1000})
    assert jaccard.join_documents(empty).count() == 0


def test_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(words)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_documents(df).collect()) == brute(rows)


def test_common_shingles_change_nothing(monkeypatch):
    """A shingle of many sets goes to its range as one entry a chunk; what comes back is the same."""
    monkeypatch.setattr(jaccard, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 5)))
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(20)]
    docs = [" ".join([f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))] + passage * (i % 3 == 0)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(docs), pa.array(range(400))], ["a", "b", "c"])

    def sets(many):
        rows = sorted((tuple(r.values()) for x in jaccard._pack_lists(4, many)(iter([batch])) for r in x.to_pylist()), key=lambda r: r[:2])
        size, t = sum(len(r[3]) for r in rows if r[0] >= 0), jaccard._rows(rows)
        back = sorted((tuple(r.values()) for x in jaccard._count_lists(iter([t.slice(0, 7), t.slice(7)])) for r in x.to_pylist()), key=lambda r: (r[1], r[0]))
        found = [tuple(r.values()) for x in jaccard._collect_sets(4)(iter([jaccard._rows(back)])) for r in x.to_pylist()]
        return sorted(found, key=lambda r: r[0]), size

    for chunk in (60_000, 37):
        monkeypatch.setattr(jaccard, "CHUNK_DOCS", chunk)
        want, size = sets(10**9)
        assert len(want) == 400
        for many in (2, 3, 10):
            got, less = sets(many)
            assert got == want and less < size


def test_many_near_copies_make_few_links(spark, monkeypatch):
    """5,000 near copies of one text: links and checks grow with the copies, not with their pairs."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(5000):
        copy = list(words)
        copy[rng.randrange(80)] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(copy)))
    checked, linked = [], []
    pairs, components = jaccard._checked, graph.components

    def counted(p, sets):
        checked.append(p.count())
        return pairs(p, sets)

    def seen(links):
        linked.append(links.count())
        return components(links)

    monkeypatch.setattr(jaccard, "_checked", counted)
    monkeypatch.setattr(jaccard.graph, "components", seen)
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 5000
    assert sum(checked) <= 3 * 5000 and sum(linked) <= 2 * 5000


def test_repeated_rows_and_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    schema = "doc_id long, text string, comp long, node string, `_id` long, `_hash` long, `_at` int, hash long, id long, digest string, gone string"
    tail = (1, "n", 2, 3, 4, 5, 6, "d", "g")
    rows = [(7, text, *tail), (7, text, *tail), (9, text + " eleven", *tail), (None, text, *tail), (None, "", *tail), (None, "", *tail), (3, "quite another text of some more than five words", *tail)]
    df = spark.createDataFrame(rows, schema)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {7: 1, None: 2, 3: 1}
    known = langid.keep_known(df.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")))
    assert known.columns[: len(df.columns)] == df.columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), docs).collect()
    assert np.mean([r.lang == r.declared for r in got]) > 0.9
    kept = langid.keep_known(docs.withColumn("extra", F.lit(1)))
    assert kept.columns[-1] == "extra" and kept.count() >= 0.98 * docs.count()
    assert langid.keep_known(empty).count() == 0 and langid.keep_known(odd).columns == odd.columns


GIBBERISH = ["".join(random.Random(11).choices("abcdefghijklmnopqrstuvwxyz" + " " * 5, k=600)), "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw " * 3, "Все люди рождаются свободными и равными в своем достоинстве и правах " * 3]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_unknown_languages_are_rejected_at_all_sizes(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rare = "Suomen kieli on itämerensuomalainen kieli jota puhutaan pääosin Suomessa ja Ruotsissa"
    model = langid.fit(docs.union(spark.createDataFrame([(10**7 + i, f"{rare} {i}", "fi", "s") for i in range(3)], docs.schema)))
    assert "fi" in model.languages and len(set(model.table[0, :-1].tolist())) == 1
    scorer = langid.Scorer(model)
    best = lambda x: model.languages[int(np.argmax(scorer(x)))]
    assert [best(x) for x in GIBBERISH] == [langid.OTHER] * 3
    assert best(rare) == "fi"
    own = docs.filter("lang = 'es' and length(text) > 200").orderBy("doc_id").limit(20).collect()
    assert sum(best(r.text) == "es" for r in own) >= 0.9 * len(own) > 0


def test_rows_are_kept_each_for_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").filter("length(text) > 200").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    junk = spark.createDataFrame([(k, x, None, "s") for k in (None, 1, 50) for x in GIBBERISH], docs.schema)
    # One row's text is rejected; rows that share its doc_id stay.
    kept = collections.Counter(map(tuple, langid.keep_known(docs.union(junk)).collect()))
    assert kept == collections.Counter(map(tuple, langid.keep_known(docs).collect()))
    assert kept.total() >= 0.98 * docs.count()


def test_packing(spark, odd, empty):
    path = P.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text").filter("doc_id is not null").dropDuplicates())
    rows = packing.pack_documents(docs, path).collect()
    t = library(path)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    texts = texts_of(docs)
    assert set(pieces) == {d for d, _ in texts} and len(pieces) == len(texts)
    for d, x in texts:
        ids, at = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    padding = 0
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(r.length for r in rows)
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.pack_documents(odd, path).filter("doc_id is null").count() > 0


def test_every_sentence_end_is_a_cut():
    ids = np.zeros(400, np.int64)
    stops = [*range(5, 200, 5), 300]
    ids[[x - 1 for x in stops]] = 1
    cuts, penalty = packing.cut_points(ids, np.array([200, 201, 400]), np.array([False, True]))
    got = dict(zip(cuts.tolist(), penalty.tolist()))
    assert {x for x, k in got.items() if k == packing.AT_SENTENCE} == set(stops)
    assert {x for x, k in got.items() if k == 0} == {200, 201, 400}
    assert {x for x, k in got.items() if k == packing.IN_SENTENCE} == {*range(225, 300, 24), *range(324, 400, 24)}
    assert cuts.tolist() == sorted(got) and len(got) == len(cuts)
    # The window can end at the second of two sentences' ends that are close together.
    ids = np.zeros(60, np.int64)
    ids[[33, 39]] = 1
    assert packing.choose(*packing.cut_points(ids, np.array([60]), np.array([False, True])), 45).tolist() == [40, 60]


@pytest.mark.parametrize("size,least", [(10, 1), (16, 4), (64, 1), (64, 16), (100, 8), (128, 64)])
def test_choose_is_optimal(size, least):
    rng = np.random.default_rng(size)
    cost = lambda length: 0 if length == size or length >= least and length & (length - 1) == 0 else size - length
    for _ in range(60):
        n = int(rng.integers(1, 250))
        pos, pen = [0, *np.cumsum(rng.integers(1, rng.integers(2, max(3, size // 3)), n)).tolist()], [0, *rng.choice([0, 2, 2, 2, 12], n).tolist()]
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            for i in range(j):
                if pos[j] - pos[i] <= size:
                    best[j] = min(best[j], best[i] + cost(pos[j] - pos[i]) + pen[j])
        ends = packing.choose(np.array(pos[1:]), np.array(pen[1:]), size, least).tolist()
        assert ends[-1] == pos[-1] and all(0 < b - a <= size for a, b in zip([0, *ends], ends))
        assert best[-1] == sum(cost(b - a) + pen[pos.index(b)] for a, b in zip([0, *ends], ends))


def test_bpe(spark, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd, path, P.PATTERN).collect())
    want = collections.Counter()
    for d, x in texts_of(odd):
        ids = np.array(lib.encode_ordinary(x), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_digests(empty, path, P.PATTERN).count() == 0


def brute_languages(rows):
    """The language of each (text, lang, source), by the documented formula."""
    letters, seen = re.compile(r"\b[^\W\d_]+\b"), {}
    grams = lambda text: [f" {w} "[i : i + 3] for w in letters.findall((text or "").lower()) for i in range(len(w))]
    for text, lang, _ in rows:
        if text and lang:
            seen.setdefault(lang.lower(), collections.Counter()).update(grams(text))
    names = sorted(seen)
    total = {x: max(1, sum(seen[x].values())) for x in names}
    every_name = [*names, "und"]
    likely = []
    for text, _, _ in rows:
        g = grams(text)
        sums = np.array([sum(np.log(0.95 * seen[x][y] / total[x] + np.exp(-13.0)) for y in g) for x in names] + [-10.5 * len(g)])
        likely.append(sums * (min(len(g), (40 * len(g)) ** 0.5) / len(g)) if g else sums * 0)
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    p = np.array([soft(v) for v in likely])
    declared = [x.lower() if x and x.lower() in every_name else "" for _, x, _ in rows]
    table = {d: p[[i for i, x in enumerate(declared) if x == d]].sum(0) for d in set(declared)}
    every = p.sum(0)
    at_all = (every + 1) / (every.sum() + len(every))
    by_suffix = (every + 50 * at_all) / (every.sum() + 50)
    out = []
    for i, (_, _, host) in enumerate(rows):
        own = p[[j for j, r in enumerate(rows) if r[2] == host]].sum(0)
        others = np.maximum(own - p[i], 0)
        prior = (others + 5 * by_suffix) / (others.sum() + 5)
        d = declared[i]
        told = np.log((table[d] + 1 + 9 * (np.array(every_name) == d)) / (every + 10 + len(table))) if d else 0
        out.append(every_name[int(np.argmax(likely[i] + told + np.log(prior)))])
    return out


def brute_good(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if len(words) < 10:
        return False
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(grams)
    hot = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    chars = sum(map(len, words))
    stop = sum(w.lower() in quality.STOP_WORDS for w in words) / len(words)
    ok = 100 * len(hot) <= 20 * len(words) and len(hot) / len(words) <= 0.2 and 1.5 <= chars / len(words) <= 25 and sum(c in "#*$%&|<>" for c in text) / len(words) <= 0.4
    return ok and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and (len(words) < 50 or stop >= 0.005) and sum("A" <= c <= "Z" for c in text) / chars <= 0.6


def brute_redacted(text):
    spans = [(s, e) for s, _, e in python_secrets(text)]
    base = list(spans)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        hit = m[0]
        joined = re.search("[-_/=+]", hit) and all(re.fullmatch("[A-Za-z]*[0-9]{0,4}", x) for x in re.split("[-_/=+]+", hit))
        if re.fullmatch("[A-Za-z+/_=-]+|[0-9+/_=-]+|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", hit) or joined:
            continue
        least = 3.0 if re.fullmatch("[0-9a-fA-F]+", hit) else 3.8 if re.search("[a-z]", hit) and re.search("[A-Z]", hit) else 3.6
        best = max(-sum(c / 20 * np.log2(c / 20) for c in collections.Counter(hit[i : i + 20]).values()) for i in range(len(hit) - 19))
        if best >= least and not any(s < m.end() and m.start() < e for s, e in base):
            spans.append((m.start(), m.end()))
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "rules", "near_duplicates", "no_secrets", "pack"]
    rng = random.Random(21)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 60]
    for i, (_, text, lang, source) in enumerate(long[:12]):  # near copies, secrets, text of no known language
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((10**6 + i, " ".join(words), lang, source))
    for d, text, lang, source in long[12:30]:
        rows[rows.index((d, text, lang, source))] = (d, f"{text} password = hunter{d}hunter key Zx9aB3kQ7wLp0RtY5uMn2Vs{d}E8dF end", lang, source)
    rows += [(3 * 10**6 + i, x, None, "src1") for i, x in enumerate(GIBBERISH)]
    docs = [(d, t, x, s, len(t or "")) for d, t, x, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r, x in zip(rows, brute_languages([(t, x, s) for _, t, x, s in rows])) if x != "und"]
    assert not {r[0] for r in kept} & {3 * 10**6, 3 * 10**6 + 1, 3 * 10**6 + 2} and len(kept) >= 0.97 * len(rows)
    kept = [r for r in kept if brute_good(r[1])]
    named = {(d, n): c for d, n, c in brute([(d, t or "") for d, t, _, _ in kept])}
    least = {d: c for (d, _), c in named.items()}
    kept = [r for r in kept if least[r[0]] == r[0]]
    want = {r[0]: brute_redacted(r[1]) for r in kept}
    assert sum("[SECRET]" in x for x in want.values()) >= 5
    t = library(P.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for d, text in want.items():
        ids, at = np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(got[d], key=lambda r: r.start):
            assert r.start == at
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids) == got[d][0].doc_tokens


def test_pipeline_stages_keep_columns(spark, odd):
    import corpus_pipeline

    assert set(queries.queries()) >= {"pipeline", "op1_token_ids", "op10_byte_bpe"} and set(queries.oracle_sql()) == {"op4_secret_scan", "op5_quality_rules"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name


def test_tables_of_a_step_are_dropped(spark):
    import os

    mark = scratch.mark()
    _, a = scratch.written(spark.range(3), "a")
    _, b = scratch.written(spark.range(3), "b")
    scratch.drop_since(spark, mark, b)
    assert not os.path.exists(a.removeprefix("file:").replace("//", "/")) and os.path.exists(b.removeprefix("file:").replace("//", "/"))
    scratch.drop(spark, b)


def test_sql_of_the_queries(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        names = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
