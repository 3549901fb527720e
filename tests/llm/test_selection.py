"""Filter audits, importance resampling and SimHash, against SQL and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hearth.llm import filter_audit, importance, simhash
from hearth.llm.oracles import SQL
from hearth.llm.queries import op11_filter_audit, op12_importance, op13_simhash_dedup

from ..compare import assert_same, connect

TEXTS = [None, "", " \t\n\x0b\f\r ", "a", "A b A b #", "é É x y é", "    a b", "one two  three\none", "ab ba ab aab aba", "$%&*|", "X" * 5000 + " y", "日本 語 日本 " * 300, "no\x00null a\x1cb"]


def naive(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(re.findall("[#$%&*|]", text or "")), len(text or ""))


def measured(texts, meter=None):
    column = pa.array([(t or "").encode() for t in texts], pa.large_binary())
    found = (meter or filter_audit.Meter()).measure(column)
    return list(zip(*(found[c].tolist() for c in filter_audit.MEASURES), strict=True))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_measures_equal_naive_counts(monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", block)
    r = random.Random(block)
    alphabet = ["a", "b", "A", " ", "\n", "é", "#", "word", "字"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(150)]
    assert measured(texts) == [naive(t) for t in texts]
    meter = filter_audit.Meter()
    column = pa.array([(t or "").encode() for t in texts], pa.large_binary()).slice(5, 40)
    assert meter.measure(column)["n_words"].tolist() == [naive(t)[0] for t in texts[5:45]]
    assert measured([]) == []


def test_words_that_share_a_hash_are_told_apart():
    meter = filter_audit.Meter()
    meter.codes = np.ones(256, dtype=np.uint64)  # every two words of one length collide
    assert measured(TEXTS, meter) == [naive(t) for t in TEXTS]


def test_op11_equals_sql(spark, sf_dir):
    assert_same(op11_filter_audit(spark, sf_dir), SQL["op11_filter_audit"], connect(sf_dir))


def test_audit_edge_cases(spark):
    """Nulls, ties, repeated rows, clashing columns: every order replayed document by document."""
    plain = " ".join(f"w{i}" for i in range(60))
    rows = [(1, plain, "a"), (2, plain, "a"), (2, plain, "a"), (1, plain, None), (None, plain, ""), (None, None, "b"), (3, None, "b"), (4, "", "b"), (5, plain + " # X", "a"), (6, "X Y " * 40, "a"), (7, "y " * 30_000, "b"), (8, plain + " %", "b"), (9, plain + " %", "a")]
    docs = spark.createDataFrame([(*x, 1, 2, "m") for x in rows], "doc_id long, text string, source string, id int, mask int, part string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 9}, {1, 2}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    expected = {}
    fails = []
    for i, t, part in rows:
        words, distinct, capitals, symbols, chars = naive(t)
        tests = (words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * chars, symbols > 0, i is not None and i > first[t or ""])
        fails.append((part or "", {f for f, bad in zip("ABCDE", tests, strict=True) if bad}, i in good, i in toxic))
    shares = {}
    for order in permutations("ABCDE"):
        for part in {f[0] for f in fails}:
            left, seen = [f for f in fails if f[0] == part], []
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                redundant = sum(letter in f[1] for f in seen)
                unique = sum(f[1] == {letter} for f in fails if f[0] == part)
                expected[part, "".join(order), k + 1] = [len(left), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shares[part, letter] = shares.get((part, letter), 0) + len(gone)
                seen += gone
    found = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    assert set(found) == set(expected) and len(found) == 3 * 600
    for (part, order, step), want in expected.items():
        r = found[part, order, step]
        assert [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] == [*want, shares[part, order[step - 1]]]
    assert filter_audit.audit(docs.where("false"), labels).collect() == [] and filter_audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_op12_equals_sql(spark, sf_dir):
    assert_same(op12_importance(spark, sf_dir), SQL["op12_importance"], connect(sf_dir))


def brute_scores(rows, target, max_n, buckets, min_words, percent, seed):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = k + 1
    return sorted(map(str, (r[:5] for r in out)))


@pytest.mark.parametrize(("max_n", "buckets"), [(1, 10_000), (3, 97)])
def test_scores_equal_brute_force(spark, max_n, buckets):
    r = random.Random(max_n)
    words = ["alpha", "Beta", "gamma-ray", "é", "É", "x1", "日本", "delta_", "e.g."]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(120)] + [(200, None), (201, ""), (None, "alpha " * 30), (7, "beta " * 25), (300, " ".join(f"v{k}" for k in range(30_000)))]
    rows += [(400, "alpha beta " * 12)] * 5
    docs = spark.createDataFrame([(*x, 1, "r") for x in rows], "doc_id long, text string, weight int, rank string").repartition(7)
    target = spark.createDataFrame([("alpha beta é",), (None,), ("x1 " * 9,)], "text string")
    found = importance.scores(docs, target, max_n=max_n, buckets=buckets, min_words=10, percent=30, seed=5).collect()
    assert sorted(str(list(x)) for x in found) == brute_scores(rows, [x[0] for x in target.collect()], max_n, buckets, 10, 30, 5)
    ranks = sorted(x["rank"] for x in found if x["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    drawn = importance.resample(docs, target, max_n=max_n, buckets=buckets, min_words=10, percent=30, seed=5)
    assert drawn.columns == docs.columns and {x["doc_id"] for x in drawn.collect()} == {x["doc_id"] for x in found if x["rank"] is not None}


def test_importance_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20), (2, None)], "doc_id long, text string")
    target = docs.select("text").where("false")
    assert importance.scores(docs.where("false"), target).collect() == []
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in importance.scores(docs, target, percent=100).collect()} == {(1, 60, 1), (2, 0, None)}
    assert importance.resample(docs, target, percent=100).count() == 1
    with pytest.raises(ValueError):
        importance.gains(docs, target, buckets=1 << 21)


def test_ranks_are_those_of_one_sort(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 50).alias("v"), "id").repartition(9)
    found = importance.ranked(rows, [F.desc("v"), F.asc("id")], "rank").collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 5001))


def brute_fingerprint(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, max_bits):
    """The least id of each (id, fingerprint), comparing all pairs."""
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            if (a ^ nodes[j][1]).bit_count() <= max_bits:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(nodes):
        least[root(i)] = min(key, least.get(root(i), key))
    return [least[root(i)] for i in range(len(nodes))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_op13_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    nodes = [(i, brute_fingerprint(t, 3)) for i, t in docs]
    expected = {i: (f"{f:016x}", c) for (i, f), c in zip(nodes, brute_components(nodes, 2), strict=True)}
    found = op13_simhash_dedup(spark, sf_dir)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found.collect()} == expected


def test_hash_is_that_of_the_sql_function(spark):
    texts = ["one two three", "é É 日本", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(simhash.hashes_of(r["t"].encode(), 9).view(np.int64).tolist() == [r["h"]] for r in rows if r["t"].islower() or r["t"].startswith("x"))


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_fingerprints_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    r = random.Random(block)
    texts = [*TEXTS, *(" ".join(r.choice(["a", "B", "é", "long-word", "字"]) for _ in range(r.randrange(300))) for _ in range(60))]
    for size in (1, 3, 5):
        found = simhash.fingerprints([simhash.hashes_of((t or "").encode(), size) for t in texts])
        assert found.tolist() == [brute_fingerprint(t, size) for t in texts]


def near(r, base, bits):
    for b in r.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize(("max_bits", "dense"), [(1, None), (2, None), (2, 3), (3, None), (3, 20), (4, None), (6, None)])
def test_links_equal_brute_force(spark, max_bits, dense):
    """Fingerprints around some centres and chains of them; keys that many share go the other way."""
    r = random.Random(max_bits)
    values = {0, 1, 3, 7, (1 << 64) - 1, (1 << 63)}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            values.add(x := near(r, x, r.randrange(max_bits + 3)))
    values = sorted(values)
    nodes = [(signed(v), v) for v in values]
    expected = dict(zip((n[0] for n in nodes), brute_components(nodes, max_bits), strict=True))
    found = simhash.links(spark.createDataFrame([(n[0],) for n in nodes], "fp long"), max_bits, dense)
    rows = [(x["u"], x["v"]) for x in found.collect()]
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= max_bits for u, v in rows)
    if dense is None:
        pairs = {(signed(a), signed(b)) for a in values for b in values if signed(a) < signed(b) and (a ^ b).bit_count() <= max_bits}
        assert set(rows) == pairs and len(rows) == len(pairs)  # each pair once
    least = dict(expected)
    component = {x["node"]: x["component"] for x in simhash.connected_components(found).collect()}
    assert {n: component.get(n, n) for n in least} == least


def test_simhash_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (3, "another text of its own"), (3, "another text of its own"), (9, "Another Text of its own"), (None, text), (1, None), (2, ""), (4, " \n"), (None, None), (6, "solo"), (7, " ".join(f"v{i}" for i in range(60_000)))]
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, fp int, component_id string")
    found = simhash.find(docs, size=3)
    nodes = [(i, brute_fingerprint(t, 3)) for i, t in rows if i is not None]
    expected = sorted((i, signed(f), c) for (i, f), c in zip(nodes, brute_components(nodes, 2), strict=True))
    assert sorted((r["doc_id"], r["fp"], r["component_id"]) for r in found.where("doc_id is not null").collect()) == expected
    assert {(r["fp"], r["component_id"]) for r in found.where("doc_id is null").collect()} == {(signed(brute_fingerprint(text, 3)), None), (0, None)}
    assert simhash.find(docs.where("false")).collect() == []
    stay = simhash.keep_one(docs, size=3)
    assert stay.columns == docs.columns and sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(["3", "3", "3", "None", "1", "None", "6", "7"])
    names = spark.createDataFrame([("b", "x y z"), ("a", "X y z")], "doc_id string, text string")
    assert {r["component_id"] for r in simhash.find(names).collect()} == {"a"}
