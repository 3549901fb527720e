"""Lattices, language identification and language-model scores."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.llm import langid, lm_score
from hearth.llm.common import BATCH_SIZE, small_batches
from hearth.llm.lattice import Lattice, Vocabulary, expected_uses, prior, score_words
from hearth.llm.queries import PIECES, op1_language_id, op9_lm_score
from hearth.llm.vocabulary import MARK, read_model


@pytest.fixture(scope="module")
def model():
    return read_model(PIECES)


def segmentations(word, pieces, byte_ids):
    """(ids) of every segmentation of a word, bytes only for characters without a piece."""
    if not word:
        yield ()
        return
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces, byte_ids):
                yield (pieces[word[:n]], *rest)
    if word[0] not in pieces:
        for rest in segmentations(word[1:], pieces, byte_ids):
            yield (*(byte_ids[b] for b in word[0].encode()), *rest)


WORDS = ["the", "eaux", "x", "Ünï", "a💩b", "|", "\x00", "mmmm"]


def test_forward_sums_all_segmentations(model):
    v, pieces = Vocabulary.of(model), {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 1}
    logp = prior(model, v.size)
    expected = [math.log(sum(math.exp(sum(logp[i] for i in s)) for s in segmentations(MARK + w, pieces, model.byte_ids()))) for w in WORDS]
    assert np.allclose(score_words(v, logp[:, None], WORDS)[:, 0], expected)
    uses = np.zeros(v.size)
    for w, total in zip(WORDS, expected, strict=True):
        for s in segmentations(MARK + w, pieces, model.byte_ids()):
            for i in s:
                uses[i] += 3 * math.exp(sum(logp[j] for j in s) - total)
    assert np.allclose(expected_uses(v, logp, WORDS, np.full(len(WORDS), 3.0)), uses)


def test_long_word_stays_finite(model):
    v = Vocabulary.of(model)
    score = Lattice(v, [MARK + "ab" * 5000]).score(prior(model, v.size)[:, None])
    assert np.isfinite(score).all() and score[0, 0] < -1000


def test_prior_is_a_distribution(model):
    assert math.isclose(np.exp(prior(model, len(model.pieces))).sum(), 1.0)


def test_words_of_letters():
    assert langid.words_of("Été 12_a ²") == ["été", "a", "²"] and langid.words_of("12 ² _") == [] and langid.words_of("") == []


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.95
    for r in rows.limit(5).collect():
        assert zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1


class Naive:
    """Pieces by plain dictionaries: forward and backward sums over one word's positions."""

    def __init__(self, model, size):
        self.pieces = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 1}
        self.byte_ids, self.longest, self.known = model.byte_ids(), max(map(len, self.pieces)), {}

    def arcs(self, word):
        if word not in self.known:
            found = []
            for a in range(len(word)):
                for b in range(a + 1, min(len(word), a + self.longest) + 1):
                    if word[a:b] in self.pieces:
                        found.append((a, b, (self.pieces[word[a:b]],)))
                if word[a] not in self.pieces:
                    found.append((a, a + 1, tuple(self.byte_ids[x] for x in word[a].encode())))
            self.known[word] = found
        return self.known[word]

    def ahead(self, word, p):
        out = [1.0] + [0.0] * len(word)
        for a, b, ids in self.arcs(word):
            out[b] += out[a] * math.prod(p[i] for i in ids)
        return out

    def uses(self, word, p, n, total):
        arcs, ahead, back = self.arcs(word), self.ahead(word, p), [0.0] * len(word) + [1.0]
        for a, b, ids in reversed(arcs):
            back[a] += back[b] * math.prod(p[i] for i in ids)
        for a, b, ids in arcs:
            for i in ids:
                total[i] += n * ahead[a] * math.prod(p[j] for j in ids) * back[b] / ahead[-1]


def test_language_query_equals_brute_force(spark, sf_dir, model):
    """Counts, both rounds of estimation and every text's posterior, by the naive sums."""
    naive, size = Naive(model, len(model.pieces)), len(model.pieces)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang in docs:
        if not held(i) and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(langid.words_of(text))
    begin = np.exp(prior(model, size)).tolist()
    p = {lang: begin for lang in counts}
    for _ in range(2):
        for lang, words in counts.items():
            total = [0.5] * size
            for w, n in words.items():
                naive.uses(MARK + w, p[lang], n, total)
            everything = sum(total)
            p[lang] = [x / everything for x in total]
    langs, seen = sorted(p), {}

    def log_of(lang, w):
        if (lang, w) not in seen:
            seen[lang, w] = math.log(naive.ahead(MARK + w, p[lang])[-1])
        return seen[lang, w]

    found = {r["doc_id"]: r for r in op1_language_id(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for i, text, _ in docs:
        words = langid.words_of(text or "")
        r = found[i]
        assert r["held_out"] == held(i)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        logs = [math.fsum(log_of(lang, w) for w in words) for lang in langs]
        best = max(logs)
        assert r["lang_pred"] == langs[logs.index(best)] and math.isclose(r["score"], 1 / math.fsum(math.exp(x - best) for x in logs), rel_tol=1e-6)


def test_language_ties_and_hot_copies(spark):
    """Languages with the same words tie: the first by name. One text's copies are drawn row by row."""
    rows = [(i, "same words here", lang) for lang in ("zz", "aa") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs, PIECES)).collect()} == {"aa"}
    many = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'one hot text', concat('text ', id)) as text", "'en' as lang")
    kept = many.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(0.25 * (1 << 20))) & (F.col("text") == "one hot text")).count()
    assert 250 < kept < 420
    assert langid.fit(many, PIECES, docs_per_lang=1000, sample_by=("doc_id", "text")).langs == ["en"]


def test_samples_of_any_size_are_fine_enough(spark):
    """Shares of 5e10 rows, which 20 random bits can't tell from none."""
    for n in (1, 20_000, 20_001, 10**6, 5 * 10**10, 10**13):
        bound = langid.drawn_below(n, 20_000)
        assert 0 < bound < 1 << 63 and math.isclose(n * bound / 2**63, min(n, 20_000), rel_tol=1e-6)
    copies = spark.range(3000).selectExpr("id as doc_id", "'one text only' as text", "'en' as lang")
    with pytest.raises(ValueError, match="en"):  # by the text alone all copies are drawn or none
        langid.fit(copies.withColumn("text", F.lit("all alike 3")), PIECES, docs_per_lang=1)
    assert langid.fit(copies, PIECES, docs_per_lang=100, sample_by=("doc_id", "text")).langs == ["en"]


def test_language_edge_cases(spark):
    kind = "doc_id long, text string, lang string, lang_pred int"
    rows = [(1, "the house and the garden", "en", 1), (2, "la maison et le jardin", "fr", 2), (2, "la maison et le jardin", "fr", 2), (3, None, "en", 3), (4, "", "fr", 4), (None, "the garden", None, 5), (6, "123 !!", "en", 6), (7, "the " * 50_000, None, 7)]
    docs = spark.createDataFrame(rows, kind)
    found = [tuple(r) for r in langid.predict(docs, langid.fit(docs, PIECES)).collect()]
    assert len(found) == len(rows)
    by = {}
    for i, lang, score in found:
        by.setdefault(i, set()).add(lang)
        assert 0 <= score <= 1
    assert by == {1: {"en"}, 2: {"fr"}, 3: {"und"}, 4: {"und"}, None: {"en"}, 6: {"und"}, 7: {"en"}}
    nothing = docs.where("false")
    assert langid.predict(nothing, langid.fit(nothing, PIECES)).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(nothing, PIECES)).collect()} == {"und"}


def brute_base(docs, train):
    counts, n_docs = Counter(), 0
    for text in train:
        counts.update((text or "").encode().lower().split())
        n_docs += 1
    total, distinct = sum(counts.values()) + n_docs, len(counts) + (n_docs > 0)
    out = {}
    for i, text in docs:
        tokens = (text or "").encode().lower().split()
        found = [counts[t] for t in tokens] + [n_docs]
        out[i] = (len(found), sum(c > 0 for c in found), total, sum(math.log10((c + 1) / (total + distinct + 1)) for c in found))
    return out


def test_lm_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    expected = brute_base(docs, [t for i, t in docs if not held(i)])
    rows = op9_lm_score(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, base = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_lm_score_equals_brute_force(spark, sf_dir, model):
    """The re-estimated weights and every text's marginal probability, by the naive sums."""
    naive, size = Naive(model, len(model.pieces)), len(model.pieces)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    # characters outside A-Z keep their case, so words are cut from bytes
    words_of = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    counts, n_texts = Counter(), 0
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words_of(text))
            n_texts += 1
    begin = np.exp(prior(model, size)).tolist()
    total = [1000 * x for x in begin]
    for w, n in counts.items():
        naive.uses(MARK + w, begin, n, total)
    everything = sum(total) + n_texts + 1
    p = [x / everything for x in total]
    logs = {}
    found = {r["doc_id"]: r["score"] for r in op9_lm_score(spark, sf_dir).collect()}
    for i, text in docs:
        score = math.log10((n_texts + 1) / everything)
        for w in words_of(text):
            if w not in logs:
                logs[w] = math.log10(naive.ahead(MARK + w, p)[-1])
            score += logs[w]
        assert math.isclose(found[i], score, rel_tol=1e-7)


def test_rare_words_are_joined(spark):
    docs = spark.createDataFrame([(1, "A b c"), (2, "a B d"), (3, None), (3, None), (None, "a\x00 zz ")], "doc_id long, text string")
    full, few = (lm_score.fit(docs.where("doc_id < 3"), PIECES, frequent_words=k) for k in (1000, 0))
    assert len(full.frequent) == 4 and not few.frequent
    a, b = (sorted(map(str, lm_score.score(docs, m).select("doc_id", "n_tokens", "n_known", F.round("base_score", 9), F.round("score", 9)).collect())) for m in (full, few))
    assert a == b and len(a) == 5
    nothing = docs.where("false")
    assert lm_score.score(nothing, full).collect() == []
    empty = lm_score.fit(nothing, PIECES)
    assert {r["n_known"] for r in lm_score.score(docs, empty).collect()} == {0}


def test_lm_prefers_the_language_it_learned(spark):
    docs = spark.createDataFrame([(1, "die katze und der hund und die maus " * 20)], "doc_id long, text string")
    test = spark.createDataFrame([(1, "der hund und die katze"), (2, "xq zzkw vvp jjx qqw")], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in lm_score.score(test, lm_score.fit(docs, PIECES)).collect()}
    assert scores[1] > scores[2]


def test_batches_are_bounded_by_bytes(spark):
    """Rows clumped in one partition reach Python in batches of about ``BATCH_SIZE`` bytes; a longer text is alone, none is lost."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    sizes = [200_000] * 100 + [3 * BATCH_SIZE] + [10] * 5
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n int").coalesce(1)
    docs = rows.select("doc_id", F.repeat(F.lit("x"), "n").alias("text"))

    def run(batches):
        for b in batches:
            longest = max(len(x.as_py()) for x in b.column(1))
            yield type(b).from_pydict({"rows": [b.num_rows], "bytes": [b.column(1).nbytes], "longest": [longest]})

    try:
        spark.conf.unset(name)
        found = small_batches(docs).mapInArrow(run, "rows long, bytes long, longest long").collect()
        assert sum(r["rows"] for r in found) == len(sizes)
        assert all(r["bytes"] - r["longest"] <= 2 * BATCH_SIZE for r in found)
        assert len(found) >= 5
        spark.conf.set(name, "1000000")
        small_batches(docs)
        assert spark.conf.get(name) == "1000000"
    finally:
        if before:
            spark.conf.set(name, before)
        else:
            spark.conf.unset(name)
