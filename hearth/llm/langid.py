"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities over the pieces of one fixed public vocabulary.
A word's probability under a language is the sum over all its segmentations, by the
forward algorithm; a text's score is the product over its words, so a text of any length
is read whole.  The probabilities come from expectation maximisation over the words of a
bounded sample of labelled rows.

Defined results: a null text, or one without a letter, gets ``und`` and score 0; so does
every text if no labelled row was there to learn from.  Repeated rows each get a row.
Ties go to the language that sorts first.  Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, slices, small_batches
from .lattice import Vocabulary, expected_uses, prior, score_words
from .vocabulary import read_model

UNKNOWN_LANGUAGE = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Entries of a task's dictionaries; beyond it they are flushed and begun anew.
CACHE_WORDS = 500_000


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; empty if there is no letter (other numerals alone don't count)."""
    words = _LETTERS.findall(text.lower())
    if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
        return []
    return words


@dataclass
class LanguageModel:
    """``logp`` has a row for each piece and a column for each language, so its size is bounded by both."""

    vocabulary: Vocabulary
    langs: list[str]
    logp: np.ndarray


def fit(
    docs: DataFrame,
    vocabulary_path: str,
    text: str = "text",
    lang: str = "lang",
    docs_per_lang: int = 20_000,
    sample_by: tuple[str, ...] = ("text",),
    iterations: int = 2,
    smoothing: float = 0.5,
    max_langs: int = 256,
) -> LanguageModel:
    """Learn from the rows with a text and a language.

    docs_per_lang: the bound of the sample.  A language with more rows gives that many in
    expectation, chosen by a hash of ``sample_by``; one with fewer gives all.  Name a column
    that tells copies of a text apart, or they come all or none.
    max_langs: the model is a table of pieces x languages in every task (64 MB at 256 of them
    with 32 thousand pieces); more languages are an error, none is left out.
    """
    spark = small_batches(docs).sparkSession
    model = read_model(vocabulary_path)
    vocabulary = Vocabulary.of(model)
    drawn = F.xxhash64(*sample_by).bitwiseAND(F.lit((1 << 63) - 1))
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), drawn.alias("drawn")).where("text is not null and lang is not null")
    rows = labelled.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(rows) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    rows = sorted((r["lang"], r["count"]) for r in rows)
    langs = [name for name, _ in rows]
    if not langs:
        return LanguageModel(vocabulary, [], np.zeros((vocabulary.size, 0)))
    keep = F.lit(False)
    for name, n in rows:
        keep = keep | ((F.col("lang") == name) & (F.col("drawn") < F.lit(drawn_below(n, docs_per_lang))))
    sample = labelled.where(keep) if any(n > docs_per_lang for _, n in rows) else labelled
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = sample.select("text", "lang").mapInArrow(_count_words, "lang string, word string, n long")
    words = materialise(counted.repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    learned = {r["lang"] for r in words.select("lang").distinct().collect()}  # max_langs rows
    if silent := [name for name, n in rows if n > docs_per_lang and name not in learned]:
        _require_rows(sample, silent)  # texts without words are no error: such a language keeps the prior
    logp = np.repeat(prior(model, vocabulary.size)[:, None], len(langs), axis=1)
    for _ in range(iterations):
        uses = words.mapInArrow(_expect(share(spark.sparkContext, (vocabulary, langs, logp))), "lang int, piece int, uses double")
        total = np.full(logp.shape, smoothing)
        found = uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()  # at most pieces x languages
        np.add.at(total, (found["piece"].to_numpy(), found["lang"].to_numpy()), found["uses"].to_numpy())
        logp = np.log(total / total.sum(axis=0))
    return LanguageModel(vocabulary, langs, logp)


def drawn_below(n: int, wanted: int) -> int:
    """The bound on 63 random bits that lets ``wanted`` of ``n`` rows through in expectation, all of fewer."""
    return (1 << 63) - 1 if n <= wanted else max(1, (wanted << 63) // n)


def _require_rows(sample: DataFrame, langs: list[str]) -> None:
    found = {r["lang"] for r in sample.where(F.col("lang").isin(langs)).select("lang").distinct().collect()}
    if missing := [x for x in langs if x not in found]:
        raise ValueError(f"the sample holds no row of {missing}: name columns in sample_by that tell copies apart")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        counts.clear()
        return out

    for batch in slices(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
        if len(counts) > CACHE_WORDS:
            yield flush()
    yield flush()


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, langs, logp = shared.value
        total = np.zeros((len(langs), vocabulary.size))
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            word = np.array(batch.column(1).to_pylist(), dtype=object)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            for k, name in enumerate(langs):
                mine = np.flatnonzero(lang == name)
                total[k] += expected_uses(vocabulary, logp[:, k], list(word[mine]), n[mine].astype(float))
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], ["lang", "piece", "uses"])

    return run


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``lang_pred`` and ``score``, the language's posterior under equal priors."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = share(docs.sparkSession.sparkContext, model)
    return docs.select(F.col(doc_id), F.col(text).alias("text")).mapInArrow(_predict(shared), f"`{doc_id}` {kind}, lang_pred string, score double")


class _Scores(dict):
    """Word to row of a growing matrix of log probabilities."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows = np.zeros((0, len(model.langs)))

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > CACHE_WORDS:
            self.clear()
            self.rows = self.rows[:0]
            fresh = list(words)
        if fresh:
            self.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, score_words(self.model.vocabulary, self.model.logp, fresh)])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model)
        for batch in slices(batches):
            texts = [words_of(x or "") if model.langs else [] for x in batch.column(1).to_pylist()]
            scores.learn(set().union(*texts))
            langs, sure = [], []
            for words in texts:
                if not words:
                    langs.append(UNKNOWN_LANGUAGE)
                    sure.append(0.0)
                    continue
                total = scores.rows[np.fromiter(map(scores.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                best = int(total.argmax())
                langs.append(model.langs[best])
                sure.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], [batch.schema.names[0], "lang_pred", "score"])

    return run
