"""Language-model scores: the marginal probability of a text over a subword lattice.

A text is its words, each with the word mark before it, then one end.  Every
segmentation of the words into the pieces of an existing vocabulary counts; the forward
recursion in log space sums them.  The weights begin as the vocabulary's own scores and
are re-estimated once from the expected uses over all training words.

Beside it stands a word unigram model with add-one smoothing over all training tokens.
Its frequent words go to the tasks in a table of bounded size, all others are joined.

Defined results: a null or empty text has one token, the end.  Words are runs without
ASCII white space, A-Z in lower case.  Without training rows every count is 0 and the
vocabulary's own scores weight the lattice.  Repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, slices, small_batches, texts
from .lattice import Vocabulary, expected_uses, prior, score_words
from .vocabulary import read_model

CACHE_WORDS = 500_000
LN10 = math.log(10)


def tokens_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes; only A-Z change case, only ASCII white space parts."""
    return text.lower().split()


@dataclass
class TextModel:
    vocabulary: Vocabulary
    #: Natural logs, one for each piece (bounded by the vocabulary), and the end's.
    logp: np.ndarray
    log_end: float
    #: word, n: all training words; as large as the corpus makes it, so it stays a table.
    words: DataFrame
    #: The words of the highest counts, at most ``frequent_words``.
    frequent: dict[bytes, int]
    n_texts: int
    n_tokens: int
    n_distinct: int

    def base(self, count: int) -> float:
        """log10 of the smoothed probability of a token seen ``count`` times."""
        return math.log10((count + 1) / (self.n_tokens + 1 * (self.n_distinct + 1)))


def fit(docs: DataFrame, vocabulary_path: str, text: str = "text", prior_uses: float = 1000.0, frequent_words: int = 200_000) -> TextModel:
    """Count every word of ``docs`` and re-estimate the pieces' weights from them.

    prior_uses: how many uses the vocabulary's own scores stand for.
    frequent_words: the bound of the table that each task holds in memory.
    """
    spark = small_batches(docs).sparkSession
    file = read_model(vocabulary_path)
    vocabulary = Vocabulary.of(file)
    own = prior(file, vocabulary.size)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_count_words, "word string, n long")
    # a row of the word '' counts the texts; no token is empty
    counts = materialise(counted.repartition(parts, "word").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    words = counts.where("word <> ''")
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"))
    steps = sorted(steps.collect(), key=lambda r: -r["step"])  # a few hundred rows
    ends = [r["n"] for r in counts.where("word = ''").collect()]
    n_texts = sum(ends)
    room, least = frequent_words, None
    for r in steps:
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]
    frequent = {}
    if least is not None:
        found = words.where(F.floor(F.log2("n") * 8) >= least).toPandas()
        frequent = {w.encode(): int(n) for w, n in zip(found["word"], found["n"], strict=True)}
    uses = words.mapInArrow(_expect(share(spark.sparkContext, (vocabulary, own))), "piece int, uses double")
    found = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()  # at most one row a piece
    total = np.exp(own) * prior_uses
    np.add.at(total, found["piece"].to_numpy(dtype=np.int64), found["uses"].to_numpy(dtype=float))
    everything = total.sum() + n_texts + 1
    return TextModel(vocabulary, np.log(total / everything), math.log((n_texts + 1) / everything), words, frequent, n_texts, sum(r["n"] for r in steps) + n_texts, sum(r["words"] for r in steps) + (n_texts > 0))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in slices(batches):
        for text in texts(batch):
            counts.update(tokens_of(text))
        counts[b""] += batch.num_rows
        if len(counts) > 2 * CACHE_WORDS:
            yield flush()
    yield flush()


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logp = shared.value
        total = np.zeros(vocabulary.size)
        for batch in batches:
            total += expected_uses(vocabulary, logp, batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        piece = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(total[piece])], ["piece", "uses"])

    return run


def score(docs: DataFrame, model: TextModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = (model.vocabulary, model.logp, model.log_end, model.frequent, model.n_texts, math.log10(model.n_tokens + 1 * (model.n_distinct + 1)))
    scored = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        _score(share(docs.sparkSession.sparkContext, plain)), f"row long, word string, tf long, id {kind}, n_tokens long, n_known long, base double, score double"
    )
    # Words outside the task's table come as rows of their own; a text's other row has a word that can't be one.
    joined = scored.join(model.words.withColumnRenamed("n", "c"), "word", "left")
    base = F.coalesce("base", F.col("tf") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(plain[5])))
    known = F.coalesce("n_known", F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0))
    return (
        joined.select("row", "id", "n_tokens", "score", base.alias("base"), known.alias("known"))
        .groupBy("row")
        .agg(F.max("id").alias(doc_id), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.max("score").alias("score"))
        .select(doc_id, "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )


class _Scores(dict):
    """Word to the natural log of its marginal probability."""

    def __init__(self, vocabulary: Vocabulary, logp: np.ndarray):
        self.vocabulary, self.logp = vocabulary, logp[:, None]

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > CACHE_WORDS:
            self.clear()
            fresh = list(words)
        self.update(zip(fresh, score_words(self.vocabulary, self.logp, [w.decode() for w in fresh])[:, 0].tolist(), strict=True))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, logp, log_end, frequent, n_texts, log_all = shared.value
        scores = _Scores(vocabulary, logp)
        base_of = {w: math.log10(n + 1) - log_all for w, n in frequent.items()}
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            counted = [Counter(tokens_of(x)) for x in texts(batch)]
            scores.learn(set().union(*counted))
            rare: list[tuple[int, bytes, int]] = []
            own: list[tuple[int, int, float, float]] = []
            for words in counted:
                row += 1
                known, n, base, total = 0, 1, math.log10(n_texts + 1) - log_all, log_end
                if n_texts:
                    known = 1
                for w, tf in words.items():
                    n += tf
                    total += tf * scores[w]
                    b = base_of.get(w)
                    if b is None:
                        rare.append((row, w, tf))
                    else:
                        known += tf
                        base += tf * b
                own.append((n, known, base, total / LN10))
            first = row - len(own) + 1
            n, known, base, total = zip(*own, strict=True)
            nothing = pa.nulls(len(rare))
            if rare:
                rows, words, tfs = zip(*rare, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), nothing.cast(batch.schema.field(0).type), nothing.cast(pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.float64()), nothing.cast(pa.float64())], _COLUMNS
                )
            ids = range(first, row + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([f" {i}" for i in ids], pa.string()), pa.nulls(len(own), pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())], _COLUMNS
            )

    return run


_COLUMNS = ["row", "word", "tf", "id", "n_tokens", "n_known", "base", "score"]
