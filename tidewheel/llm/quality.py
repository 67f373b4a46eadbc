"""Quality classification from weak labels.

Nine overlapping heuristics vote good, bad or abstain on each text. The counts of the vote patterns over all documents
(at most 3^9 rows, whatever the corpus) go through expectation-maximisation, which estimates each heuristic's accuracy
without any true label; a pattern's posterior is its documents' weak label. A hashed linear scorer (logistic, over words
and word shapes) learns the weak labels of a bounded sample and then scores every whole text.

Edge cases: null, empty and blank texts get score 0 and aren't learned from; an empty table has no rows; repeated rows
are scored each; of rows of one id the least text is learned from; rows with a null id are scored; very long texts count
whole; a score of exactly the threshold is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import textvec
from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import table

BUCKETS = 1 << 18
#: Documents to learn the scorer from at most, in the order of a hash of their id.
SAMPLE = 4000
EPOCHS, RATE, GAIN = 10, 0.5, 100.0
THRESHOLD = 0.5
#: Share of good texts on which a heuristic votes bad, at most.
FALSE_ALARMS = 0.005
LABELLERS = ("capitals", "symbols", "repeats", "marks", "tables", "variety", "lengths", "plain", "lower")
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*^~_=<>{}[]\\@|+"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sums(flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total


@dataclass
class Seen:
    """What a chunk of rows looks like."""

    rows: np.ndarray  # first word of each row
    word: np.ndarray  # word hashes
    shape: np.ndarray  # hashes of word shapes
    votes: np.ndarray  # (rows, labellers): 0 abstains, 1 bad, 2 good


def look(data: np.ndarray, offsets: np.ndarray) -> Seen:
    starts, ends, rows = textvec.words(data, offsets)
    word = textvec.hash_spans(data, starts, ends)
    n = len(word)
    size = (ends - starts).astype(np.int32)

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = _sums(flags)
        return total[ends] - total[starts]

    upper = per_word((data >= 65) & (data <= 90))
    letter = per_word(_LETTER[data])
    symbol = per_word(_SYMBOL[data])
    mark = per_word(data == 33)
    digit = per_word((data >= 48) & (data <= 57))
    same = np.zeros(n, bool)
    same[1:] = word[1:] == word[:-1]
    same[rows[:-1][rows[:-1] < n]] = False
    shout = (upper >= 2) & (2 * upper > letter)
    shape = textvec.mix(
        (np.minimum(size, 15).astype(np.uint64) << _U(8)) | (shout.astype(np.uint64) << _U(6)) | ((symbol > 0).astype(np.uint64) << _U(5)) | ((mark > 1).astype(np.uint64) << _U(4)) | ((digit > 0).astype(np.uint64) << _U(3)) | (same.astype(np.uint64) << _U(2)) | _U(1)
    )
    count = np.diff(rows)

    def per_row(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[rows[1:]] - total[rows[:-1]]

    some = np.maximum(count, 1)
    distinct = np.ones(len(count))
    for i in np.flatnonzero(count > 0).tolist():
        distinct[i] = len(np.unique(word[rows[i] : rows[i + 1]])) / count[i]
    long_enough = count >= 10

    sure = count >= 3

    def fault(value: np.ndarray, bad: float) -> np.ndarray:
        """Bad from a bound on, else no vote."""
        return np.where(sure & (value >= bad), 1, 0)

    def vote(value: np.ndarray, bad: float, good: float, sure: np.ndarray = sure) -> np.ndarray:
        """Bad up to one bound, good from another, else no vote."""
        return np.where(sure & (value <= bad), 1, np.where(sure & (value >= good), 2, 0))

    # one mark of punctuation at the end leaves a word plain
    last = data[ends - 1] if n else np.zeros(0, np.uint8)
    # a word that only repeats the one before it isn't plain text either
    plain = (letter + np.isin(last, np.frombuffer(b".,;:?!", np.uint8)) == size) & ~same
    lower = plain & (upper == 0)
    variety = distinct * np.maximum(1, (some / 100.0)) ** 0.3  # longer texts repeat words more
    average = per_row(size) / some
    votes = np.stack(
        [
            fault(per_row(shout) / some, 0.3),
            fault(per_row(symbol > 0) / some, 0.25),
            fault(per_row(same) / some, 0.2),
            fault(per_row(mark > 0) / some, 0.25),
            fault(per_row((symbol > 0) & (size == 1)) / some, 0.15),
            vote(variety, 0.25, 0.45, long_enough),
            vote(-np.abs(average - 7), -13, -4, long_enough),
            vote(per_row(plain) / some, 0.65, 0.85),
            vote(per_row(lower) / some, 0.4, 0.65),
        ],
        axis=1,
    )
    votes[count == 0] = 1
    return Seen(rows, word, shape, votes.astype(np.int64))


_PLACES = 3 ** np.arange(len(LABELLERS))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in textvec.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(look(data, offsets).votes @ _PLACES)], names=["doc_id", "pattern"])


def patterns(docs: DataFrame) -> DataFrame:
    """doc_id and the number of its vote pattern."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_patterns), "doc_id long, pattern long")


@dataclass
class Weak:
    prior: float  # share of good
    rates: np.ndarray  # (class, labeller, vote): probability of each vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        log = np.log([1 - self.prior, self.prior])[None, :] + sum(np.log(self.rates[:, k, :])[:, votes[:, k]].T for k in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller where it votes."""
        right = (1 - self.prior) * self.rates[0, :, 1] + self.prior * self.rates[1, :, 2]
        return right / np.maximum(1e-9, (1 - self.prior) * self.rates[0, :, 1:].sum(axis=1) + self.prior * self.rates[1, :, 1:].sum(axis=1))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarms: float | None = None) -> Weak:
    """Class prior and each labeller's vote rates, from pattern counts. Starts from the bad votes against the good ones.

    ``false_alarms`` bounds the share of good texts on which a labeller votes bad. Without it a fault that only one or
    two heuristics see can pass as a habit of good texts.
    """
    good, bad = (votes == 2).sum(axis=1), (votes == 1).sum(axis=1)
    # a single bad vote is a fair hint: heuristics look for different faults
    post = np.where(bad == 0, 0.95, np.where(bad == 1, 0.35, 0.1)) * np.where(good == 0, 0.5, 1)
    weight = counts.astype(np.float64)
    model = None
    for _ in range(rounds):
        by_class = np.stack([weight * (1 - post), weight * post])
        total = by_class.sum(axis=1)
        rates = np.stack([(by_class @ (votes == v)) for v in range(3)], axis=2) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        if false_alarms is not None:
            rates[1, :, 1] = np.minimum(rates[1, :, 1], false_alarms)
            rates /= rates.sum(axis=2, keepdims=True)
        model = Weak(float(np.clip(total[1] / total.sum(), 0.01, 0.99)), rates)
        new = model.posterior(votes)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model


def _votes(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // _PLACES % 3


def features(seen: Seen) -> np.ndarray:
    """Two buckets of each word: of itself and of its shape."""
    half = _U(BUCKETS // 2 - 1)
    return np.stack([(seen.word & half).astype(np.int64), (seen.shape & half).astype(np.int64) + BUCKETS // 2], axis=1)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, seen: Seen) -> np.ndarray:
        """Probability of good for each row; 0 where there is no word."""
        value = self.weights[features(seen)].sum(axis=1) if len(seen.word) else np.zeros(0)
        total = np.concatenate([[0], np.cumsum(value, dtype=np.float64)])
        count = np.diff(seen.rows)
        mean = (total[seen.rows[1:]] - total[seen.rows[:-1]]) / np.maximum(count, 1)
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50))), 0.0)


def train(bags: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, seed: int = 5) -> Scorer:
    """Logistic regression on soft labels."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(BUCKETS, np.float32), 0.0
    steps, done = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            used, share = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            error = 1 / (1 + np.exp(-np.clip(weights[used] @ share + bias, -50, 50))) - targets[i]
            weights[used] -= rate * GAIN * error * share
            bias -= rate * error
    return Scorer(weights, float(bias))


@dataclass
class Model:
    weak: Weak
    scorer: Scorer


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    seen = patterns(docs)
    counts = seen.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    number = np.array([r["pattern"] for r in counts], np.int64)
    if not len(number):
        return Model(Weak(0.5, np.full((2, len(LABELLERS), 3), 1 / 3)), Scorer(np.zeros(BUCKETS, np.float32), 0.0))
    weak = expectation_maximisation(_votes(number), np.array([r["count"] for r in counts]), false_alarms=FALSE_ALARMS)
    # as many ids as the sample at most; of rows of one id the least text
    known = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), "text")
    chosen = known.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = known.join(F.broadcast(chosen), "_id", "left_semi").groupBy("_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, targets = [], []
        for batch in batches:
            for _, _, data, offsets in textvec.chunks(batch.column(1)):
                seen = look(data, offsets)
                used, post = features(seen), weak.posterior(seen.votes)
                for r in range(len(offsets) - 1):
                    own = used[seen.rows[r] : seen.rows[r + 1]]
                    if len(own):
                        of, count = np.unique(own, return_counts=True)
                        bags.append((of, (count / len(own)).astype(np.float32)))
                        targets.append(post[r])
        scorer = train(bags, np.array(targets))
        yield pa.RecordBatch.from_arrays([pa.array([scorer.weights.tobytes()], pa.binary()), pa.array([scorer.bias])], names=["weights", "bias"])

    # one task of an executor: only the weights come to the driver, and a text only counts as a bag of buckets
    found = rows.repartition(1).sortWithinPartitions("_id").mapInArrow(tidy(run), "weights binary, bias double").first()
    return Model(weak, Scorer(np.frombuffer(found["weights"], np.float32), found["bias"]) if found else train([], np.zeros(0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, weak (the posterior of the votes) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in batches:
            for first, end, data, offsets in textvec.chunks(batch.column(1)):
                seen = look(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(own.scorer.score(seen)), pa.array(own.weak.posterior(seen.votes))], names=["doc_id", "score", "weak"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, weak double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs)).select("doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept"), F.round("weak", 6).alias("weak"))
