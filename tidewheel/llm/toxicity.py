"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of itself and its character n-grams between word marks, hashed into buckets; a word's vector is the
mean of its grams' vectors. A text's vector is the mean of its distinct words' vectors, weighted by the root of their
counts, with ``PAD`` zero words added, so that neither a repeated word nor a text of a few words runs away. A linear
softmax gives the two classes.
Embeddings and softmax are trained jointly, text by text, by gradient descent in numpy; grams of fewer than ``MIN_TEXTS``
learned texts stay at zero. Misspellings never seen share most grams with words that were.

Once trained, the softmax of a mean is a mean of numbers: each bucket has one number (its vector times the difference
of the class weights), so scoring sends each executor one array of ``BUCKETS`` floats and needs no vectors.

Labels are learned from a bounded sample: one text each of ``SAMPLE`` ids at most, in the order of a hash of the id, of
texts up to ``LONGEST`` characters. Scores use the text alone and cover all rows and whole texts.

Edge cases: null and empty texts have the score of the bias alone; without labelled rows every score is 0; rows with a
null label or id are not learned from; repeated label rows count once (the larger label); of an id's texts the least is
learned from; repeated rows are scored each; an empty table gives no rows; very long texts
count whole, in time linear in them; a score of exactly the threshold is toxic; extra columns are ignored by the query
and kept by ``score`` and ``drop_toxic``; ``score`` refuses a name that the table has (a ValueError).
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewheel.llm import textvec
from tidewheel.llm.worker import Cache, ready, tidy
from tidewheel.runtime import table

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (3, 4, 5, 6)
#: Labelled texts to learn from at most, and their longest in characters: together a bound of what one task holds.
SAMPLE, LONGEST = 6000, 1 << 16
MIN_TEXTS = 5
EPOCHS = 14
#: Learning rate of the softmax; a gram's is GAIN times as high, for its share of a text is about 1 / GAIN.
RATE, GAIN = 0.2, 1000.0
#: Weight of a text of label 1 against one of label 0: the rarer and costlier error.
POSITIVE = 2.0
#: Zero words that a text's mean includes.
PAD = 20.0
THRESHOLD = 0.3
#: Bytes of a generation of words with their numbers, of two that a task keeps.
CACHE = 24 << 20

_find = regex.compile(r"[\p{L}\p{N}]+").findall


def grams(word: str) -> list[int]:
    """Buckets of a word and of its n-grams."""
    marked = f"<{word}>"
    crc = zlib.crc32
    found = [crc(marked.encode()) % BUCKETS]
    for n in NGRAMS:
        found.extend(crc(marked[i : i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1))
    return found


def tokens(text: str | None) -> list[str]:
    return _find(text.lower()) if text else []


@dataclass
class Model:
    numbers: np.ndarray  # of each bucket
    bias: float

    def word(self, word: str) -> float:
        return float(self.numbers[grams(word)].mean())

    def score(self, text: str | None) -> float:
        """Of one text, plainly."""
        words = Counter(tokens(text))
        weight = {w: n**0.5 for w, n in words.items()}
        mean = sum(weight[w] * self.word(w) for w in words) / (sum(weight.values()) + PAD)
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -50, 50))))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax, trained jointly on the texts as whole bags of words."""
    if not texts:
        return Model(np.zeros(BUCKETS, np.float32), -50.0)
    rng = np.random.default_rng(seed)
    of_word: dict[str, np.ndarray] = {}
    all_used, all_share, ends = array("i"), array("f"), [0]  # one run of memory for all bags
    for t in texts:
        words = Counter(tokens(t))
        if len(of_word) > 100_000:
            of_word.clear()
        new = [w for w in words if w not in of_word]
        of_word.update((w, np.array(grams(w), np.int32)) for w in new)
        lists = [of_word[w] for w in words]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        used, inverse = np.unique(flat, return_inverse=True)
        weight = np.sqrt(np.fromiter(words.values(), float, len(words)))
        share = np.repeat(weight / size, size) / (weight.sum() + PAD)
        all_used.frombytes(used.astype(np.int32).tobytes())
        all_share.frombytes(np.bincount(inverse, share, len(used)).astype(np.float32).tobytes())
        ends.append(len(all_used))
    of_word.clear()
    bag_used, bag_share = np.frombuffer(all_used, np.int32), np.frombuffer(all_share, np.float32).copy()
    spread = np.bincount(bag_used, minlength=BUCKETS)
    bag_share[spread[bag_used] < MIN_TEXTS] = 0
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    vectors[spread < MIN_TEXTS] = 0
    weights = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)).tolist():
            used, share = bag_used[ends[i] : ends[i + 1]], bag_share[ends[i] : ends[i + 1]]
            rate = RATE * (1 - done / steps)
            done += 1
            own = vectors[used]
            mean = share @ own
            z = mean @ weights + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[labels[i]] -= 1
            if labels[i]:
                error *= POSITIVE
            back = weights @ error
            back /= max(1.0, float(np.sqrt(back @ back)) / 10)  # labels that can't be learned mustn't let steps grow
            weights -= rate * np.outer(mean, error)
            np.clip(weights, -10, 10, out=weights)
            bias -= rate * error
            vectors[used] = own - np.outer(rate * GAIN * share, back)
    side = weights[:, 1] - weights[:, 0]
    return Model((vectors @ side).astype(np.float32), float(bias[1] - bias[0]))


def labelled(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, held_out: int = 2) -> DataFrame:
    """_id, text and label to learn from: of ``limit`` ids at most, in the order of a hash, the least text each."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_label"))
    chosen = known.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 4 != held_out).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    short = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= LONGEST)
    # the broadcast is bounded by limit; an id's rows meet as one text a task
    return short.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("_label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model of a bounded sample, trained in one task of an executor: neither texts nor bags come to the driver."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["_id"], r["text"], r["label"]) for b in batches for r in b.to_pylist())
        model = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.numbers.tobytes()], pa.binary()), pa.array([model.bias])], names=["numbers", "bias"])

    found = labelled(docs, labels, limit).repartition(1).mapInArrow(tidy(run), "numbers binary, bias double").first()
    return Model(np.frombuffer(found["numbers"], np.float32), found["bias"]) if found else train([], [])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Rows with the column ``name``: the probability of label 1."""
    textvec.unused(docs.columns, name)
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.numbers, model.bias))  # of a fixed size
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        numbers, bias = own.numbers, own.bias
        cache = Cache(CACHE)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(place)):
                words = Counter(tokens(t.as_py()))
                if not words:
                    continue
                new = cache.missing(words)
                known = cache.known
                if new:
                    # all grams of the new words at once
                    lists = [grams(w) for w in new]
                    n = np.array([len(x) for x in lists])
                    flat = numbers[np.concatenate([np.array(x) for x in lists])]
                    sums = np.add.reduceat(flat.astype(np.float64), np.concatenate([[0], np.cumsum(n)[:-1]])) / n
                    for w, number in zip(new, sums.tolist(), strict=True):
                        cache.put(w, number)
                weight = np.sqrt(np.fromiter(words.values(), float, len(words)))
                out[i] = weight @ np.fromiter(map(known.__getitem__, words), float, len(words)) / (weight.sum() + PAD)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out + bias, -50, 50))))], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scored below ``threshold``; columns as given."""
    columns = docs.columns
    (name,) = textvec.fresh(columns, "_score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) < threshold).select(*columns)
