"""Byte-level BPE by corpus-level merge replay.

The distinct pretokens of a batch are laid out in one linked sequence of byte tokens. An inverted index maps each
pair's rank to the positions that hold the pair; merges are applied in rank order over all words at once, and only
the touched neighbours get new entries. Words never interact, so the ids of a word are those that merging the word
alone, lowest rank first and leftmost first, gives.

Pretokens never interact, so a replay over any set of them gives the same ids: each task replays the distinct pretokens
of a run of texts that it hasn't seen, ``TOGETHER`` at a time under one index, and keeps their ids within ``CACHE``
bytes until it ends. An index over the pretokens of the whole corpus would need one machine to hold them.

Edge cases: null and empty texts have no tokens (and the digests of the empty string); repeated rows are encoded each;
an empty table gives no rows; one very long text is a run of its own; extra columns are left out, or kept where ``keep``
names them (a ValueError where they have a new column's name); merges of one rank within a word go from left to right; a rank file must cover the 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidewheel.llm import textvec
from tidewheel.llm.worker import Cache, ready, tidy
from tidewheel.runtime import table

#: Bytes of a generation of pretokens with their ids, of two that a task keeps.
CACHE = 48 << 20
#: Pretokens whose merges are replayed together: few enough for their places to stay in a core's cache.
TOGETHER = 4_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Ranks:
    """A rank file as numbers: the id of each byte, the id that each mergeable pair of ids gives, the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.texts = {r: str(r) for r in self.tokens}
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.of_bytes = np.array(self.byte, np.int64)
        self.byte_pairs = np.array([[self.pairs.get(a << 32 | b, -1) for b in self.byte] for a in self.byte], np.int64)


def merge_replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Ids of each word."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return [[] for _ in words]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ends, starts = np.zeros(n, bool), np.zeros(n, bool)
    full = np.flatnonzero(np.diff(bounds))
    starts[bounds[:-1][full]] = True
    ends[bounds[1:][full] - 1] = True
    token = ranks.of_bytes[raw].tolist()
    after = np.where(ends, -1, np.arange(1, n + 1)).tolist()
    before = np.where(starts, -1, np.arange(-1, n - 1)).tolist()
    # the rank that merging each place with its right neighbour gives, and the places of each rank
    pair = np.full(n, -1, np.int64)
    pair[:-1] = ranks.byte_pairs[raw[:-1], raw[1:]]
    pair[ends] = -1
    places_of = np.flatnonzero(pair >= 0)
    order = places_of[np.argsort(pair[places_of], kind="stable")]
    found, first = np.unique(pair[order], return_index=True)
    order, cuts = order.tolist(), [*first.tolist(), len(order)]
    heap: list[int] = found.tolist()  # sorted, so a heap
    index: dict[int, list[int]] = {r: order[cuts[k] : cuts[k + 1]] for k, r in enumerate(heap)}
    want = pair.tolist()
    get, push, pop = ranks.pairs.get, heapq.heappush, heapq.heappop
    while heap:
        rank = pop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        high = rank << 32
        waiting: set[int] = set()  # words in which a lower rank has come up: that one goes first
        later: list[int] = []
        for i in places:
            if waiting and int(np.searchsorted(bounds, i, "right")) in waiting:
                later.append(i)
                continue
            if want[i] != rank:  # a stale entry: its pair was changed by an earlier merge
                continue
            j = after[i]
            k = after[i] = after[j]
            token[i] = rank
            token[j] = want[j] = -1
            if k >= 0:
                before[k] = i
                r = want[i] = get(high | token[k], -1)
                if r >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(heap, r)
                    if r < rank:
                        waiting.add(int(np.searchsorted(bounds, i, "right")))
            else:
                want[i] = -1
            h = before[i]
            if h >= 0:
                r = want[h] = get(token[h] << 32 | rank, -1)
                if r >= 0:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        push(heap, r)
                    if r < rank:
                        waiting.add(int(np.searchsorted(bounds, i, "right")))
        if later:
            if rank in index:
                index[rank].extend(later)
            else:
                index[rank] = later
                push(heap, rank)
    left = np.array(token)
    kept = left >= 0
    count = np.concatenate([[0], np.cumsum(kept)])[bounds].tolist()
    ids = left[kept].tolist()
    return [ids[a:b] for a, b in zip(count[:-1], count[1:], strict=True)]


class Encoder:
    """Encodes texts; keeps the ids of the distinct pretokens of its task, within bounds."""

    def __init__(self, ranks: Ranks | dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks = ranks if isinstance(ranks, Ranks) else Ranks(ranks)
        self.find = regex.compile(pattern).findall
        self.cache = Cache(cache)

    def learn(self, pretokens: set[str]) -> dict[str, tuple[int, ...]]:
        new = self.cache.missing(pretokens)
        for a in range(0, len(new), TOGETHER):
            part = new[a : a + TOGETHER]
            for w, ids in zip(part, merge_replay([w.encode() for w in part], self.ranks), strict=True):
                self.cache.put(w, tuple(ids), 8 * len(ids))
        return self.cache.known

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        split = [self.find(t) for t in texts]
        known = self.learn({w for s in split for w in s})
        for s in split:
            ids: list[int] = []
            for w in s:
                ids.extend(known[w])
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))


def groups(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``limit`` characters with the number of the first; null is empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= limit:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run


#: Number tables of the last rank file that this worker used: of a fixed size.
_ranks: dict[str, Ranks] = {}


def _encoder(shared: str, pattern: str) -> Encoder:
    """An encoder for one task."""
    if shared not in _ranks:
        _ranks.clear()
        _ranks[shared] = Ranks(load_ranks(SparkFiles.get(shared)))
    return Encoder(_ranks[shared], pattern)


def _share(spark: SparkSession, path: str) -> str:
    """Send the rank file (a fixed, small table) to every executor under a name that its content gives."""
    with open(path, "rb") as f:
        data = f.read()
    name = f"ranks-{hashlib.sha256(data).hexdigest()[:32]}"
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        own = f"{tempfile.mkdtemp()}/{name}"  # the driver serves it from there
        with open(own, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(own)
    return name


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids array<int>, decoded binary of each row."""
    spark = docs.sparkSession
    textvec.unused(list(keep), "ids", "decoded")
    ready(spark)
    name = _share(spark, path)
    given = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([*given.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for first, run_of in groups(texts):
                ids = list(encoder.encode(run_of))
                own = [batch.column(i).slice(first, len(run_of)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in ids], pa.binary())],
                    names=schema.names,
                )

    return given.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256, made beside the ids so that these needn't travel."""
    spark = docs.sparkSession
    textvec.unused(list(keep), "n_tokens", "ids_sha256", "decoded_sha256")
    ready(spark)
    name = _share(spark, path)
    given = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([*given.schema.fields[:-1], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        sha, decimal = hashlib.sha256, encoder.ranks.texts.__getitem__
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            count, of_ids, of_bytes = [], [], []
            for _, run_of in groups(texts):
                for ids in encoder.encode(run_of):
                    count.append(len(ids))
                    of_ids.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                    of_bytes.append(sha(encoder.decode(ids)).hexdigest())
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names)

    return given.mapInArrow(tidy(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
