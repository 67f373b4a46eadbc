"""Cross-tokenizer alignment: groups and links of the tokens that two tokenizers make of the same bytes.

Python tokenises, and takes digests and counts of a row's arrays once Spark has aligned them (``digests``): a row gets, of either side, the ids, the ends (byte offsets), and places (end and position packed
in one long). The alignment is Spark's array functions. ``array_intersect`` of the ends gives where groups end. The places
of both sides, sorted together, are a ``sequence`` in which token i of A stands at i plus the number of B tokens that end
before it, so the partner of every token is an index away: ``transform`` makes each distinct end a link of the A and the B
token that cover the bytes before it, and each common end the last tokens of a group. Every step is linear in the tokens but
the sort, which meets two sorted runs.

A pair's count over the corpus is an aggregate of the documents' distinct pairs; documents are then joined with the counts:
by broadcast up to ``BROADCAST`` pairs, beyond that by a shuffle on the pair, whose hot keys adaptive execution splits.

A is a byte-level BPE from a file of the tokenizers library; B is a sentencepiece model. Where A's file is plain byte-level
BPE with ids in merge order, its merges are run by tiktoken, several times as fast and with the same ids; texts that this
refuses, and other files, go to the tokenizers library.

Edge cases: null and empty texts, and texts that either side doesn't give back byte by byte, have no tokens and zero
counts; special tokens' strings are plain text; a row counts as one document, repeated rows each; pairs of one A id with
equally high counts are all its best; very long texts are aligned whole (offsets stay below 2 GB); an empty table gives
no rows; extra columns are left out unless ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tidewheel.llm.worker import Cache, ready, tidy
from tidewheel.runtime import cut, table

#: Bytes of a generation of chunks with their ids, of two that a task keeps.
CACHE = 32 << 20
#: New chunks that are encoded as one text.
TOGETHER = 2000
#: Characters of text whose tokens are made at once (a longer text is taken whole): arrays of them are some 40 times as large.
PORTION = 1 << 18
#: What stands for a space in pieces.
SPACE = "\u2581"
#: Pairs of ids that are broadcast at most (about 50 bytes each).
BROADCAST = 1 << 20
#: A place is end << 32 | side << 31 | position.
SIDE, POSITION = 1 << 31, (1 << 31) - 1

# The split of byte-level BPE, and its alphabet: printable bytes are themselves, the others follow from 256.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + n): b for n, b in enumerate(others)}


class SideA:
    """Byte-level BPE: ids of a text, bytes of an id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={self.bytes[i]: i for t, i in vocab.items() if t not in special}, special_tokens={}) if _plain(spec, special) else None

    @cached_property
    def library(self) -> Tokenizer:
        """Made when it is needed first: mostly never."""
        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None where they don't give the text back."""
        out = []
        for t in texts:
            ids = self._ids(t)
            out.append(np.array(ids, np.int32) if b"".join(map(self.bytes.__getitem__, ids)) == t.encode() else None)
        return out

    def _ids(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # very long runs may overflow its pattern engine, which comes as a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        return self.library.encode(text, add_special_tokens=False).ids


def _plain(spec: dict, special: set[str]) -> bool:
    """Whether a file is byte-level BPE with the usual split, nothing else, and ids in the order of its merges."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("fuse_unk") or model.get("byte_fallback"):
        return False
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = [i for t, i in vocab.items() if len(t) == 1]
    return made == sorted(set(made)) and len(single) == 256 and max(single) < min(made, default=256) and len(made) + 256 == sum(t not in special for t in vocab)


class SideB:
    """Pieces of a sentencepiece model.

    Where no piece goes on behind a space or a line feed that it doesn't begin with, merges never cross into one, so a text is
    encoded chunk by chunk, each distinct chunk of a task once.
    """

    chunks = re.compile(r"\x20+[^\x20\n]*|\n+[^\x20\n]*")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        inside = any("\n" in p or SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if not self.model.is_control(i))
        self.apart = not inside and all(self._back(t) for t in ("a  b", "  a", "a ", "\n a\n\nb \n", "\t", "ﬁ Å ²"))
        self.lengths = np.array([len(b) for b in self.bytes])
        self.cache = Cache(CACHE)

    def _back(self, text: str) -> bool:
        """Whether the model changes nothing."""
        return b"".join(self.bytes[i] for i in self.model.encode(text)) == f" {text}".encode()

    def _learn(self, new: list[str]) -> None:
        """New chunks are encoded as one text and cut at their ends; chunks of spaces alone would run into the next one."""
        one = [c for c in new if c[-1] == " "]
        together = [c for c in new if c[-1] != " "]
        for at in range(0, len(together), TOGETHER):
            part = [" .", *together[at : at + TOGETHER]]
            ids = self._whole("".join(part))
            if ids is None:  # some chunk doesn't come back
                one += part[1:]
                continue
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            raw = ids.tobytes()
            for c, start, end in zip(part[1:], (4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist(), strict=True):
                self.cache.put(c, raw[start:end], end - start)
        for c in one:
            # spaces alone stand before a line feed or an end; behind a line feed the model's own space stands alone
            before, after = "" if c[0] == " " else " .", "\n" if c[-1] == " " else ""
            ids = self._whole(before + c + after)
            first, last = len(self.model.encode(before[1:])), len(after)
            self.cache.put(c, None if ids is None else ids[first : len(ids) - last].tobytes(), 20)

    def _whole(self, text: str) -> np.ndarray | None:
        ids = self.model.encode(text[1:])
        return np.array(ids, np.int32) if b"".join(map(self.bytes.__getitem__, ids)) == text.encode() else None

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text with the space before it; None where they don't give the text back."""
        if not self.apart:
            return [self._whole(t) for t in texts]
        split = [self.chunks.findall(t) for t in texts]
        new = self.cache.missing(dict.fromkeys(chain.from_iterable(split)))
        if new:
            self._learn(new)
        known = self.cache.known.__getitem__
        out = []
        for chunks in split:
            try:
                out.append(np.frombuffer(b"".join(map(known, chunks)), np.int32))
            except TypeError:  # a chunk that doesn't come back
                out.append(None)
        return out


NONE = np.zeros(0, np.int32)
#: The last two files that this worker used: of a fixed size.
_sides: dict[str, tuple] = {}


def _load(kind: type, name: str) -> tuple:
    """A side and the lengths of its ids."""
    if name not in _sides:
        while len(_sides) > 1:
            _sides.pop(next(iter(_sides)))
        side = kind(SparkFiles.get(name))
        _sides[name] = side, np.array([len(b) for b in side.bytes], np.int64)
    return _sides[name]


def share(spark: SparkSession, path: str) -> str:
    """Send a vocabulary (a fixed, small file) to every executor under a name that its content gives."""
    with open(path, "rb") as f:
        data = f.read()
    name = f"vocabulary-{hashlib.sha256(data).hexdigest()[:32]}"
    if name not in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        own = f"{tempfile.mkdtemp()}/{name}"  # the driver serves it from there
        with open(own, "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(own)
    return name


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``PORTION`` characters in its last column."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    begins = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PORTION, prepend=-1))
    for start, stop in zip(begins.tolist(), np.append(begins[1:], len(sizes)).tolist(), strict=True):
        yield batch.slice(start, stop - start)


def tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, and of either side ids, ends and places: arrays a_ids, a_ends, a_at, b_ids, b_ends, b_at."""
    spark = docs.sparkSession
    ready(spark)
    name_a, name_b = share(spark, path_a), share(spark, path_b)
    given = docs.select(*keep, F.col(text).alias("_text"))
    kinds = {"ids": IntegerType(), "ends": IntegerType(), "at": LongType()}
    schema = StructType([*given.schema.fields[:-1], *(StructField(f"{s}_{c}", ArrayType(k, False)) for s in "ab" for c, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [_load(SideA, name_a), _load(SideB, name_b)]
        sides[1][0].cache = Cache(CACHE)  # ends with the task
        for batch in chain.from_iterable(map(_portions, batches)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            whole = [" " + texts[i] for i in full]
            ids = [side.encode(whole) for side, _ in sides]
            columns = []
            for k, (_, lengths) in enumerate(sides):
                # both sides have to give the text back
                kept = [NONE if x is None or y is None else (x, y)[k] for x, y in zip(*ids, strict=True)]
                counts = np.zeros(len(texts), np.int64)
                counts[full] = [len(x) for x in kept]
                flat = np.concatenate([NONE, *kept])
                stops = np.cumsum(counts)
                size = np.concatenate([[0], np.cumsum(lengths[flat])])
                ends = size[1:] - np.repeat(size[stops - counts], counts)
                place = np.arange(len(flat)) - np.repeat(stops - counts, counts)
                columns += [_lists(flat, counts, pa.int32()), _lists(ends, counts, pa.int32()), _lists(ends << 32 | k << 31 | place, counts, pa.int64())]
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=schema.names)

    return given.mapInArrow(tidy(run), schema)


def _position(place: Column) -> Column:
    return place.bitwiseAND(F.lit(POSITION))


def cuts(rows: DataFrame) -> DataFrame:
    """Rows of ``tokens`` with n_groups, cuts (the end of each group: the bitwise not of the positions of its last tokens, A << 32 |
    B) and links (sorted longs, a << 32 | b, one for each pair of tokens that share a byte)."""
    names = [c for c in rows.columns if c not in ("a_ends", "b_ends", "a_at", "b_at")]
    merged = rows.select(
        *names,
        F.size(F.array_intersect("a_ends", "b_ends")).alias("n_groups"),
        F.sort_array(F.concat("a_at", "b_at")).alias("_at"),
        F.col("a_ids").cast("array<long>").alias("_high"),
    )
    link = lambda a, b: F.shiftleft(F.get("_high", a), 32).bitwiseOR(F.get("b_ids", b))
    # The A token of an end comes before the B token of the same end, which makes no link but closes a group: as the bitwise not
    # of the positions of its last A and B token, so that sorting brings groups before links, the last group first.
    linked = lambda x, i: F.coalesce(
        F.when(x.bitwiseAND(F.lit(SIDE)) == 0, link(_position(x), i - _position(x)))
        .when(x.bitwiseXOR(F.get("_at", i - 1)) < (1 << 32), F.bitwise_not(F.shiftleft(i - 1 - _position(x), 32).bitwiseOR(_position(x))))
        .otherwise(link(i - _position(x), _position(x))),
        F.lit(0).cast("long"),
    )
    made = merged.withColumn("_all", F.sort_array(F.transform("_at", linked)))
    return made.select(*names, "n_groups", F.reverse(F.slice("_all", F.lit(1), F.col("n_groups"))).alias("cuts"), F.slice("_all", F.col("n_groups") + 1, F.greatest(F.size("_all") - F.col("n_groups"), F.lit(0))).alias("links"))


def align(rows: DataFrame) -> DataFrame:
    """Rows of ``tokens`` with n_a, n_b, n_groups, groups (strings ``a1,a2|b1`` of the ids of each group) and links (as in
    ``cuts``)."""
    ends = cuts(rows)
    names = [c for c in ends.columns if c not in ("n_groups", "cuts", "links")]
    last_a, last_b = (lambda c: F.shiftright(F.bitwise_not(c), 32).cast("int")), (lambda c: F.bitwise_not(c).bitwiseAND(F.lit(POSITION)).cast("int"))

    def side(ids: str, last: Callable[[Column], Column], cut: Column, before: Column) -> Column:
        """The ids behind the group before, up to this group's last."""
        start = F.coalesce(last(before) + 1, F.lit(0))
        return F.array_join(F.slice(ids, start + 1, last(cut) - start + 1).cast("array<string>"), ",")

    def group(cut: Column, k: Column) -> Column:
        """Mostly one token of either side, one further than the group before."""
        before = F.get("cuts", k - 1)
        pair = F.concat(F.get("a_ids", last_a(cut)).cast("string"), F.lit("|"), F.get("b_ids", last_b(cut)).cast("string"))
        return F.when(before - cut == (1 << 32) + 1, pair).otherwise(F.concat(side("a_ids", last_a, cut, before), F.lit("|"), side("b_ids", last_b, cut, before)))

    return ends.select(*names, F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), "n_groups", F.transform("cuts", group).alias("groups"), "links")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each row's begin and the last ones end."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def _runs(links: pa.ListArray) -> pa.ListArray:
    """Each row's sorted values as (pair, n): each once, and how often it is there."""
    flat, offsets = _flat(links)
    new = np.diff(flat, prepend=0) != 0
    new[offsets[:-1][offsets[:-1] < len(flat)]] = True
    starts = np.flatnonzero(new)
    runs = pa.StructArray.from_arrays([pa.array(flat[starts]), pa.array(np.diff(starts, append=len(flat)), pa.int32())], ["pair", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int32()), runs)


PAIRS = ArrayType(StructType([StructField("pair", LongType(), False), StructField("n", IntegerType(), False)]), False)


def distinct_pairs(rows: DataFrame, links: str = "links", name: str = "pairs") -> DataFrame:
    """Rows with ``name``: array of (pair, n), the distinct links with how often the row has them. ``links``, sorted, goes."""
    ready(rows.sparkSession)
    kept = [c for c in rows.columns if c != links]
    schema = StructType([*(rows.schema[c] for c in kept), StructField(name, PAIRS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), _runs(batch.column(len(kept)))], names=schema.names)

    return rows.select(*kept, links).mapInArrow(tidy(run), schema)


#: Of each id (up to the largest seen) its decimals before a comma, a bar and a semicolon: of a vocabulary's size.
_decimals: list[bytes] = []


def _listings(a_ids: pa.ListArray, b_ids: pa.ListArray, cuts: pa.ListArray) -> Iterator[bytes]:
    """Of each row ``a1,a2|b1;a3|b2,b3``: each token before its mark, those of A before those of B in a group."""
    (a, a_at), (b, b_at), (last, of) = map(_flat, (a_ids, b_ids, cuts))
    if not len(last):
        yield from [b""] * len(a_ids)
        return
    counts = np.diff(of)
    last_a = (~last >> 32) + np.repeat(a_at[:-1], counts)
    last_b = (~last & POSITION) + np.repeat(b_at[:-1], counts)
    code = np.empty(len(a) + len(b), np.int64)
    # a token stands behind all of its own side before it, and behind the other side's groups before (B: and its own group's A)
    for ids, ends, other, mark in ((a, last_a, np.append(0, last_b[:-1] + 1), 1), (b, last_b, last_a + 1, 2)):
        closes = np.zeros(len(ids), np.int64)
        closes[ends] = 1
        code[np.arange(len(ids)) + other[np.cumsum(closes) - closes]] = 3 * ids.astype(np.int64) + mark * closes
    for i in range(len(_decimals) // 3, int(code.max()) // 3 + 1):
        _decimals.extend(b"%d%c" % (i, c) for c in b",|;")
    text = list(map(_decimals.__getitem__, code.tolist()))
    stops = (a_at + b_at).tolist()
    for start, stop in zip(stops, stops[1:], strict=False):
        yield b"".join(text[start:stop])[:-1]


def digests(rows: DataFrame) -> DataFrame:
    """Rows of ``cuts`` with n_a, n_b, n_links, groups_sha256 (of the groups as ``align`` writes them, joined by ``;``; without tokens
    '') and pairs (as in ``distinct_pairs``) in place of the arrays."""
    ready(rows.sparkSession)
    arrays = ("a_ids", "b_ids", "cuts", "links")
    given = rows.select(*(c for c in rows.columns if c not in arrays), *(F.size(c).alias(n) for c, n in (("a_ids", "n_a"), ("b_ids", "n_b"), ("links", "n_links"))), *arrays)
    kept = len(given.columns) - len(arrays)
    schema = StructType([*given.schema.fields[:kept], StructField("groups_sha256", StringType()), StructField("pairs", PAIRS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *ids_and_cuts, links = (batch.column(kept + k) for k in range(len(arrays)))
            told = [hashlib.sha256(x).hexdigest() if x else "" for x in _listings(*ids_and_cuts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), pa.array(told, pa.string()), _runs(links)], names=schema.names)

    return given.mapInArrow(tidy(run), schema)


def counts(pairs: DataFrame) -> DataFrame:
    """pair, documents, best: how many rows hold each pair, and whether no other pair of its A id is held by more.

    ``pairs``: rows with ``pair``, each once a document.
    """
    held = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    of = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as B has ids at most
    return held.select("pair", "documents", (F.col("documents") == F.max("documents").over(of)).alias("best"))


def scores(rows: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """Rows of (row, pairs) to (row, n_best, count_sum); rows without pairs are left out. ``rows`` is read twice."""
    each = rows.select("row", F.explode("pairs").alias("p")).select("row", "p.pair", "p.n")
    found = cut(counts(each))
    known = F.broadcast(found) if found.count() <= broadcast else found.hint("shuffle_merge")
    links = each.join(known, "pair")
    return links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = digests(cuts(tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))))
    rows = cut(told.withColumn("row", F.monotonically_increasing_id()))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(scores(rows), "row", "left").select("doc_id", *map(whole, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "groups_sha256")
