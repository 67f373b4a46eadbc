"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters, runs of digits). Numbers, the units after them and names (capitalised words inside
a sentence) have typed placeholders, and windows of ``WINDOW`` tokens are hash-joined twice: as they read, with numbers
and units typed, and as templates, with names typed too. A document is contaminated by an item if the windows that both
share along one alignment cover ``NEEDED`` windows of it (13 tokens by default) or all of a shorter item. In template
matches windows of both sorts count together. In all matches at least five tokens of the whole span must be plain words
(as it reads: words or names), and slots have to be consistent: equal values in the item stand against equal values in
the document and different ones against different ones. Spans with fewer words, mostly slots, are compared by their raw
values.

The benchmark side is held in blocks of at most ``BLOCK_TOKENS`` tokens and an item (a larger benchmark is taken block by
block, each against all documents). A pass ends as a table in the shared folder before the next block goes out, so one
block is live on the executors at a time. Everything about a document is decided where its text is: documents aren't
shuffled.

Letters' case is folded for ASCII and Latin-1. Edge cases: null and empty texts are clean; items without tokens match
nothing; repeated items are reported each; repeated rows are judged each; extra columns are ignored or, in
``drop_contaminated``, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import textvec
from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import cut, last_cut, remove, table

WINDOW = 8
NEEDED = 6
LITERAL = 5
BLOCK_TOKENS = 1_000_000

#: Unit words, as far as they follow a number.
UNITS = (
    "mm", "cm", "dm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "pound", "pounds", "ton", "tons", "gram", "grams", "kilogram", "kilograms",
    "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds",
    "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "meter", "meters", "metre", "metres",
    "percent", "degree", "degrees",
)

_U = np.uint64
WORD, NUM, NAME, UNIT = 0, 1, 2, 3
_PLACE = textvec.mix(np.array([101, 102, 103, 104], np.uint64))
_CLASS = np.zeros(256, np.uint8)  # 0 between tokens, 1 letter, 2 digit
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n\r:;\"("]] = True
_UNIT_HASHES = np.sort(np.array([textvec.hash_word(u.encode()) for u in UNITS], np.uint64))


class Tokens:
    """Tokens of a chunk of rows: hash, kind, the same with placeholders, and the first token of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _CLASS[data]
        begin = np.empty(len(data), bool)
        begin[:1] = True
        begin[1:] = kind[1:] != kind[:-1]
        edges = offsets[1:-1]
        begin[edges[edges < len(data)]] = True
        at = np.flatnonzero(begin)
        ends = np.append(at[1:], len(data))
        solid = kind[at] > 0
        starts, ends = at[solid], ends[solid]
        digit = kind[starts] == 2
        # 3.5 and 1,234 are one number: a digit run right after another and one byte is its continuation
        glued = np.zeros(len(starts), bool)
        if len(starts):
            near = digit[1:] & digit[:-1] & (starts[1:] - ends[:-1] == 1)
            glued[1:] = near & ((data[starts[1:] - 1] == 46) | (data[starts[1:] - 1] == 44))
        folded = data
        upper = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        if upper.any():
            folded = data.copy()
            folded[1:][upper] += 0x20
        h = textvec.hash_spans(folded, starts, ends)
        if glued.any():
            # the value of a number takes its continuations in
            group = np.cumsum(~glued) - 1
            total = np.zeros(group[-1] + 1, np.uint64)
            np.add.at(total, group, textvec.mix(h + (np.arange(len(h), dtype=np.uint64) - np.flatnonzero(~glued)[group].astype(np.uint64))))
            keep = ~glued
            h = np.where(np.bincount(group)[:] > 1, total, h[keep])
            starts, digit = starts[keep], digit[keep]
        first = data[starts] if len(starts) else np.zeros(0, np.uint8)
        follow = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else first
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (follow >= 0x80) & (follow <= 0x9E))
        self.rows = np.searchsorted(starts, offsets)
        # a sentence starts with the row, or after a stop and blanks
        opening = np.zeros(len(starts), bool)
        before = np.maximum(starts - 1, 0)
        blank = textvec.SPACE[data[before]] if len(starts) else opening
        before2 = np.maximum(starts - 2, 0)
        if len(starts):
            opening = _STOP[data[before]] | (blank & _STOP[data[before2]])
        inside = self.rows[:-1][self.rows[:-1] < np.append(self.rows[1:], len(starts))[: len(self.rows) - 1]]
        opening[inside] = True
        unit = np.zeros(len(starts), bool)
        after = np.flatnonzero(digit[:-1]) + 1 if len(starts) else np.zeros(0, np.int64)
        after = after[~digit[after]] if len(after) else after
        unit[after] = np.isin(h[after], _UNIT_HASHES)
        self.kind = np.where(digit, NUM, np.where(unit, UNIT, np.where(capital & ~opening, NAME, WORD))).astype(np.uint8)
        self.value = h
        self.literal = np.where(digit, _PLACE[NUM], np.where(unit, _PLACE[UNIT], h))
        self.template = np.where(self.kind == NAME, _PLACE[NAME], self.literal)

    def windows(self, which: str, w: int) -> np.ndarray:
        tokens = getattr(self, which)
        n = len(tokens) - w + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        textvec._powers.upto(len(tokens) + 1)
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(textvec.mix(tokens) * textvec._powers.up[: len(tokens)], out=total[1:])
        at = np.arange(n)
        return textvec.spans(total, at, at + w)


def of_text(text: str | None) -> Tokens:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Tokens(data, np.array([0, len(data)], np.int64))


class Index:
    """Windows of a block of items."""

    def __init__(self, items: list[tuple[int, Tokens]], window: int):
        self.window = window
        self.items = items
        self.sizes = sorted({min(window, len(t.value)) for _, t in items if len(t.value)})
        self.tables = {}
        for w in self.sizes:
            for which in ("literal", "template", "value"):
                keys, item, pos = [], [], []
                for i, (_, t) in enumerate(items):
                    if min(window, len(t.value)) != w:
                        continue
                    hashes = t.windows(which, w)
                    # windows of slots alone are looked up by their values
                    worded = np.convolve((t.kind == WORD) | (t.kind == NAME), np.ones(w, int), "valid") > 0
                    good = ~worded if which == "value" else worded
                    if which == "template":
                        plain = np.convolve(t.kind == WORD, np.ones(w, int), "valid")
                        named = np.convolve(t.kind == NAME, np.ones(w, int), "valid")
                        # plain words are asked for over the whole span; a window without any finds nothing of its own
                        good = (plain > 0) & (named > 0)
                    keys.append(hashes[good])
                    item.append(np.full(good.sum(), i))
                    pos.append(np.flatnonzero(good))
                keys = np.concatenate(keys)
                order = np.argsort(keys, kind="stable")
                keys = keys[order]
                seen = np.zeros(1 << 20, bool)
                seen[(keys & _U((1 << 20) - 1)).astype(np.int64)] = True
                self.tables[w, which] = keys, np.concatenate(item)[order], np.concatenate(pos)[order], seen

    def hits(self, tokens: Tokens, w: int, which: str) -> Iterator[tuple[int, int, int]]:
        """(place in the chunk, item, place in the item)."""
        keys, item, pos, seen = self.tables[w, which]
        found = tokens.windows(which, w)
        maybe = np.flatnonzero(seen[(found & _U((1 << 20) - 1)).astype(np.int64)])
        maybe = maybe[np.isin(found[maybe], keys)]
        if not len(maybe):
            return
        row = np.searchsorted(tokens.rows, maybe, "right")
        maybe = maybe[row == np.searchsorted(tokens.rows, maybe + w - 1, "right")]
        low, high = np.searchsorted(keys, found[maybe], "left"), np.searchsorted(keys, found[maybe], "right")
        for p, a, b in zip(maybe.tolist(), low.tolist(), high.tolist(), strict=True):
            for k in range(a, b):
                yield p, int(item[k]), int(pos[k])

    def slots(self, tokens: Tokens, item: Tokens, shift: int, places: set[int], w: int) -> set[tuple[int, int, int]]:
        """(kind, value in the item, value in the document) of the slots in the item's windows at ``places``."""
        span = {p + k for p in places for k in range(w)}
        return {(int(item.kind[q]), int(item.value[q]), int(tokens.value[q + shift])) for q in span if item.kind[q] != WORD}

    @staticmethod
    def consistent(slots: set[tuple[int, int, int]]) -> bool:
        """Whether slots map one to one."""
        return len({(kind, a) for kind, a, _ in slots}) == len({(kind, b) for kind, _, b in slots}) == len(slots)

    def together(self, tokens: Tokens, item: Tokens, row: int, shift: int, w: int) -> tuple[set[int], set[int], set[int]]:
        """Places of the item whose windows along one alignment are equal token by token: by value, as they read, and as they read or as templates."""
        low, high = max(0, int(tokens.rows[row]) - shift), min(len(item.value), int(tokens.rows[row + 1]) - shift)
        if high - low < w:
            return set(), set(), set()
        there = slice(low + shift, high + shift)
        value = item.value[low:high] == tokens.value[there]
        literal = item.literal[low:high] == tokens.literal[there]
        either = literal | (item.template[low:high] == tokens.template[there])
        value, literal, either = (set((np.flatnonzero(np.convolve(x, np.ones(w, int), "valid") == w) + low).tolist()) for x in (value, literal, either))
        return value, literal, either

    def worded(self, item: Tokens, places: set[int], w: int, kinds: tuple[int, ...]) -> bool:
        """Whether the span at ``places`` has enough tokens of these kinds."""
        span = {p + k for p in places for k in range(w)}
        return sum(item.kind[q] in kinds for q in span) >= max(1, min(LITERAL, w - 1))

    def exact(self, tokens: Tokens, item: Tokens, parts: list[tuple[int, set[int], set[int]]], w: int, need: int) -> bool:
        """Whether alignments (shift, places by value, places as they read) add up: an edit shifts what follows it."""
        if len(set().union(*(value for _, value, _ in parts))) >= need:
            return True
        own = []
        for shift, value, literal in parts:
            slots = self.slots(tokens, item, shift, literal, w)
            if not self.consistent(slots):
                literal, slots = value, self.slots(tokens, item, shift, value, w)
            if literal:
                own.append((literal, slots))
        own.sort(key=lambda x: -len(x[0]))
        if len(set().union(*(places for places, _ in own))) < need:
            return False
        # alignments that agree about the slots, around each of them in turn
        for places, slots in own:
            for others, more in own:
                if len(places) < need and not others <= places and self.consistent(slots | more):
                    places, slots = places | others, slots | more
            if len(places) >= need and self.worded(item, places, w, (WORD, NAME)):
                return True
        return False

    def judge(self, tokens: Tokens, needed: int) -> dict[int, dict[int, str]]:
        """Items by row, and whether the match is exact (as it reads) or by template."""
        aligned: dict[tuple, set[int]] = {}
        for (w, which) in self.tables:
            for p, i, q in self.hits(tokens, w, which):
                row = int(np.searchsorted(tokens.rows, p, "right")) - 1
                aligned.setdefault((row, i, w), set()).add(p - q)
        found: dict[int, dict[int, str]] = {}
        for (row, i, w), shifts in aligned.items():
            item = self.items[i][1]
            need = min(needed, len(item.value) - w + 1)
            parts = [(shift, *self.together(tokens, item, row, shift, w)) for shift in sorted(shifts)]
            if self.exact(tokens, item, [p[:3] for p in parts], w, need):
                found.setdefault(row, {})[i] = "exact"
            elif any(len(x) >= need and self.worded(item, x, w, (WORD,)) and self.consistent(self.slots(tokens, item, shift, x, w)) for shift, _, _, x in parts):
                found.setdefault(row, {})[i] = "template"
        return found


def blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_TOKENS) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, streamed through the driver one at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        tokens = of_text(row["text"])
        if len(tokens.value) and row["item_id"] is not None:
            held.append((row["item_id"], tokens))
            size += len(tokens.value)
        if size >= limit:
            yield Index(held, window)
            held, size = [], 0
    if held:
        yield Index(held, window)


def passes(df: DataFrame, benchmark: DataFrame, window: int, limit: int, step: Callable[[DataFrame, Broadcast, bool], DataFrame]) -> DataFrame:
    """``df`` after ``step`` (rows, block, whether it is the last) for each block of the benchmark, one block at a time."""
    spark = df.sparkSession
    rest = blocks(benchmark, window, limit)
    index, before = next(rest, None), None
    while index is not None:
        shared = spark.sparkContext.broadcast(index)
        index = next(rest, None)
        df = step(df, shared, index is None)
        if index is not None:
            df = cut(df)
            shared.destroy()
            if before:
                remove(spark, before)
            before = last_cut()
    return df


def _judge(shared, needed: int, keep: bool):
    """Rows (doc_id, items, exact, text) with the items of one more block; ``keep``: with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for first, end, data, offsets in textvec.chunks(batch.column(3)):
                found = index.judge(Tokens(data, offsets), needed) if len(data) else {}
                own = batch.slice(first, end - first)
                of_row = [found.get(r, {}) for r in range(end - first)]
                ids = [sorted([*x, *(index.items[i][0] for i in f)]) for x, f in zip(own.column(1).to_pylist(), of_row, strict=True)]
                exact = [x or any(v == "exact" for v in f.values()) for x, f in zip(own.column(2).to_pylist(), of_row, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(exact, pa.bool_()), *([own.column(3)] if keep else [])], names=own.schema.names[: 3 + keep])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, needed: int = NEEDED, limit: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, comma-joined), kind (exact, template or null) of each row."""
    spark = docs.sparkSession
    ready(spark)
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("CAST(array() AS array<long>)").alias("items"), F.lit(False).alias("exact"), "text")
    # one block after another over the same rows, so repeated rows stay apart
    judged = passes(judged, benchmark, window, limit, lambda rows, shared, last: rows.mapInArrow(
        _judge(shared, needed, not last), "doc_id long, items array<long>, exact boolean" + ", text string" * (not last)))
    n = F.size("items").cast("long")
    return judged.select(
        "doc_id",
        (n > 0).alias("contaminated"),
        n.alias("n_items"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
        F.when(F.col("exact"), "exact").when(n > 0, "template").alias("kind"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, needed: int = NEEDED, limit: int = BLOCK_TOKENS) -> DataFrame:
    """Documents that hold no benchmark item; columns as given."""
    columns = docs.columns
    ready(docs.sparkSession)
    place = columns.index("text")

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in batches:
                for first, end, data, offsets in textvec.chunks(batch.column(place)):
                    found = index.judge(Tokens(data, offsets), needed) if len(data) else {}
                    yield batch.slice(first, end - first).filter(pa.array([r not in found for r in range(end - first)], pa.bool_()))

        return run

    return passes(docs, benchmark, window, limit, lambda rows, shared, last: rows.mapInArrow(keep(shared), rows.schema))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
