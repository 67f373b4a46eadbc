"""Repair of conversation structure by A* on the edit lattice.

A node of the lattice is (rows read, state of the role grammar ``(s?(ua)+)?``). Edits lead from node to node: Keep a row
(cost 0), Rerole it to user or assistant (3), Delete it (4; the only edit of blank and duplicate rows), Insert an empty
user or assistant row (3). A truncated row that isn't deleted costs 3 more. The heuristic of a node is the suffix sum of
what no edit avoids: 4 for each row that has to go, 3 for each truncated one. Entries are keyed (cost plus heuristic,
audit), the audit being the initials of the edits so far, so that the first entry to reach a node is its cheapest and of
equal costs the ASCII-least: the heuristic never falls along an edge, and two equally cheap audits of one node never
are one the other's beginning, for what they differ by would be inserts.

Long conversations are searched in blocks of ``BLOCK`` rows, from each state that the rows before can end in to each
state that the block can end in. Of each state only the cheapest, ASCII-least way goes on, with the digest of its
repaired text so far; so texts are held for one block, and a search is bounded however long a conversation is. What
grows with it is its audit, which its result row holds anyway.

Rows are ordered by turn (nulls first), then role and text. Whether a text was seen in an earlier turn is found by an
aggregate over the hashes of (conversation, role, text) and a join, so no set of texts is kept either. The digest of a
conversation is one of all its text in order: its rows stream through one task, sorted by Spark.

Edge cases: nulls in role and text count as one space; a null conv_id is one conversation; rows that repeat exactly are
adjacent, the later ones duplicates; an empty role or one of another initial can't be kept; a conversation all of whose
rows were dropped has zeros, an empty audit and the digest of the empty string; an empty table gives no rows; very long
texts count whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import table

#: Rows that are searched together, and their characters beyond which fewer are.
BLOCK, BLOCK_CHARS = 64, 1 << 22
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
LEGAL = ("su", "ua", "au")
#: States of the grammar: nothing yet, after a system row, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state to which the initial of a role leads from each state.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (EMPTY, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    fault: int


def fault(text: str, seen: bool) -> int:
    """The first fault of a row."""
    bare = text.rstrip(_BLANKS)
    if not bare:
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if bare[-1] in ".!?" else TRUNCATED


def search(rows: list[Row], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """The least cost and, of equal ones, the ASCII-least audit that leads from ``start`` behind the rows, for each state that
    can be reached; if ``last``, only for the ends of the grammar."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i].fault in (BLANK, DUPLICATE) else CUT if rows[i].fault == TRUNCATED else 0)
    goals = set(ENDS) if last else set(range(4))
    found: dict[int, tuple[int, str]] = {}
    closed: set[tuple[int, int]] = set()
    heap = [(rest[0], "", 0, start)]

    def push(cost: int, audit: str, i: int, state: int) -> None:
        if (i, state) not in closed:
            heapq.heappush(heap, (cost + rest[i], audit, i, state))

    while heap and (not last or not found):
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = key - rest[i]
        if i == n and state in goals:
            found[state] = cost, audit
        steps = STEPS[state]
        for name in "ua":
            if name in steps:
                push(cost + INSERT, audit + "I", i, steps[name])
        if i == n:
            continue
        row = rows[i]
        push(cost + DELETE, audit + "D", i + 1, state)
        if row.fault in (BLANK, DUPLICATE):
            continue
        extra = CUT if row.fault == TRUNCATED else 0
        if row.role[:1] in steps:
            push(cost + extra, audit + "K", i + 1, steps[row.role[:1]])
        for name in "ua":
            if name in steps:
                push(cost + extra + REROLE, audit + "R", i + 1, steps[name])
    return found


def apply(rows: list[Row], audit: str, state: int) -> Iterator[str]:
    """``role:text`` of each row that the audit leaves or makes, from a state of the grammar."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        row = None if edit == "I" else rows[at]
        state = STEPS[state][row.role[:1]] if edit == "K" else STEPS[state]["u" if "u" in STEPS[state] else "a"]
        yield f"{row.role if edit == 'K' else NAMES[state]}:{row.text if row else ''}"
        at += row is not None


@dataclass
class Way:
    """The best way to a state so far."""

    cost: int
    audit: str
    digest: object
    begun: bool


@dataclass
class Conversation:
    """One conversation, row by row in order."""

    conv_id: int | None
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    before: tuple | None = None
    block: list[Row] = field(default_factory=list)
    chars: int = 0
    ways: dict[int, Way] = field(default_factory=lambda: {EMPTY: Way(0, "", hashlib.sha256(), False)})

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        kind = fault(text, seen or self.before == (turn, role, text))
        if kind != SOUND:
            self.counts[kind] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += self.high != turn
            self.low, self.high = turn if self.low is None else self.low, turn
        self.before = turn, role, text
        self.block.append(Row(role, text, kind))
        self.chars += len(text)
        if len(self.block) > BLOCK or self.chars > BLOCK_CHARS:
            self.advance(False)

    def advance(self, last: bool) -> None:
        """Through the block: of each state the best way to it."""
        best: dict[int, tuple[int, str, int, str]] = {}
        for state, way in self.ways.items():
            for end, (cost, audit) in search(self.block, state, last).items():
                entry = way.cost + cost, way.audit + audit, state, audit
                if end not in best or entry[:2] < best[end][:2]:
                    best[end] = entry
        if last:  # of both ends the better one
            end = min(best, key=lambda e: best[e][:2])
            best = {end: best[end]}
        ways = {}
        for end, (cost, audit, state, own) in best.items():
            digest, begun = self.ways[state].digest.copy(), self.ways[state].begun
            for line in apply(self.block, own, state):
                digest.update(f"\n{line}".encode() if begun else line.encode())
                begun = True
            ways[end] = Way(cost, audit, digest, begun)
        self.ways, self.block, self.chars = ways, [], 0

    def result(self) -> dict:
        self.advance(True)
        (way,) = self.ways.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        blank, duplicate, truncated = self.counts
        return dict(conv_id=self.conv_id, gaps=gaps, blank=blank, duplicate=duplicate, truncated=truncated, illegal=self.illegal, cost=way.cost, audit=way.audit, repaired_sha256=way.digest.hexdigest())


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: the rows with a fault by crc32 of ``conv_id:turn``; a dropped row stays with ``there``
    false and no text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    made = rows.select(
        "conv_id",
        F.when(F.col("kind") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("kind") == 4, "user").when(F.col("kind") == 0, "").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("there"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return made.drop("_copy")


def _key(conv_id: Column, role: Column, text: Column) -> Column:
    """256 bits of a conversation's role and text."""
    return F.unhex(F.sha2(F.concat_ws("\x1f", F.coalesce(conv_id.cast("string"), F.lit(" ")), F.char_length(role).cast("string"), role, text), 256))


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text, there): its faults, and its cheapest repair as audit and digest.

    ``there`` false marks a row that only says that the conversation is one.
    """
    spark = rows.sparkSession
    ready(spark)
    # rows that aren't there get keys that match nothing, each conversation and turn its own: nulls would meet in one task
    gone = F.sha2(F.concat_ws("\x1f", F.lit("gone"), "conv_id", "turn"), 256)
    keyed = rows.withColumn("_key", F.when(F.col("there"), _key(F.col("conv_id"), F.col("role"), F.col("text"))).otherwise(F.unhex(gone)))
    # texts of more than one turn, with the first (nulls come first)
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    last = F.max(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
    again = keyed.where("there").groupBy("_key").agg(first.alias("first"), last.alias("last")).where("first != last").select("_key", F.col("first").alias("_first"))
    here = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = keyed.join(again, "_key", "left").select("conv_id", "turn", "role", "text", "there", F.coalesce(here != F.col("_first"), F.lit(False)).alias("seen"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    arrow = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        out: list[dict] = []
        for batch in batches:
            for conv_id, turn, role, text, there, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = Conversation(conv_id)
                if there:
                    now.add(turn, role, text, seen)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], arrow)

    return seen.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(tidy(run), schema)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295)"""


def _after(way: str, cost: str, edit: str, line: str = "''") -> str:
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{edit}', 'r': {way}.r || {line}}} END"


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


_KEEP, _TEXT = "chr(10) || x.role || ':' || x.text", "chr(10) || '{0}:' || x.text"
_read = lambda way, initial, name: (
    f"CASE WHEN NOT x.gone AND x.role[1] = '{initial}' THEN {_after(way, 'x.extra', 'K', _KEEP)} END",
    f"CASE WHEN NOT x.gone THEN {_after(way, '3 + x.extra', 'R', _TEXT.format(name))} END",
)
SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
hurt AS (SELECT *, {_CRC} % 20 AS kind FROM given),
made AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hurt, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS c(copy) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || role[1] AS pair,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final
  FROM made),
met AS (SELECT *, i > min(i) OVER (PARTITION BY conv_id, role, text) AS seen FROM placed),
judged AS (SELECT *, final = '' AS blank, final <> '' AND seen AS duplicate, final <> '' AND NOT seen AND final NOT IN ('.', '!', '?') AS truncated FROM met),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'role': role, 'text': text, 'gone': blank OR duplicate, 'extra': CASE WHEN truncated THEN 3 ELSE 0 END}} ORDER BY i) AS rows
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, rows, 0 AS i, {{'c': 0, 'a': '', 'r': ''}} AS e, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS s, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS a
  FROM counted
  UNION ALL
  SELECT conv_id, rows, i + 1, {_after("e", "4", "D")}, {_least(_after("s", "4", "D"), _read("e", "s", "system")[0])},
    {_least(_after("u1", "4", "D"), *_read("e", "u", "user"), *_read("s", "u", "user"), *_read("a1", "u", "user"))},
    {_least(_after("a1", "4", "D"), *_read("u1", "a", "assistant"))}
  FROM (SELECT *, {_least("a", _after("u1", "3", "I", "chr(10) || 'assistant:'"))} AS a1, rows[i + 1] AS x
    FROM (SELECT *, {_least("u", *(_after(w, "3", "I", "chr(10) || 'user:'") for w in "esa"))} AS u1 FROM walk WHERE i < len(rows)))),
ended AS (
  SELECT conv_id, {_least("e", "a", _after("u", "3", "I", "chr(10) || 'assistant:'"), _after("s", "6", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"), _after("e", "6", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'"))} AS way
  FROM walk WHERE i = len(rows)),
every AS (SELECT DISTINCT conv_id FROM given)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(way.r[2:], '')) AS repaired_sha256
FROM every v LEFT JOIN counted c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended d ON v.conv_id IS NOT DISTINCT FROM d.conv_id
"""
