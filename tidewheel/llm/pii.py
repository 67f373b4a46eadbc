"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a whole text in a single pass: at-signs, ``://``, digits (also after a
dot or a plus) and identifier cues such as ``account`` or ``iban``. What stands around an anchor is then judged by a
deterministic parser of its kind, which expands to the left and right from there, never beyond its kind's previous
span, and validates. Text without anchors costs the automaton alone.

Kinds, in this order: ``email``, ``ip``, ``card`` and ``phone`` are the base; the method adds ``address`` (a scheme and a
host with a user name before it) and ``account`` (a number behind a cue; behind ``iban`` it must pass mod 97). Added spans
never overlap base spans.

Every parser consumes each character at most once a kind, so a text takes time linear in its length.

Edge cases: null and empty texts have no spans; candidates that fail their check are dropped and still use up their
text; offsets are code points, end exclusive; only ASCII letters and digits count; repeated rows are scanned each; very
long texts are scanned whole; an empty table gives no rows; extra columns stay, and the span column has to have a name
that the table lacks (else a ValueError).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewheel.llm import textvec
from tidewheel.llm.worker import ready, tidy
from tidewheel.runtime import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
#: Words that announce a number; each is found in lower case, upper case and with a capital.
CUES = ("account", "acct", "iban", "passport", "ssn")
CARD_DIGITS, PHONE_DIGITS, ACCOUNT_CHARS = (13, 19), (9, 15), (6, 34)

# The local patterns. Each is matched at a place that an anchor gives.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SCHEME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-"
USER_HOST = r"://[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9.-]+(?::[0-9]+)?"
NUMBER = r"(?:\x20(?:no|nr|number))?\.?\x20?[:=#]?\x20?([A-Z]{0,2}[0-9](?:[\x20-]?[0-9A-Z])+)"

SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def cues() -> list[str]:
    return [form for word in CUES for form in (word, word.upper(), word.capitalize())]


def luhn(digits: str) -> bool:
    """The check digit of cards: every second digit from the right counts twice, less 9 above 9."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) << (n & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(value: str) -> bool:
    """The check of an IBAN: two letters, two digits, then the rest; read with the first four moved to the end."""
    if len(value) < 15 or not (value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def within(n: int, bounds: tuple[int, int]) -> bool:
    return bounds[0] <= n <= bounds[1]


def account(cue: str, value: str) -> bool:
    bare = value.replace(" ", "").replace("-", "")
    return within(len(bare), ACCOUNT_CHARS) and (mod97(bare) if cue.lower() == "iban" else sum(c.isdigit() for c in bare) >= 6)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Parsers:
    """Local parsers over one text; each remembers where its kind's last candidate ended."""

    domain, card_run, phone_run, user_host, number = (re.compile(p) for p in (DOMAIN, CARD, PHONE, USER_HOST, NUMBER))
    dotted = re.compile(r"[0-9]+(?:\.[0-9]+)+")

    def __init__(self, text: str):
        self.text = text
        self.found: list[Span] = []
        self.done = dict.fromkeys(KINDS, 0)
        self.sign = self.colon = 0  # behind the last at-sign and the last ``://``

    def keep(self, kind: str, start: int, end: int) -> None:
        self.found.append(Span(kind, start, end))

    def email(self, at: int, size: int) -> None:
        lo = max(self.sign, self.done["email"])
        self.sign = at + 1
        before = self.text[lo:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = local and self.domain.match(self.text, at + 1)
        if m:
            self.keep("email", at - local, m.end())
            self.done["email"] = m.end()

    def ip(self, at: int, size: int) -> None:
        """At a dot before a digit: the whole chain of dotted numbers, four by four."""
        start = at
        while start > self.done["ip"] and "0" <= self.text[start - 1] <= "9":
            start -= 1
        if at < self.done["ip"] or start == at:
            return
        chain = self.dotted.match(self.text, start)
        self.done["ip"] = chain.end()
        parts = chain.group().split(".")
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                self.keep("ip", start, end)
            start = end + 1

    def card(self, at: int, size: int) -> None:
        if at < self.done["card"]:
            return
        run = self.card_run.match(self.text, at)
        self.done["card"] = run.end() if run else at + 1
        digits = run.group().replace(" ", "").replace("-", "") if run else ""
        if within(len(digits), CARD_DIGITS) and luhn(digits):
            self.keep("card", at, run.end())

    def phone(self, at: int, size: int) -> None:
        run = self.phone_run.match(self.text, at)
        if run and within(sum("0" <= c <= "9" for c in run.group()), PHONE_DIGITS):
            self.keep("phone", at, run.end())

    def address(self, at: int, size: int) -> None:
        lo = max(self.colon, self.done["address"])
        self.colon = at + size
        before = self.text[lo:at]
        scheme = before[len(before.rstrip(SCHEME)) :].lstrip("0123456789+.-")
        m = scheme and self.user_host.match(self.text, at)
        if m:
            self.keep("address", at - len(scheme), m.end())
            self.done["address"] = m.end()

    def account(self, at: int, size: int) -> None:
        if at < self.done["account"]:
            return
        m = self.number.match(self.text, at + size)
        if m:
            self.done["account"] = m.end()
            if account(self.text[at : at + size], m.group(1)):
                self.keep("account", *m.span(1))


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """The anchors, each with its kind and length: of a fixed size."""
    digits = "0123456789"
    anchors = [("@", "email"), ("://", "address"), *((f".{d}", "ip") for d in digits), *((f"+{d}", "phone") for d in digits), *((d, "card") for d in digits), *((c, "account") for c in cues())]
    found = ahocorasick.Automaton()
    for anchor, kind in anchors:
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def find(text: str | None) -> list[Span]:
    """The spans of a text by kind, then start."""
    if not text:
        return []
    parsers = Parsers(text)
    for last, (kind, size) in automaton().iter(text):
        getattr(parsers, kind)(last - size + 1, size)
    if not parsers.found:
        return []
    order = KINDS.index
    spans = sorted(parsers.found, key=lambda s: (order(s.kind), s.start))
    base = sorted((s.start, s.end) for s in spans if s.kind in BASE)
    return [s for s in spans if s.kind in BASE or not any(a < s.end and s.start < b for a, b in base)] if len(base) < len(spans) else spans


def scan(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Rows with the column ``name``: array of (kind, start, end) by kind, then start."""
    textvec.unused(docs.columns, name)
    ready(docs.sparkSession)
    place = docs.columns.index(text)
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in find(t.as_py())] for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows with each span of the ``kinds`` replaced by its kind in angle brackets; overlapping spans go together under the
    kind of the first."""
    ready(docs.sparkSession)
    place = docs.columns.index(text)

    def masked(t: str | None) -> str | None:
        out, at = [], 0
        for s in sorted((s for s in find(t) if s.kind in kinds), key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [t[at : s.start], f"<{s.kind}>"]
            at = max(at, s.end)
        return "".join(out) + t[at:] if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([masked(t.as_py()) for t in batch.column(place)], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), own)

    return docs.mapInArrow(tidy(run), docs.schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*" + USER_HOST
_ACCOUNT = f"({'|'.join(cues())}){NUMBER}"


def _sql_spans(kind: int, pattern: str, good: str, group: int = 0) -> str:
    """Spans of a pattern's matches from the lengths of what is between and inside them."""
    p = pattern.replace("'", "''")
    gaps, hits = f"regexp_split_to_array(t, '{p}')", f"regexp_extract_all(t, '{p}')"
    end = f"list_sum(list_transform({gaps}[1:i], lambda x: length(x))) + list_sum(list_transform({hits}[1:i], lambda x: length(x)))"
    whole = f"regexp_extract_all(t, '{p}', {group})[i]"
    return f"""list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {{'kind': {kind}, 'start': ({end} - length({whole}))::BIGINT, 'end': ({end})::BIGINT,
      'value': {whole}, 'cue': {f"regexp_extract_all(t, '{p}', 1)[i]" if group else "''"}}}), lambda s: {good})"""


_bare = "regexp_replace(s.value, '[^0-9A-Z]', '', 'g')"
_luhn = f"list_sum(list_transform(range(1, length({_bare}) + 1), lambda n: CASE WHEN n % 2 = 1 THEN reverse({_bare})[n]::INT WHEN reverse({_bare})[n]::INT > 4 THEN 2 * reverse({_bare})[n]::INT - 9 ELSE 2 * reverse({_bare})[n]::INT END)) % 10 = 0"
_iban = f"""regexp_full_match({_bare}, '[A-Z][A-Z][0-9][0-9][0-9A-Z]{{11,}}') AND list_reduce(list_concat([0::BIGINT], list_transform(range(1, length({_bare}) + 1), lambda n:
      strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({_bare}[5:] || {_bare}[:4])[n]) - 1)), lambda r, d: (r * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"""
_account = f"length({_bare}) BETWEEN 6 AND 34 AND CASE WHEN lower(s.cue) = 'iban' THEN {_iban} ELSE length(regexp_replace({_bare}, '[^0-9]', '', 'g')) >= 6 END"
_parts = "len(list_filter(string_split(s.value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"
_name = "list_transform({0}, lambda s: ['email', 'ip', 'card', 'phone', 'address', 'account'][s.kind + 1] || ':' || s.start || ':' || s.end)"
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT doc_id,
    {_sql_spans(0, _EMAIL, "true")} AS email,
    {_sql_spans(1, _IP, _parts)} AS ip,
    {_sql_spans(2, CARD, f"CASE WHEN length({_bare}) BETWEEN 13 AND 19 THEN {_luhn} ELSE false END")} AS card,
    {_sql_spans(3, PHONE, f"length({_bare}) BETWEEN 9 AND 15")} AS phone,
    {_sql_spans(4, _ADDRESS, "true")} AS address0,
    {_sql_spans(5, _ACCOUNT, _account, 2)} AS account0
  FROM docs),
based AS (SELECT *, list_concat(list_concat(email, ip), list_concat(card, phone)) AS base FROM raw),
added AS (
  SELECT *, list_filter(address0, lambda m: len(list_filter(base, lambda s: s.start < m.end AND m.start < s.end)) = 0) AS address,
    list_filter(account0, lambda m: len(list_filter(base, lambda s: s.start < m.end AND m.start < s.end)) = 0) AS account
  FROM based)
SELECT doc_id::BIGINT AS doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone,
  len(address)::BIGINT AS n_address, len(account)::BIGINT AS n_account,
  sha256(coalesce(array_to_string({_name.format("base")}, ','), '')) AS base_sha256,
  coalesce(array_to_string({_name.format("list_concat(base, list_concat(address, account))")}, ','), '') AS spans
FROM added
"""
