"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Pieces come from ``split`` and ``regexp_extract_all`` over the same pattern: what is outside and inside matches
alternates, so a running sum of their lengths in code points gives every offset without a Python function. Each
candidate value is then counted over the corpus: the distinct owners (``source``) and repositories (documents) that hold
it. A value of many owners or many repositories is an example that was copied; one of few owners and few repositories is
live-looking.

Kinds, in this order: ``assign``, ``access`` and ``hex`` are the base; ``token`` (published prefixes of service
tokens) is added by the method, outside base spans and only if its value is live-looking.

Edge cases: null text counts as empty; rows without an owner have one owner in common, which is no other's; documents
without spans have empty strings and zero counts; repeated rows are scanned each on their own, but count as one
repository; a value with exactly the most owners or repositories is live-looking; very long texts are scanned whole, in
time linear in their pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.runtime import cut, table

#: A value of more owners than this is a copied example.
MAX_OWNERS = 2
#: A value in more repositories than this is one too, whoever owns them.
MAX_REPOSITORIES = 10
KINDS = ("assign", "access", "hex", "token")

# The base patterns. {12,} and the like can't stand in for the length of ``assign``: a match that is
# too short still uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of 18 or more characters
HEX = r"[0-9a-f]{16,}"  # the same matches as [0-9a-f]+ of 16 or more characters
TOKEN = r"(?:sk_live_|sk-|ghp_|gho_|glpat-|xoxb-|xoxp-|npm_|hf_)[A-Za-z0-9_-]{16,}"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
STEMS = ("sk_live_", "sk-", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "npm_", "hf_")


def _pieces(text: Column, pattern: str, kind: int) -> Column:
    """Array of (kind, place, gap, size, value): the characters before each match, and the match (null after the last)."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("o"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("i"))
    return F.transform(
        pieces,
        lambda p, n: F.struct(F.lit(kind).alias("kind"), n.alias("place"), F.char_length(p["o"]).alias("gap"), F.coalesce(F.char_length(p["i"]), F.lit(0)).alias("size"), p["i"].alias("value")),
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row and doc_id of each document; row, doc_id, owner, kind, start, end, value of each span.

    Only documents with a match go on to the spans, and only their pieces' lengths and matches, not their texts.
    """
    none = F.expr("CAST(array() AS array<struct<kind:int,place:int,gap:int,size:int,value:string>>)")
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    low = F.lower("t")
    named = low.contains(WORDS[0])
    for w in WORDS[1:]:
        named = named | low.contains(w)
    stem = F.col("t").contains(STEMS[0])
    for w in STEMS[1:]:
        stem = stem | F.col("t").contains(w)
    found = F.concat(
        F.when(named, _pieces(F.col("t"), ASSIGN, 0)).otherwise(none),
        F.when(F.col("t").contains("AKIA"), _pieces(F.col("t"), ACCESS, 1)).otherwise(none),
        F.when(F.col("t").rlike(HEX), _pieces(F.col("t"), HEX, 2)).otherwise(none),
        F.when(stem, _pieces(F.col("t"), TOKEN, 3)).otherwise(none),
    )
    rows = cut(given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", found.alias("pieces")))
    each = rows.where("size(pieces) > 0").select("row", "doc_id", "owner", F.explode("pieces").alias("p")).select("row", "doc_id", "owner", "p.*")
    along = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    spans = (
        each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along))
        .where("value IS NOT NULL")
        .select("row", "doc_id", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", value.alias("value"))
        .where((F.col("kind") != 0) | (F.char_length("value") >= ASSIGN_MIN))
    )
    # a token overlaps a base span that starts no later and ends after its start, or one that starts inside it
    order = Window.partitionBy("row").orderBy("start")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(order.rangeBetween(0, Window.unboundedFollowing))
    clear = base | (F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True)))
    marked = spans.withColumn("clear", clear).where("clear").drop("clear")
    return rows.select("row", "doc_id"), cut(marked)


def ownership(spans: DataFrame) -> DataFrame:
    """value hash, owners, repositories: over every candidate of the corpus."""
    each = spans.select("doc_id", "owner", F.sha2("value", 256).alias("value"))
    by_owner = each.groupBy("value", "owner").agg(F.count_distinct("doc_id").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, doc_id: str = "doc_id", text: str = "text", owner: str = "source", max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of each row."""
    rows, spans = scan(docs, doc_id, text, owner)
    live = cut(ownership(spans).select("value", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live")))
    span, base = F.struct("start", "kind", "end"), F.col("kind") < 3
    of_row = (
        spans.withColumn("value", F.sha2("value", 256))
        .join(live, "value")
        .groupBy("row")
        .agg(
            *[F.count_if(F.col("kind") == k).alias(name) for k, name in enumerate(("n_assign", "n_access", "n_hex"))],
            _listed(F.collect_list(F.when(base, span))).alias("base"),
            _listed(F.collect_list(F.when(base | F.col("live"), span))).alias("spans"),
            F.count_if("live").alias("n_live"),
            F.count_if(~F.col("live")).alias("n_example"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    text_of = lambda c: F.coalesce(c, F.lit(""))
    return rows.join(of_row, "row", "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(text_of("base"), 256).alias("base_sha256"),
        text_of("spans").alias("spans"), zero("n_live"), zero("n_example"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def _either(pattern: str) -> str:
    """ASCII letters in either case, spelled out: RE2 would fold other letters in too."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def _sql_spans(pattern: str, kind: int, value: str) -> str:
    p = pattern.replace("'", "''")
    return f"""list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
        'start': list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0),
        'kind': {kind},
        'end': list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i], lambda x: length(x))),
        'value': {value}}})"""


_ASSIGN_SQL = f"""({_either("password|passwd|secret|token|api_?key")})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_q = _ASSIGN_SQL.replace("'", "''")

SQL = f"""
WITH docs AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
raw AS (
  SELECT doc_id, owner,
    list_filter({_sql_spans(_ASSIGN_SQL, 0, f"regexp_extract_all(t, '{_q}', 2)[i]")}, lambda s: length(s.value) >= {ASSIGN_MIN}) AS a,
    {_sql_spans(ACCESS, 1, f"regexp_extract_all(t, '{ACCESS}')[i]")} AS b,
    {_sql_spans(HEX, 2, f"regexp_extract_all(t, '{HEX}')[i]")} AS c,
    {_sql_spans(TOKEN, 3, f"regexp_extract_all(t, '{TOKEN}')[i]")} AS d
  FROM docs),
found AS (
  SELECT row_number() OVER () AS r, doc_id, owner, a, b, c, list_concat(list_concat(a, b), c) AS base,
    list_filter(d, lambda m: len(list_filter(list_concat(list_concat(a, b), c), lambda s: s.start < m.end AND m.start < s.end)) = 0) AS more
  FROM raw),
each AS (SELECT r, doc_id, owner, unnest(list_concat(base, more)) AS s FROM found),
held AS (SELECT s.value AS value, owner, count(DISTINCT doc_id) AS repositories FROM each GROUP BY ALL),
counts AS (SELECT value, count(*) <= {MAX_OWNERS} AND sum(repositories) <= {MAX_REPOSITORIES} AS live FROM held GROUP BY value),
judged AS (
  SELECT r, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example,
    string_agg(CASE WHEN s.kind < 3 OR live THEN ['assign', 'access', 'hex', 'token'][s.kind + 1] || ':' || s.start::BIGINT || ':' || s.end::BIGINT END, ',' ORDER BY s.start, s.kind) AS spans
  FROM each JOIN counts ON s.value = counts.value GROUP BY r),
based AS (
  SELECT r, string_agg(['assign', 'access', 'hex'][s.kind + 1] || ':' || s.start::BIGINT || ':' || s.end::BIGINT, ',' ORDER BY s.start, s.kind) AS listed
  FROM each WHERE s.kind < 3 GROUP BY r)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM found LEFT JOIN judged USING (r) LEFT JOIN based USING (r)
"""
