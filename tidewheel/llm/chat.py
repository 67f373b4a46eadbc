"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template: each turn is ``<s>[INST] role [/INST]text</s>``. The grammar is strict: a role or text holds none of the
markers ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. The parser is deterministic: it cuts at ``</s>``, then at the
first `` [/INST]``, takes nothing that breaks the grammar, and unescapes role and text. Every turn is rendered as it is
first and parsed back; where it doesn't come back identical, its control characters are escaped (``\\`` as ``\\b``,
``<`` as ``\\l``, ``[`` as ``\\q``), after which no marker can stand inside it. Then the whole conversation is parsed
and compared again; one that still differed would stop the query.

The loss mask is a list of spans of the formatted text (code points, end exclusive), one for each assistant text.

Edge cases: null role or text counts as empty; turns are ordered by turn, then role and text, repeated rows stay; a row
with a null conv_id is a conversation of its own; a conversation without assistant turns has an empty loss mask; very
long texts count whole; an empty table gives no rows; extra columns are ignored. One conversation is one output string,
so its turns have to meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.runtime import table

START, MIDDLE, END = "<s>[INST] ", " [/INST]", "</s>"
#: None of these stands inside a formatted role or text.
MARKERS = ("<s>", "</s>", "[INST]", "[/INST]")
CONFLICT = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\q"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\q"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def render(role: Column, text: Column) -> Column:
    """One formatted turn."""
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def parse_turn(piece: Column) -> Column:
    """(role, text) of a turn without its end marker; null where it isn't of the grammar."""
    at = F.locate(MIDDLE, piece)
    role = F.substring(piece, F.lit(len(START) + 1), at - len(START) - 1)
    text = F.substring(piece, at + len(MIDDLE), F.char_length(piece))
    sound = piece.startswith(START) & (at > len(START))
    for marker in MARKERS:
        sound = sound & ~role.contains(marker) & ~text.contains(marker)
    return F.when(sound, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, text), null for what isn't of the grammar; never an error."""
    pieces = F.split(formatted, END, -1)
    # after the last turn's end comes one empty piece
    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), parse_turn)


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learner: str = "assistant") -> DataFrame:
    """conv_id, formatted, escaped (whether any turn is), turns (parsed back, equal to the source), loss_spans."""
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"),
    )
    # the first trip; turns that don't come back are escaped
    plain = render(F.col("role"), F.col("text"))
    back = parse(plain)
    same = (F.size(back) == 1) & F.get(back, F.lit(0)).eqNullSafe(F.struct("role", "text"))
    made = rows.withColumn("escaped", ~same).withColumn("out", F.when(F.col("escaped"), render(escape(F.col("role")), escape(F.col("text")))).otherwise(plain))
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    end = F.sum(F.char_length("out")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    coded = F.char_length(F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")))
    placed = made.withColumns({"stop": end - len(END), "place": F.row_number().over(order)}).withColumn("start", F.col("stop") - coded)
    whole = placed.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "out", "escaped", "start", "stop"))).alias("t"))
    made = whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["out"]), "").alias("formatted"),
        F.exists("t", lambda t: t["escaped"]).alias("escaped"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.transform(F.filter("t", lambda t: t["role"] == learner), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"))).alias("loss_spans"),
    )
    again = made.withColumn("turns", parse(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("conversation doesn't come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return again.select("conv_id", "formatted", "escaped", F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(wrong).alias("turns"), "loss_spans")


def masked(formatted: Column, spans: Column) -> Column:
    """What the formatted text has under a mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), "")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    chats = format_chats(given.unionByName(planted))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chats = chats.withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
    loss = F.col("loss")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_CODED = "length(replace(replace(replace({0}, '\\', '\\b'), '<', '\\l'), '[', '\\q'))"
_CONFLICT = " OR ".join(f"contains({c}, '{x}')" for c in ("role", "text") for x in (*MARKERS, "\\b", "\\l", "\\q"))
SQL = f"""
WITH given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONFLICT}', NULL UNION ALL SELECT -1, 1, 'assistant', '{CONFLICT}', NULL),
-- as it is, a turn comes back unless its role or text holds a marker or an escape code
judged AS (SELECT *, {_CONFLICT} AS coded FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(22 + CASE WHEN coded THEN {_CODED.format("role")} + {_CODED.format("text")} ELSE length(role) + length(text) END)::BIGINT AS formatted_chars
FROM judged GROUP BY conv_id, alone
"""
