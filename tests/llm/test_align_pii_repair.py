"""Tokenizer alignment, personal data and conversation repair against plain versions."""

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import align, pii, repair

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "<|endoftext|> a </s> <s> <0x41> plain."),
    (2, "ﬁ ligature  two  spaces "),
    (3, "日本語のテキスト🙂\x00 \t\n x\n\ny \n z"),
    (4, "word " * 3000 + "x" * 20_000),
    (5, " " * 5000),
    (6, None),
    (7, ""),
    (None, "no id"),
    (8, "a▁b"),
    (9, "the same the same"),
    (9, "the same the same"),
    (10, "\n"),
    (11, "Éàü ½ can't won't 12345 --- ...!?"),
]


@functools.cache
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), align.byte_alphabet()


def spans(parts):
    ends = list(itertools.accumulate(map(len, parts)))
    return list(zip([0, *ends], ends, strict=False))


def plain_alignment(text):
    """(n_a, n_b, groups, links) of one text, or None."""
    if not text:
        return None
    a, b, alphabet = libraries()
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
        return None
    spans_a, spans_b = spans(bytes_a), spans(bytes_b)
    links, first = [], 0
    for i, (start, end) in zip(ids_a, spans_a, strict=True):
        while spans_b[first][1] <= start:
            first += 1
        for k in range(first, len(spans_b)):
            if spans_b[k][0] >= end:
                break
            links.append((i, ids_b[k]))
    common = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups = [([], []) for _ in common]
    for side, (ids, own) in enumerate(((ids_a, spans_a), (ids_b, spans_b))):
        for i, (_, end) in zip(ids, own, strict=True):
            groups[bisect.bisect_left(common, end)][side].append(i)
    return len(ids_a), len(ids_b), groups, links


@pytest.fixture(scope="module")
def aligned(spark, tmp_path_factory):
    """(folder, texts, plain rows) of a small table of documents."""
    given = TEXTS + [(r["doc_id"] + 100, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    folder = str(tmp_path_factory.mktemp("align"))
    spark.createDataFrame(given, "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("row", F.lit(2)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    plain = [(i, plain_alignment(t)) for i, t in given]
    held = Counter(p for _, v in plain if v for p in set(v[3]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = []
    for i, v in plain:
        if v is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = v
        listed = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        rows.append((i, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(listed.encode()).hexdigest()))
    return folder, given, rows


def key(rows):
    return sorted(rows, key=repr)


def alike(df):
    """Rows of a pandas frame, nulls as -9 and all numbers alike."""
    return sorted(tuple(int(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in row) for row in df[sorted(df.columns)].fillna(-9).itertuples(index=False, name=None))


def test_alignment_brute_force(spark, aligned):
    folder, _, want = aligned
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert key(tuple(r[c] for c in columns) for r in align.op11_align(spark, folder).collect()) == key(want)


def test_alignment_beyond_the_broadcast_and_of_nothing(spark, aligned):
    folder, _, want = aligned
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = align.distinct_pairs(align.align(align.tokens(docs, A, B))).withColumn("row", F.monotonically_increasing_id()).persist()
    a, b = (key(map(tuple, align.scores(rows, n).collect())) for n in (0, 1 << 20))
    assert a == b and sum(r[2] for r in a) == sum(r[6] for r in want)
    rows.unpersist()
    assert align.align(align.tokens(docs.where("false"), A, B)).count() == 0


def test_digests_are_of_the_groups(spark, aligned):
    """The digest is of the groups that the operator writes, made without a string a group; batches are taken in portions."""
    folder, _, _ = aligned
    rows = align.tokens(spark.read.parquet(f"{folder}/documents.parquet"), A, B)
    want = [(r[0], r[1], r[2], hashlib.sha256(";".join(r[3]).encode()).hexdigest() if r[3] else "") for r in align.align(rows).select("doc_id", "n_a", "n_b", "groups").collect()]
    assert key(tuple(r) for r in align.digests(align.cuts(rows)).select("doc_id", "n_a", "n_b", "groups_sha256").collect()) == key(want)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 200_000, None, "b" * 100_000, "", "c" * 600_000, "d"]})
    parts = list(align._portions(batch))
    assert len(parts) == 3 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_sides_are_the_libraries():
    a, b, _ = libraries()
    fast, pieces = align.SideA(A), align.SideB(B)
    assert fast.fast is not None and pieces.apart
    texts = [f" {t}" for _, t in TEXTS if t]
    assert [x.tolist() for x in fast.encode(texts)] == [a.encode(t, add_special_tokens=False).ids for t in texts]
    fast.fast = None
    assert [x.tolist() for x in fast.encode(texts[:3])] == [a.encode(t, add_special_tokens=False).ids for t in texts[:3]]
    for size in (1, 2000):
        align.TOGETHER, pieces = size, align.SideB(B)
        for t, ids in zip(texts, pieces.encode(texts), strict=True):
            assert ids is None if "▁" in t else ids.tolist() == b.encode(t[1:])
    pieces.apart = False
    assert pieces.encode(texts[:2])[0].tolist() == b.encode(texts[0][1:])


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """Base spans straight from the patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(map(int, str(2 * int(c) if n % 2 else int(c)))) for n, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "B", "@", ".", "-", "1", "22", "256", "0007", "4", "+", "://", "http", "u:p@h.de", "account ", "IBAN: ", "iban", "GB82 WEST 1234 5698 7654 32", " ", "  ", "(", ")", "4111111111111111", "x.y", "é", "٣", "no.", "+49 30 1234567", "10.0.0.1", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_spans_brute_force():
    for text in random_texts(4000):
        found = pii.find(text)
        assert [tuple(s) for s in found if s.kind in pii.BASE] == plain_spans(text)
        base = [s for s in found if s.kind in pii.BASE]
        assert all(s.end <= b.start or b.end <= s.start for s in found if s not in base for b in base)


def test_spans_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(random_texts(800, 5))] + [(None, None), (900, ""), (900, ""), (901, "1" * 5000 + "@" * 50 + "9." * 2000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op12_pii(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(pii.SQL).df()
    assert alike(got) == alike(want) and len(got) == 804


def test_spans_the_method_adds():
    text = "see ftp://joe:secret@files.example.org:21/x, account no: 1234-5678, IBAN: GB82 WEST 1234 5698 7654 32. iban GB82 WEST 1234 5698 7654 33"
    assert [(s.kind, text[s.start : s.end]) for s in pii.find(text)] == [
        ("email", "secret@files.example.org"),
        ("account", "1234-5678"),
        ("account", "GB82 WEST 1234 5698 7654 32"),
    ]
    assert [s.kind for s in pii.find("ssh://root@box/")] == ["address"]
    long = "lorem ipsum " * 200_000 + "a.b@c.de"
    assert pii.find(long) == [("email", len(long) - 8, len(long))]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc or +49 30 1234567."), (2, None), (3, "none")], "id long, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("id").collect()] == ["mail <email> or <phone>.", None, "none"]
    assert pii.redact(df, kinds=("phone",)).orderBy("id").first()["text"] == "mail a@b.cc or <phone>."
    assert pii.scan(df.where("false")).count() == 0


# Conversation repair


def plain_repair(rows):
    """(cost, audit, text) of the cheapest, ASCII-least repair by trying all edits; rows: (role, text, fault)."""
    best = None

    def go(i, out, audit, cost, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, "\n".join(lines)
        if len(out) < 2 * len(rows) + 3:
            for name in ("user", "assistant"):
                go(i, out + name[0], audit + "I", cost + 3, [*lines, f"{name}:"])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, out, audit + "D", cost + 4, lines)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                extra = 3 if fault == repair.TRUNCATED else 0
                if role[:1] and role[:1] in "sua":
                    go(i + 1, out + role[:1], audit + "K", cost + extra, [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    go(i + 1, out + name[0], audit + "R", cost + 3 + extra, [*lines, f"{name}:{text}"])

    # an upper bound prunes: everything deleted
    best = (4 * len(rows), "D" * len(rows), "")
    go(0, "", "", 0, [])
    return best


def conversation(rows):
    """The result of the operator's class for (turn, role, text) in order."""
    c, seen = repair.Conversation(1), set()
    for turn, role, text in rows:
        c.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    return c.result()


def random_rows(rng, most):
    return [(t, rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice(["a.", "b", "c!", " ", "d?", "e. "])) for t in range(rng.randrange(most))]


def test_repair_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        rows, seen, judged = random_rows(rng, 5), set(), []
        for _, role, text in rows:
            judged.append((role, text, repair.fault(text, (role, text) in seen)))
            seen.add((role, text))
        got = conversation(rows)
        cost, audit, text = plain_repair(judged)
        assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(9)
    given = [random_rows(rng, 40) for _ in range(40)]
    whole = [conversation(rows) for rows in given]
    for size in (1, 2, 7):
        monkeypatch.setattr(repair, "BLOCK", size)
        assert [conversation(rows) for rows in given] == whole


def test_repair_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (None if c == 7 else c, None if rng.random() < 0.05 else t * rng.randrange(1, 3), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b", "c!", " ", "", None, "\n e \t", "f. ", " x y.\n"]))
        for c in range(200)
        for t in range(rng.randrange(12))
        for _ in range(1 if rng.random() < 0.9 else 2)
    ]
    rows += [(1000, 5, "user", "long " * 30_000), (-1, -3, "user", "hi."), (-1, 4, "assistant", "ho.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("there", F.lit("x")).withColumn("seen", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_repair(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(repair.SQL).df()
    assert alike(got) == alike(want)
    assert repair.repair(repair.damage(df.where("false"))).count() == 0


def test_a_dropped_conversation(spark):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = repair.repair(repair.damage(spark.createDataFrame([(5, turn, "user", "a.")], "conv_id long, turn long, role string, text string"))).first()
    assert row.asDict() == dict(conv_id=5, gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=hashlib.sha256(b"").hexdigest())
