"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tidewheel.llm import bpe, caps, chat, decontam, lines, minhash, pii, quality, secrets, toxicity, urls

LONG = "word " * 60_000 + "x" * 200_000
CLASH = ("node", "component", "rep", "a", "b", "h1", "drops", "_drops", "_key", "_id", "_score", "score", "_dropped", "_lines", "owner", "key", "band")
DOCS = [
    (1, "A plain text that says a few plain things.", "en", "src0", 42),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (4, " \n\t\n ", "en", "src1", 5),
    (5, LONG, "en", "src2", len(LONG)),
    (6, "A plain text that says a few plain things.", "en", "src0", 42),
    (6, "A plain text that says a few plain things.", "en", "src0", 42),
    (None, "A text without an id that stands alone here.", "en", "src3", 44),
    (7, "é日本 \x00 odd", "xx", "src3", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 0, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "lost words"), (4, "a text without an id that stands alone")], "item_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_toxicity(spark, docs, labels):
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 for r in rows)
    of = {r["doc_id"]: r["score"] for r in rows}
    assert of[2] == of[3] == of[4]
    assert toxicity.drop_toxic(docs, labels.where("false")).count() == len(DOCS)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.drop_toxic(docs.where("false"), labels).count() == 0


def test_toxicity_learns_one_text_an_id(spark):
    docs = spark.createDataFrame([(i % 2, f"text {i}") for i in range(500)] + [(3, "long " * 40_000), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, limit=1).count() <= 1
    rows = {r["_id"]: r["text"] for r in toxicity.labelled(docs, labels, held_out=-1).collect()}
    assert rows == {0: "text 0", 1: "text 1", 5: ""}


def test_names_that_are_taken(docs, labels):
    with pytest.raises(ValueError, match="score"):
        toxicity.score(docs, toxicity.train([], []))
    with pytest.raises(ValueError, match="_lines"):
        lines.dedup_lines(docs)
    with pytest.raises(ValueError, match="n_tokens"):
        bpe.digests(docs.withColumnRenamed("key", "n_tokens"), "", "", keep=("doc_id", "n_tokens"))
    with pytest.raises(ValueError, match="spans"):
        pii.scan(docs.withColumnRenamed("key", "Spans"))
    assert lines.dedup_lines(docs.drop("_lines", "_dropped")).columns[-3:] == ["_lines", "_dropped", "_near"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines(docs):
    out = lines.dedup_lines(docs.select("doc_id", "text"))
    rows = by_id(out)
    assert rows[2]["text"] is None and rows[3]["text"] == "" and rows[4]["text"] == " \n\t\n " and rows[5]["text"] == LONG
    assert rows[1]["_dropped"] == 0 and rows[6]["_dropped"] == 1 and rows[6]["text"] == ""
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert lines.drop_lines(docs.where("false")).count() == 0


def test_lines_of_one_id_with_two_texts(spark):
    line = "a line of words that is long enough"
    df = spark.createDataFrame([(1, f"{line}\nshort\n{line}s"), (1, "other"), (2, f"{line[:-1]}x")], "doc_id long, text string")
    assert sorted(r["text"] for r in lines.dedup_lines(df).collect()) == sorted([f"{line}\nshort", "other", ""])
    # a line that occurs once in the corpus stays, whatever another row of the id loses at its place
    once = "only one row of the corpus has this line"
    df = spark.createDataFrame([(1, line), (2, f"{line}\nmore"), (2, f"{once}\nmore words of the other row")], "doc_id long, text string")
    assert sorted(r["text"] for r in lines.dedup_lines(df).collect()) == sorted([line, "more", f"{once}\nmore words of the other row"])


def test_minhash(docs):
    rows = by_id(minhash.near_duplicates(docs))
    assert [rows[i]["n_shingles"] for i in (2, 3, 4)] == [0, 0, 0] and all(rows[i]["kept"] for i in (1, 2, 3, 4, 5, 7, None))
    assert rows[6]["component_id"] == 1 and not rows[6]["kept"] and rows[None]["component_id"] is None
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 2
    assert minhash.keep_first(docs.where("false")).count() == 0


def test_decontamination(docs, benchmark):
    rows = by_id(decontam.contamination(docs, benchmark))
    assert [i for i, r in rows.items() if r["contaminated"]] == [None] and rows[None]["items"] == "4"
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(DOCS) - 1
    assert decontam.drop_contaminated(docs, benchmark.where("false")).count() == len(DOCS)
    assert decontam.contamination(docs, benchmark.where("false")).where("contaminated").count() == 0
    assert decontam.contamination(docs.where("false"), benchmark).count() == 0


def test_bpe(docs):
    import public_tokenizers as t

    out = bpe.digests(docs, t.path("byte_bpe_multi_50k.tiktoken"), t.PATTERN)
    empty = hashlib.sha256(b"").hexdigest()
    for r in out.collect():
        text = dict((d[0], d[1]) for d in DOCS)[r["doc_id"]] or ""
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_tokens"] == 0) == (text == "") and (text != "" or r["ids_sha256"] == empty)
    assert bpe.digests(docs.where("false"), t.path("byte_bpe_multi_50k.tiktoken"), t.PATTERN).count() == 0


def test_quality(docs):
    rows = by_id(quality.score(docs, quality.fit(docs)))
    assert rows[2]["score"] == rows[3]["score"] == rows[4]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert quality.score(docs.where("false"), quality.fit(docs.where("false"))).count() == 0


def test_secrets(docs):
    rows = by_id(secrets.secrets(docs))
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["spans"] == "" and r["base_sha256"] == empty for r in rows.values()) and len(rows) == 8
    assert secrets.secrets(docs.where("false")).count() == 0


def test_urls(spark, labels):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://A.example.COM/en/1?x#y", None), (None, "://", "x"), (4, "http://A.example.COM/en/1?x#y", None)], "page_id long, url string, rule string")
    rows = urls.filter_urls(pages, labels).collect()
    assert len(rows) == 6
    four = [r for r in rows if r["page_id"] == 4]
    assert len(four) == 2 and all((r["host"], r["path"], r["rule"], r["verdict"]) == ("a.example.com", "/en/1", "com/en/", "block") for r in four)
    assert all((r["host"], r["path"], r["rule"]) == ("", "", None) for r in rows if r["page_id"] != 4)
    assert urls.filter_urls(pages.where("false"), labels.where("false")).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, labels.where("false")).where("rule IS NULL").collect()} == {"allow"}


def test_caps(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (11, [1.0], 1), (None, [1.0, 0.0], 1), (12, [1e200, 0.0], 1), (13, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect()}
    assert [out[i] for i in (1, 2, 12, 13)] == [(3, 1, True), (3, 1, False), (3, 1, False), (3, 1, False)]
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and out[None] == (0, None, True)
    assert caps.near_vectors(df.where("false")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, None), (1, 1, "assistant", "a\\b<s>[INST] </s>"), (None, 0, "user", "x"), (None, 0, "user", "x"), (2, None, "assis\\btant", "</s>"), (3, 0, "user", LONG), (3, 0, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS out", "2 AS start", "3 AS alone")
    out = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "hi"), ("", ""), ("assistant", "a\\b<s>[INST] </s>")]
    assert out[1]["escaped"] and out[2]["escaped"] and not out[3]["escaped"] and len(out[3]["turns"]) == 2
    assert out[2]["turns"][0]["role"] == "assis\\btant"
    assert chat.format_chats(df).where("conv_id IS NULL").count() == 2  # each row without an id is alone
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_reads_its_loss_under_the_mask(spark):
    df = spark.createDataFrame([("xx[INST]\\lyy", [(2, 10), (10, 12)])], "formatted string, spans array<struct<start:long,stop:long>>")
    assert df.select(chat.masked(df["formatted"], df["spans"]).alias("t")).first()["t"] == "[INST]<yy"


def test_chat_escapes_every_marker_and_marks_its_loss(spark):
    tricky = "hi [/INST] x <s>[INST] assistant [/INST] y"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", "plain é answer"), (1, 2, "assistant", f"\\q {tricky}"), (2, 0, "user", "none"), (3, 0, "assistant", "[ < \\ and [inst]")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    text = out[1]["formatted"]
    assert out[1]["escaped"] and not out[2]["escaped"] and not out[3]["escaped"]
    assert all(text.count(m) == 3 for m in chat.MARKERS) and "plain é answer" in text
    back = lambda x: x.replace("\\q", "[").replace("\\l", "<").replace("\\b", "\\")
    assert [back(text[s["start"] : s["stop"]]) for s in out[1]["loss_spans"]] == ["plain é answer", f"\\q {tricky}"]
    assert out[2]["loss_spans"] == [] and [t["text"] for t in out[1]["turns"]] == [r[3] for r in rows[:3]]


def test_op9_chat_of_edge_rows(spark, tmp_path):
    rows = [(1, 0, "assistant", None), (2, 0, "user", "x"), (2, 1, "assistant", "a[INST]"), (2, 2, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in chat.op9_chat(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (1, 0, sha(""))
    assert (out[2]["n_turns"], out[2]["loss_chars"], out[2]["loss_sha256"]) == (3, 8, sha("a[INST]b"))
    c = chat.CONFLICT
    assert (out[-1]["turns_sha256"], out[-1]["loss_sha256"]) == (sha(f"user\n{c}\nassistant\n{c}\n"), sha(c))


def test_rows_of_one_id_with_different_contents(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    df = spark.createDataFrame([(1, a), (2, b), (5, a), (5, b), (5, ""), (7, "alone by itself with other words entirely")], "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert out == [(1, 4, 1), (2, 3, 1), (5, 0, 5), (5, 3, 1), (5, 4, 1), (7, 3, 7)]
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS weight", "'x' AS key")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in caps.near_vectors(df).collect())
    assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1), (4, 0, 4), (4, 0, 4)]


def test_quality_learns_repeated_ids_once(spark):
    rows = [(i % 20, f"some words of text {i % 3}") for i in range(200)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=5)
    assert np.isfinite(model.scorer.weights).all()


def test_another_rank_file_of_the_same_name(spark, tmp_path):
    import base64

    pattern, df = r"[^ ]+| +", spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    n = []
    for folder, more in (("x", []), ("y", [b"ab"])):
        (tmp_path / folder).mkdir()
        tokens = [bytes([i]) for i in range(256)] + more
        (tmp_path / folder / "same.tiktoken").write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
        n.append(bpe.digests(df, str(tmp_path / folder / "same.tiktoken"), pattern).first()["n_tokens"])
    assert n == [4, 2]


def test_stages(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(DOCS)
