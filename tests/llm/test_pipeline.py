"""The whole pipeline against plain versions of its stages."""

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken

import corpus_pipeline
from tidewheel.llm import bpe, lines, toxicity


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_lines(docs):
    where: dict[str, list] = {}
    for i, t in docs.items():
        for p, x in enumerate(t.split("\n")):
            if x.strip():
                where.setdefault(x, []).append((i, p))
    texts = sorted(where, key=len)
    letters = np.array([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % 64, minlength=64) for x in texts])
    sizes = np.array([len(x) for x in texts])
    links = []
    for a, x in enumerate(texts):
        edits = lines.allowed(len(x), lines.TIERS)
        if edits:
            end = int(np.searchsorted(sizes, len(x) + edits, "right"))
            # an edit changes two letter counts by one at most
            near = np.flatnonzero(np.abs(letters[a + 1 : end] - letters[a]).sum(axis=1) <= 2 * edits) + a + 1
            links += [(a, b) for b in near.tolist() if lines._small(x, texts[b]) <= edits]
    root = components(len(texts), links)
    first: dict[int, tuple] = {}
    for n, x in enumerate(texts):
        first[root[n]] = min(first.get(root[n], min(where[x])), min(where[x]))
    drop = {o for n, x in enumerate(texts) for o in where[x] if o != first[root[n]]}
    out = {}
    for i, t in docs.items():
        own = t.split("\n")
        kept = [x for p, x in enumerate(own) if (i, p) not in drop]
        if len(kept) == len(own) or "".join(kept).strip():
            out[i] = "\n".join(kept)
    return out


def plain_near(docs):
    def shingles(t):
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w)} - {()} if len(w) < corpus_pipeline.WORDS else {tuple(w[i : i + corpus_pipeline.WORDS]) for i in range(len(w) - corpus_pipeline.WORDS + 1)}

    ids = sorted(docs)
    sets = [shingles(docs[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= corpus_pipeline.PERCENT * len(sets[a] | sets[b])]
    root = components(len(ids), links)
    return {i: docs[i] for n, i in enumerate(ids) if root[n] == n}


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {i: t for i, t in zip(docs.doc_id, docs.text, strict=True) if model.score(t) < toxicity.THRESHOLD}
    kept = plain_near(plain_lines(kept))
    words = lambda t: " ".join(regex.findall(r"\p{L}+", t.lower()))
    items = [words(t) for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text]
    kept = {i: t for i, t in kept.items() if not any(f" {x} " in f" {words(t)} " for x in items)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {}
    for i, t in kept.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
