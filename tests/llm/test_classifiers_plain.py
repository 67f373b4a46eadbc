"""The classifiers' queries over a whole table against plain versions, text by text."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidewheel.llm import quality, textvec, toxicity

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def test_toxicity_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet").groupby("doc_id").toxic.max()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id}
    learned = sorted((i, t or "", int(labels[i])) for i, t in zip(docs.doc_id, docs.text, strict=True) if i in labels.index and not held[i] and len(t or "") <= toxicity.LONGEST)
    assert 50 < len(learned) < toxicity.SAMPLE
    model = toxicity.train([t for _, t, _ in learned], [y for _, _, y in learned])
    want = {i: model.score(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    rows = toxicity.op2_toxicity(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["held_out"] == held[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3)


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_look(text):
    """(votes, buckets of words, buckets of shapes) of one text."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if not words:
        return [1] * len(quality.LABELLERS), []
    symbols, n = b"#$%&*^~_=<>{}[]\\@|+", len(words)
    facts, buckets, before = Counter(), [], None
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    for w, own in zip(words, low, strict=True):
        upper = sum(65 <= c <= 90 for c in w)
        letter = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in w)
        symbol, mark, digit = sum(c in symbols for c in w), w.count(b"!"), sum(48 <= c <= 57 for c in w)
        same, shout = own == before, upper >= 2 and 2 * upper > letter
        before = own
        plain = letter + (w[-1:] in (b".", b",", b";", b":", b"?", b"!")) == len(w) and not same
        facts.update(shout=shout, symbol=symbol > 0, same=same, mark=mark > 0, table=symbol > 0 and len(w) == 1, plain=plain, lower=plain and not upper, size=len(w))
        shape = mix(min(len(w), 15) << 8 | shout << 6 | (symbol > 0) << 5 | (mark > 1) << 4 | (digit > 0) << 3 | same << 2 | 1)
        half = quality.BUCKETS // 2
        buckets += [textvec.hash_word(w) & (half - 1), (shape & (half - 1)) + half]
    share = {k: v / n for k, v in facts.items()}
    variety = len(set(low)) / n * max(1, n / 100) ** 0.3
    fault = lambda value, bad: int(n >= 3 and value >= bad)
    vote = lambda value, bad, good, least=3: 0 if n < least else 1 if value <= bad else 2 if value >= good else 0
    votes = [
        fault(share["shout"], 0.3), fault(share["symbol"], 0.25), fault(share["same"], 0.2), fault(share["mark"], 0.25), fault(share["table"], 0.15),
        vote(variety, 0.25, 0.45, 10), vote(-abs(share["size"] - 7), -13, -4, 10), vote(share["plain"], 0.65, 0.85), vote(share["lower"], 0.4, 0.65),
    ]
    return votes, buckets


def test_quality_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    seen = {i: plain_look(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    counts = Counter(tuple(v) for v, _ in seen.values())
    patterns = np.array(list(counts))
    weak = quality.expectation_maximisation(patterns, np.array(list(counts.values())), false_alarms=quality.FALSE_ALARMS)
    post = {i: weak.posterior(np.array([v]))[0] for i, (v, _) in seen.items()}
    assert len(docs) < quality.SAMPLE
    bags, targets = [], []
    for i in sorted(i for i, t in zip(docs.doc_id, docs.text, strict=True) if t is not None):
        own = Counter(seen[i][1])
        if own:
            used = np.array(sorted(own))
            bags.append((used, np.array([own[b] for b in used.tolist()], np.float32) / np.float32(len(seen[i][1]) // 2)))
            targets.append(post[i])
    scorer = quality.train(bags, np.array(targets))
    rows = quality.op10_quality(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        buckets = seen[r["doc_id"]][1]
        value = sum(float(scorer.weights[b]) for b in buckets) / max(1, len(buckets) // 2) + scorer.bias
        want = 1 / (1 + np.exp(-np.clip(value, -50, 50))) if buckets else 0.0
        assert r["weak"] == pytest.approx(post[r["doc_id"]], abs=2e-6)
        assert r["score"] == pytest.approx(want, abs=1e-3)
