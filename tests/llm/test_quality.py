"""The line field: exact marginals on small chains, held-out accuracy, defined results."""

import itertools
import random
import zlib

import numpy as np
import pytest

from surety.llm import quality
from surety.llm.common import utf8_steps
import pyarrow as pa


def features_of(texts):
    (_, _, raw, offsets), = utf8_steps(pa.array(texts, pa.large_string()), 1 << 30)
    return quality.line_features(raw, offsets)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = quality.LineField(rng.normal(size=5), rng.normal(size=(2, 2)), 0.5)
    lines = np.array([1, 4, 0, 3, 6])
    features = rng.normal(size=(lines.sum(), 5))
    got = field.good(features, lines)
    s = features @ field.weights / 2
    at = 0
    for n in lines:
        total = good = 0.0
        best = np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = sum(s[at + k] * (1 if y else -1) for k, y in enumerate(labels))
            w += sum(field.transitions[a, b] for a, b in zip(labels, labels[1:]))
            total += np.exp(w)
            best += np.exp(w) * np.array(labels)
        if n:
            assert got[at:at + n] == pytest.approx(best / total)
        at += n
        _ = good


def test_features_do_not_depend_on_other_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab CD1!\n\t#é.", k=rng.randint(0, 80))) for _ in range(60)] + ["", "\n\n", "a a a\na a a"]
    together, weight, lines = features_of(texts)
    at = 0
    for text, n in zip(texts, lines):
        if text:
            alone, own_weight, own = features_of([text])
            assert own[0] == n and alone == pytest.approx(together[at:at + n]) and (own_weight == weight[at:at + n]).all()
        assert n == sum(1 for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c"))
        at += n


def make(rng, n):
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 60))]
        if not good:
            kind = rng.randint(0, 2)
            words = [[w.upper() + "!!" for w in words], [w + "###" for w in words], [words[0]] * len(words)][kind]
        lines = [" ".join(words[k:k + 12]) for k in range(0, len(words), 12)]
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = make(random.Random(3), 600)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id bigint, text string, `the.score` double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    field = quality.train(docs, labels)
    scored = {r["doc_id"]: r["_s"] for r in quality.score_documents(docs, field, "_s").collect()}
    out = [(scored[i] >= quality.THRESHOLD) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 80 and np.mean(out) > 0.95
    assert all(0 <= s <= 1 for s in scored.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0.7 < kept.count() / 600 < 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (None, "some text"), (4, "x" * 5000), (4, "x" * 5000)],
                                 "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    field = quality.train(docs, none)
    assert {r["score"] for r in quality.score_documents(docs, field).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (9, 1), (None, 1), (3, None), (3, 7)], "doc_id bigint, quality int")
    scores = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(scores) == 6 and len({r["score"] for r in scores if not (r["text"] or "").strip()}) == 1
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert quality.score_documents(empty, quality.train(empty, labels)).count() == 0
