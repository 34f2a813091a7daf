"""Rank-order profiles against plain Python, and held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surety.llm import language

SCHEMA = "doc_id bigint, text string, lang string"


def grams(text):
    """Counts of n-grams, the plain way."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
    found = Counter()
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            found.update(w[i:i + n] for i in range(len(w) - n + 1) if w[i:i + n] != " ")
    return found


def ranks(counts, size):
    order = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    return {g: i for i, g in enumerate(order)}


def plain(rows, size):
    taught = {}
    for doc, text, lang in rows:
        if lang is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 != 1:
            taught.setdefault(lang, Counter()).update(grams(text))
    known = {lang: ranks(c, size) for lang, c in taught.items() if c}
    out = []
    for doc, text, _ in rows:
        own = ranks(grams(text), size)
        far = {lang: sum(abs(i - r[g]) if g in r else size for g, i in own.items()) for lang, r in known.items()}
        best = min(far, key=lambda lang: (far[lang], lang)) if own and far else "und"
        out.append((doc, best, 0.0 if best == "und" else 1 - far[best] / (len(own) * size)))
    return sorted(out, key=str)


def run(spark, rows, size=language.PROFILE):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language.identify(docs.select("doc_id", "text"), language.train(docs, size))
    return sorted([(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()], key=str)


def sample(n=200):
    rng = random.Random(5)
    letters = {"aa": "abcdeé", "bb": "fghijß", "cc": "cdefgh"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(letters))
        words = ["".join(rng.choices(letters[lang], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", ", ", "\n", " 12 "]).join(words).title(), lang if rng.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("size", [10, 300])
def test_against_plain_python(spark, size):
    rows = sample() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 -- !", "bb"), (1003, "é", None), (None, "abc abc", "aa"), (0, "abc", "aa"), (0, "abc", "aa")]
    assert run(spark, rows, size) == plain(rows, size)


def test_long_text_is_counted_whole(monkeypatch):
    text = "Ab, cdé  f" * 500 + "z" * 90
    whole = language.gram_counts(language.code_points(text))
    monkeypatch.setattr(language, "PIECE", 7)
    pieces = language.gram_counts(language.code_points(text))
    assert all((a == b).all() for a, b in zip(whole, pieces))
    assert dict(zip(*(x.tolist() for x in whole))) == {
        sum(ord(c) << (42 - 21 * i) for i, c in enumerate(g)): n for g, n in grams(text).items()}


def test_a_text_of_five_million_characters(spark):
    rows = sample(60) + [(10_000, "abcde eédcb " * 420_000, None)]
    assert run(spark, rows) == plain(rows, language.PROFILE)


def test_empty_tables_and_nothing_to_learn(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, "abc", None), (4, None, "aa")]) == [(3, "und", 0.0), (4, "und", 0.0)]


def test_clashing_columns(spark):
    rows = sample(30)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1), "n": F.lit(2), "a.b": F.lit(3)})
    got = language.identify(docs, language.train(docs))
    assert got.columns == [*docs.columns, "lang_pred_", "score_"]
    assert sorted([(r["doc_id"], r["lang_pred_"], r["score_"]) for r in got.collect()], key=str) == plain(rows, language.PROFILE)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.where(language.held_out() & F.col("lang").isNotNull()), language.train(docs)).select("lang", "lang_pred").collect()
    assert len(got) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
