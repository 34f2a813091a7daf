"""Base spans against the plain patterns, and the character models."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from surety.llm import secrets

ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def texts(rng, n):
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "API_KEY", ":", "=", " ", " ", "'", '"', "abc", "Zz9/+", "AKIA", "AKIAB",
            "0123456789abcdef", "deadbeef", "ABCDEF0123456789", "\n", "é", "", "", "😀", "_", "ſecret", "toKen="]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def run(df, ratios=None):
    ratios = secrets.train(df) if ratios is None else ratios
    return secrets.find(df, ratios).collect()


def test_base_spans(spark):
    rng = random.Random(1)
    rows = list(enumerate(texts(rng, 600))) + [(1000, None), (1001, ""), (None, "token=abcdefg"), (1002, "token=a" * 200), (1003, "f" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("base", F.lit("x"))
    want = {i: plain(t or "") for i, t in rows}
    got = run(df)
    assert len(got) == len(rows)
    for r in got:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == want[r["doc_id"]]
        spans = [(s["start"], s["kind"], s["end"]) for s in r["spans"]]
        assert spans == sorted(spans) and set(want[r["doc_id"]]) <= set(spans)


def test_models_tell_random_from_ordinary(spark):
    rng = random.Random(2)

    def word():
        return "".join(rng.choice(("ba", "lo", "ri", "ten", "um", "sha", "ing")) for _ in range(rng.randint(4, 9)))

    def key(n=32):
        return "".join(rng.choices(secrets.ALPHABET[:62], k=n))
    rows = [(i, " ".join(word() for _ in range(30)) + f" token = '{key()}' " + word()) for i in range(300)]
    ratios = secrets.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    probe = [(i, f"see {key()} here") for i in range(50)] + [(100 + i, f"see {word()}{word()}{word()}_{word()} here") for i in range(50)]
    found = {r["doc_id"]: r["spans"] for r in run(spark.createDataFrame(probe, "doc_id bigint, text string"), ratios)}
    assert sum(1 for i in range(50) if [tuple(s) for s in found[i]] == [(4, 3, 36)]) >= 48
    assert all(not found[100 + i] for i in range(50))


def test_models_count_every_document(spark):
    rng = random.Random(4)
    ids = spark.range(5100).withColumn("h", F.xxhash64("id")).orderBy("h", "id")
    last = {r["id"] for r in ids.collect()[-100:]}      # the only documents with a secret
    key = {i: "".join(rng.choices(secrets.ALPHABET[:62], k=32)) for i in last}
    rows = [(i, f"token={key[i]}" if i in last else "ordinary") for i in range(5100)]
    n, place = len(secrets.ALPHABET), secrets.ALPHABET.index
    counts = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    for side, words in ((1, key.values()), (0, ["ordinary"] * 5000)):
        for w in words:
            for a, b in zip(w, w[1:]):
                counts[side][place(a)][place(b)] += 1
    want = [math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a]))
            for a in range(n) for b in range(n)]
    assert secrets.train(spark.createDataFrame(rows, "doc_id bigint, text string")) == pytest.approx(want, abs=1e-9)


def test_without_samples_nothing_is_added(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    ratios = secrets.train(empty)
    assert set(ratios) == {0.0} and run(empty, ratios) == []
    assert run(spark.createDataFrame([(1, "Q7x" * 20)], "doc_id bigint, text string"), ratios)[0]["spans"] == []


@pytest.mark.parametrize("word", ["ab", "a", "aXb9Z0"])
def test_log_ratio(spark, word):
    n = len(secrets.ALPHABET)
    ratios = [float(k % 17) for k in range(n * n)]
    place = secrets.ALPHABET.index
    want = sum(ratios[place(a) * n + place(b)] for a, b in zip(word, word[1:]))
    assert spark.range(1).select(secrets.log_ratio(F.lit(word), ratios)).first()[0] == want


def test_one_text_of_a_megabyte_takes_seconds(spark):
    """One run of a million characters, and thousands of short runs: time is linear in both."""
    import time
    rng = random.Random(9)
    blob = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    many = " ".join("".join(rng.choices("0123456789abcdef", k=30)) for _ in range(6000))
    docs = spark.createDataFrame([(1, blob), (2, many), (3, "token = Ab12Cd34Ef")], "doc_id bigint, text string")
    ratios = secrets.train(docs)
    began = time.time()
    rows = {r["doc_id"]: r for r in secrets.find(docs, ratios).collect()}
    assert time.time() - began < 60
    assert [(s["start"], s["end"]) for s in rows[2]["base"]] == [(31 * i, 31 * i + 30) for i in range(6000)]
    assert len(rows[3]["base"]) == 1 and all(s["end"] - s["start"] == 1_000_000 for s in rows[1]["spans"])
