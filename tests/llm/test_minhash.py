"""One-permutation MinHash: columns against plain Python, likeness against true similarity."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from surety.llm import minhash
from surety.llm.common import utf8_steps


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghÄ", k=rng.randint(1, 7))) for _ in range(n))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((doc, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_order_and_edits(spark, range_rows):
    rng = random.Random(1)
    rows = [(rng.randint(-50, 10 ** 6), words(rng, rng.randint(0, 40))) for _ in range(60)]
    rows += [(5, None), (6, ""), (7, "é😀" * 30), (None, "no id"), (None, None), (9, "same"), (9, "same"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.fingerprint_next(df, range_rows=range_rows).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == expected(rows)
    same = {}
    for r in got:
        same.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in same.values())
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 9}) == 2


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f g")], [(1, None)]])
def test_tiny_tables(spark, rows):
    got = minhash.fingerprint_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == (expected(rows) if rows else [])
    assert all(r["near_next"] == 1 for r in got)


def test_shingles_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 30)) for _ in range(50)] + ["", " ", "a" * 300, "a b", "A  B\tc\nd e f", "a b c d e f", "b" * 64 + "c", "c" + "b" * 64]
    method = minhash.OnePermutationMinHash()
    together = method.codes_of(texts)
    alone = np.concatenate([method.codes_of([t]) for t in texts])
    assert (together == alone).all()
    assert (method.codes_of(["A  B\tc\nd e f"]) == method.codes_of(["a b c d e f"])).all()
    assert (method.codes_of(["b" * 64 + "c"]) != method.codes_of(["c" + "b" * 64])).any()


def test_likeness_estimates_jaccard():
    rng = random.Random(3)
    method = minhash.OnePermutationMinHash()
    errors = []
    for _ in range(60):
        a = words(rng, rng.randint(20, 400)).split()
        b = a[:int(len(a) * rng.random())] + words(rng, rng.randint(5, 200)).split()

        def shingles(w):
            return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
        true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        codes = method.codes_of([" ".join(a), " ".join(b)])
        errors.append(float(method.likeness(codes[:1], codes[1:])[0]) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_steps_cover_slices():
    texts = pa.array(["ab", "", "é", None, "xyz"]).fill_null("").slice(1)
    steps = list(utf8_steps(texts, 2))
    assert [s[:2] for s in steps][-1][1] == 4 and sum(len(s[2]) for s in steps) == 5
