"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from surety.llm import suffix_dedup
from surety.llm.common import Scratch


def brute(rows, length=suffix_dedup.LENGTH):
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n, alphabet="abcdefghijklmnopqrstuvwxyzéß"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in suffix_dedup.digest(df).collect()), key=str)


def test_overlapping_passages_copies_and_edges(spark):
    rng = random.Random(1)
    passages = [words(rng, n) for n in (30, 40, 60, 90)]
    rows = [(i, words(rng, rng.randint(0, 60)) + rng.choice(passages) + words(rng, rng.randint(0, 40))
             + (rng.choice(passages) if i % 3 else "")) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]                       # exact copies
    rows += [(200 + i, rows[i][1].replace("a", "b", 1)) for i in range(20)]    # near copies
    rows += [(300 + i, rows[3][1][i * 7:]) for i in range(20)]               # shifted starts
    edge = words(rng, 80).encode()[:199].decode(errors="ignore")
    rows += [(400, edge), (401, "x" + edge), (402, edge), (403, None), (404, ""), (None, words(rng, 50)), (405, None)]
    assert run(spark, rows) == brute(rows)


def test_windows_of_exact_length(spark):
    rng = random.Random(2)
    core = "".join(rng.choices("abcdefgh ", k=230))
    rows = [(0, core)]
    rows += [(n, "".join(rng.choices("ijkl ", k=40)) + core[30 - n % 31:30 - n % 31 + 185 + n] + "".join(rng.choices("mnop ", k=40)))
             for n in range(1, 40)]
    assert run(spark, rows) == brute(rows)


def test_runs_and_periods(spark):
    rng = random.Random(3)
    rows = [(0, "a" * 450), (1, "b" * 150 + "a" * 260), (2, "ab" * 180), (3, "ba" * 90), (4, "the the " * 60),
            (5, words(rng, 50) + "the " * 80), (6, "a" * 199), (7, "a" * 200 + "c" * 200), (8, "abc" * 130 + words(rng, 30)),
            (9, "x" + "c" * 205), (10, " " * 500), (11, "aab" * 100), (12, "q" * 210)]
    rows += [(20 + i, "".join(rng.choices("ab", k=rng.randint(150, 700)))) for i in range(10)]
    rows += [(40 + i, rows[13 + i][1][i:] + rows[14 + i][1][:260]) for i in range(8)]
    assert run(spark, rows) == brute(rows)


def test_recursion_orders_like_plain_sort(spark):
    """Cores longer than three phrases force the names to be sorted recursively."""
    rng = random.Random(4)
    strings = {s: [rng.choice((1, 1, 1, 2)) for _ in range(rng.randint(1, 60))] for s in range(12)}
    strings[50] = [1] * 40
    need = 12
    rows = [(s, i, c, *(cs[i + 1:i + 3] + [0, 0])[:2], need) for s, cs in strings.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "seg bigint, i int, c bigint, c1 bigint, c2 bigint, need int").selectExpr("*", "0L as core")
    got = [(r["seg"], r["i"]) for r in suffix_dedup.suffix_order(Scratch(spark), df).orderBy("k1", "k2", "k3").collect()]
    prefixes = [tuple(strings[s][i:i + need]) for s, i in got]
    assert prefixes == sorted(prefixes)
    assert len(set(got)) == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, "short")], [(1, None), (2, None)]])
def test_tables_without_repeats(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_removal_keeps_columns(spark):
    rng = random.Random(5)
    shared = words(rng, 60)
    rows = [(1, words(rng, 20) + shared, "k", 3), (2, shared + words(rng, 20), "k", 4), (3, "clean text", None, None), (4, None, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _spans string, n_chars bigint")
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert out[3]["text"] == "clean text" and out[3]["n_chars"] == 10 and out[4]["text"] is None and out[4]["n_chars"] == 0
    assert shared not in out[1]["text"] and out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[1]["_spans"] == "k"
