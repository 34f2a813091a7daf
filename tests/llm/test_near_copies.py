"""Near copies of the pipeline's stage against brute-force Jaccard similarity."""

import random
import re

import pytest

import corpus_pipeline
from surety.llm import near_copies

SF = "/root/testdata/sf0.01"


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4)))


def brute(rows):
    """Smallest id of each component over pairs with a Jaccard similarity of at least 0.8."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return set(low.values())


@pytest.mark.parametrize("block_bytes", [2 << 20, 4000])
def test_near_copies_on_both_sides_of_the_bound(spark, block_bytes):
    rng = random.Random(5)
    rows = [(900, None), (901, ""), (902, "one two"), (903, "One  TWO")]
    for base in range(25):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice((5, 9, 30, 60, 200, 900)))]
        for copy in range(6):
            changed = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((base * 10 + copy, " ".join(changed)))
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id bigint, text string, _fp string")
    kept = near_copies.keep_one(df, block_bytes).collect()
    want = brute(rows)
    assert len(want) < len(rows) and sorted(r["doc_id"] for r in kept) == sorted(want)
    assert {r["_fp"] for r in kept} == {"k"}


def test_stage_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, SF).select("doc_id").collect()) == sorted(want)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, None)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_copies.keep_one(df).count() == min(len(rows), 1)
