"""Fingerprints and groups against plain Python."""

import random
import re

import pytest
import xxhash

from surety.llm import simhash


def fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted([(rows[i][0], f"{fps[i]:016x}", low.get(find(i))) for i in range(len(rows))], key=str)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeÄß", k=rng.randint(1, 6))) for _ in range(n))


def make(rng):
    rows = [(i, words(rng, rng.choice((0, 1, 2, 3, 40, 400)))) for i in range(80)]
    long = [t for _, t in rows if len(t) > 800]
    rows += [(200 + i, rng.choice(long).replace("a", "b", rng.randint(1, 2))) for i in range(60)]
    rows += [(300 + i, rows[4][1]) for i in range(30)] + [(400, None), (401, ""), (402, " \t\n"), (None, rows[6][1]), (None, "zz"), (5, "zz")]
    rows += [(500, "A B C d\x0be f"), (501, "a b c d e f"), (502, "x" * 5000), (5, rows[5][1])]
    return rows


def test_groups(spark):
    rows = make(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=str)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})


def test_links_of_close_fingerprints_with_split_cells(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for base in list(fps):
        for _ in range(8):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randint(0, 1))
    center = rng.getrandbits(64)
    fps |= {center ^ (1 << b) for b in range(64)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    pairs = {(a, b) for (a,) in signed for (b,) in signed if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2}

    def classes(edges):
        root = {f: f for (f,) in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for (f,) in signed:
            out.setdefault(find(f), set()).add(f)
        return {frozenset(s) for s in out.values()}
    for cell_rows in (4096, 7):
        links = [tuple(r) for r in simhash.fingerprint_links(df, cell_rows).collect()]
        assert classes(links) == classes(pairs)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, None)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=str) == brute(rows)
    assert simhash.keep_one(df).count() == min(len(rows), 1)


def test_one_of_each_group_stays(spark):
    rows = make(random.Random(3))
    want = {r[2] for r in brute(rows)}
    df = spark.createDataFrame([(d, t, "k", i) for i, (d, t) in enumerate(rows)], "doc_id bigint, text string, _fp string, `n.chars` int")
    kept = simhash.keep_one(df).collect()
    assert {r["doc_id"] for r in kept} == want and {r["_fp"] for r in kept} == {"k"}
    fps = [fingerprint(r["text"]) for r in kept]
    assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(fps) for b in fps[:i])
