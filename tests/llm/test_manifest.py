"""Merkle manifest: every proof against plain Python."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from surety.llm import manifest

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def above(nodes):
    """The top of a list of nodes, and the siblings of each on the way."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, place):
            first = at - at % 16
            path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 16])))
        nodes, place = [digest(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)], [at // 16 for at in place]
    return nodes[0], paths


def expected(rows):
    def source(r):
        return (r[1] is not None, (r[1] or "").encode())

    found = []
    for _, group in groupby(sorted(rows, key=source), source):
        group = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, paths = above([leaf(r, r[4]) for r in group])
        found.append((top, list(zip(group, paths))))
    root, upper = above([top for top, _ in found])
    out = []
    for (top, group), rest in zip(found, upper):
        for row, path in group:
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf(row, text)
            for left, right in path + rest:
                node = digest(left, node, right)
            out.append((row[0], leaf(row, row[4]), top, root, digest(*[a + b for a, b in path + rest]), node, node == root))
    return sorted(out, key=str)


def table(sizes):
    rng = random.Random(3)
    rows = []
    for source, n in sizes.items():
        ids = rng.sample(range(-5, 10 * n + 5), n)
        rows += [(i, source, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice(["", None, "Äb C", "x" * 40, "Hello W"])) for i in ids]
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"a": 257, "é": 300, "": 2, None: 20}, {f"s{i}": 1 for i in range(40)}])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_proofs(spark, sizes, step):
    rows = table(sizes)
    got = manifest.verify(spark.createDataFrame(rows, SCHEMA), step)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_deep_source(spark):
    rows = table({"a": 4500, "b": 3})
    assert sorted(map(tuple, manifest.verify(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == expected(rows)


def test_nulls_ties_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "a", "en", 3, "ABC")] * 40 + [(5, "a", "en", 3, "abd"), (None, "a", None, 1, "X"), (10, "b", "", 0, "Long " * 400_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(9) for c in ("leaf", "tree", "n", "i", "row", "_one", "digest")})
    assert sorted(map(tuple, manifest.verify(docs).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    got = manifest.verify(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_paths_fold_to_the_root(spark):
    built = manifest.build(spark.createDataFrame(table({"a": 300, "b": 5}), SCHEMA))
    rows = built.proofs().withColumn("top", manifest.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 305 and {r["top"] for r in rows} == {built.root}
    assert {len(r["path"]) for r in rows} == {2, 4}


def test_only_every_few_levels_are_stored(spark):
    built = manifest.build(spark.createDataFrame(table({"a": 4500}), SCHEMA), step=2)
    assert [t.count() for t in built.sources.levels] == [18, 1]
