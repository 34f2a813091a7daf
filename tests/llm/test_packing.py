"""Tokens against the tokenizer itself, and packing against its own rules."""

import random
import zlib

import numpy as np
import pytest

from surety.llm import packing
from surety.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
TEXTS = ["", " ", "a\tb  c\r\n d e", "<|endoftext|> x<|endoftext|>y <|STARTOFTEXT|>", "é ́x İ İ Å ΑΣ ΣΑ K̇ Ⅷ",
         " a\x1cb\x85c", "'s don't 12a ''ll", "日本語 テキスト 😀", "A" * 300, None]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkl'é!", k=rng.randint(1, 9))) for _ in range(n))


def test_ids_equal_the_tokenizers():
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + [words(rng, rng.randint(0, 300)) for _ in range(100)]
    encoder = packing.ChunkEncoder(PATH)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [list(x) for x in encoder.batch([t.encode() for t in texts])] == want


def check(rows, texts, capacity):
    """Every piece once, gapless offsets, lengths within capacity, checksums of the real ids."""
    encoder = packing.ChunkEncoder(PATH)
    want = []
    for doc, text in texts:
        ids = np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        want += [(doc, p, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes()))
                 for p, a in enumerate(range(0, len(ids), capacity))]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packs_every_piece(spark):
    rng = random.Random(2)
    texts = [(i, words(rng, rng.randint(0, 80))) for i in range(200)] + [(300 + i, t) for i, t in enumerate(TEXTS)]
    texts += [(7, texts[7][1])] * 40 + [(None, "x"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 as length", "2 as piece")
    bins, least = check(packing.pack_documents(df, PATH, capacity=128).collect(), texts, 128)
    assert bins <= least + 2
    shards = packing.pack(packing.pieces(df, PATH, 128), 128, shard_pieces=40).collect()
    assert check(shards, texts, 128)[0] <= least * 1.2 + 10


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_keeps_ids(spark):
    df = spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string")
    row = packing.pack_documents(df, PATH, keep_ids=True).collect()[0]
    assert row["ids"][-1] == packing.END_ID and len(row["ids"]) == row["length"]


def test_two_tighter_pieces_replace_the_smallest():
    # Greedy gives 60 + 30 and leaves 10; 22 + 18 fill the room of 40 that 30 leaves.
    bins, offsets = packing.best_two_fit(np.array([60, 30, 22, 18, 25]), 100)
    held = sorted(np.array([60, 30, 22, 18, 25])[bins == bins[0]].tolist())
    assert held == [18, 22, 60] and bins.max() == 1


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 4096)
    bins, offsets = packing.best_two_fit(lengths)
    size = np.bincount(bins, weights=lengths)
    assert size.max() <= 4096 and bins.max() + 1 <= -(-lengths.sum() // 4096) + 3
    for b in range(0, int(bins.max()) + 1, 37):
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(lengths[bins == b][order])[:-1] == offsets[bins == b][order][1:]).all()
