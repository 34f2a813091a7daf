"""The whole pipeline on the smallest tables: what each stage keeps, and what comes out."""

import random
import time
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from surety.llm import packing, quality, simhash
from surety.llm.common import components
from surety.llm.queries import ORACLES, QUERIES
from surety.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = docs.join(labels, "doc_id").where(quality.held_out())
    assert held.where("quality = 0").count() <= 1 and held.where("quality = 1").count() > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    # The texts that went in are as near-duplicate free as the second stage promises.
    second = spark.read.parquet(f"{tmp_path}/simhash_near_dedup")
    assert simhash.near_duplicates(second).groupBy("component_id").count().where("count > 1").count() == 0


def test_second_stage_joins_what_simhash_links(spark):
    """Two texts without a word have one fingerprint with all of its kind; NULL counts as empty."""
    long = " ".join(f"word{i}" for i in range(2000)).split()
    near = [*long[:700], "other", *long[701:]]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "nothing like the rest of them at all"), (4, ""), (5, None)]
    # Fewer words than a shingle: SimHash sees words of any white space and A-Z as a-z, shingles of five words link only equal sets.
    rows += [(6, "same three words"), (7, "Same  THREE\twords")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    grouped = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    kept = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, df, SF).collect())
    assert len({grouped[i] for i in kept}) == len(kept)
    assert {3, 6} <= set(kept) and not {5, 7} & set(kept)


def test_second_stage_runs_its_named_method(spark, monkeypatch):
    called = []
    plain = simhash.keep_one
    monkeypatch.setattr(corpus_pipeline.simhash, "keep_one", lambda docs: called.append(1) or plain(docs))
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id bigint, text string")
    assert corpus_pipeline.one_of_each_group(spark, df, SF).count() == 2 and called


def stored(spark, most, since=frozenset(), seconds=20):
    """Checkpoints beside those of ``since``, once they are ``most`` or the time is over; Spark removes them in a thread of its own."""
    until = time.time() + seconds
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    while True:
        found = {p for p in folder.glob("rdd-*")} - since
        if len(found) <= most or time.time() > until:
            return found
        time.sleep(0.2)


def test_second_stage_lets_go_of_finished_steps(spark):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
        for copy in range(5):
            rows.append((base * 10 + copy, " ".join([*words[:7 * copy], f"x{copy}", *words[7 * copy + 1:]])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    since = frozenset(stored(spark, 0, seconds=0))
    out = corpus_pipeline.one_of_each_group(spark, df, SF)
    # What is still read (documents SimHash leaves, smallest id of each set, links) and what the latest step left.
    assert len(stored(spark, 7, since)) <= 7
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(0, 120, 10))


def test_components_let_go_of_earlier_steps(spark):
    rng = random.Random(4)
    chain = rng.sample(range(1000, 2000), 60)
    links = [*zip(chain, chain[1:]), *((7, x) for x in range(8, 40)), (50, 51), (51, 52), (52, 50), (60, 60)]
    since = frozenset(stored(spark, 0, seconds=0))
    out = components(spark.createDataFrame(links, "a bigint, b bigint"))
    # The links, and what the latest step made of those before it.
    assert len(stored(spark, 5, since)) <= 5
    want = {x: min(chain) for x in chain} | {x: 7 for x in range(7, 40)} | {x: 50 for x in (50, 51, 52)}
    found = out.collect()
    assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"]
    assert all(len(r["ids"]) == r["length"] for r in out)
    total = sum(r["length"] for r in out)
    assert len({r["sequence_id"] for r in out}) <= -(-total // packing.CAPACITY) + 2
    docs = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        docs.setdefault(r["doc_id"], []).extend(r["ids"])
    assert all(ids[-1] == packing.END_ID for ids in docs.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    source = {"op1": "pages", "op7": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert df.count() == n or name.startswith("op3") and df.count() >= n
    assert set(ORACLES) <= set(QUERIES)


def test_held_out_documents_are_told_apart(spark):
    rows = QUERIES["op2_line_field_quality"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95

