"""One query per operator over the driver's tables: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.llm import clustering, embedding_dedup, language, manifest, minhash, packing, pii, quality, secrets, sentencepiece_fst, simhash, suffix_dedup, url_filters
from surety.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query
def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_line_field_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, field)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query
def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op4_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


@query
def op6_sentencepiece_transducer(spark, sf_dir):
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op7_inverted_multi_index(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.train(docs))
    names = F.array(*map(F.lit, secrets.KINDS))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint") for kind in range(3)]
    return found.select("doc_id", *[c.alias(f"n_{k}") for c, k in zip(counts, secrets.KINDS)],
                        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def span_list(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def spans_of(spans: str, kind: str):
    """``n_<kind>``: how many of the spans are of that kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@query
def op9_skip_chain_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.train(docs))
    return found.select("doc_id", *[spans_of("base", k) for k in pii.KINDS], F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


@query
def op10_document_fingerprints(spark, sf_dir):
    return minhash.fingerprint_next(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark, sf_dir):
    return manifest.verify(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


@query
def op12_rank_order_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = language.train(docs.select("doc_id", "text", "lang"))
    named = language.identify(docs.select("doc_id", "text"), profiles)
    return named.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op13_shallot_clustering(spark, sf_dir):
    return clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
