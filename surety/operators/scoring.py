"""Scoring embeddings against text templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import (anomaly_probability, array_mean, dot, l2_normalise)
from surety.plans.joins import attach_groups, require_none

AGGREGATES = ("mean_embedding", "mean_template")


def text_table(text: DataFrame, group: str = "category") -> DataFrame:
    """One row per group: the template vectors of each polarity, in template order.

    Templates are a handful of vectors per group.
    """
    def templates(polarity: str):
        return F.array_sort(F.collect_list(F.when(
            F.col("polarity") == polarity, F.struct("template_idx", "embedding"))))

    both = text.groupBy(group).agg(templates("normal").alias("_n"), templates("anomaly").alias("_a"))

    def field(side: str, name: str):
        return F.transform(side, lambda x: x[name])

    return both.select(group, field("_n", "embedding").alias("t_normal"),
                       field("_a", "embedding").alias("t_anomaly"),
                       (field("_n", "template_idx") == field("_a", "template_idx")).alias("t_paired"))


def _mean_vector(templates):
    """Mean of the template vectors, rescaled to unit length."""
    total = F.aggregate(
        F.slice(templates, 2, F.size(templates)),
        F.transform(templates[0], lambda x: x.cast("double")),
        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return l2_normalise(F.transform(total, lambda x: x / F.size(templates)))


def text_means(text: DataFrame, group: str = "category") -> DataFrame:
    """Unit mean vector of each polarity per group."""
    return text_table(text, group).select(
        group, _mean_vector(F.col("t_normal")).alias("m_normal"),
        _mean_vector(F.col("t_anomaly")).alias("m_anomaly"))


def score_mean_embedding(df: DataFrame, text: DataFrame, tau: float, group: str = "category",
                         vector: str = "embedding") -> DataFrame:
    """Score against the mean template of each polarity."""
    out = attach_groups(df, text_means(text, group), [group])
    cos_n, cos_a = dot(F.col(vector), F.col("m_normal")), dot(F.col(vector), F.col("m_anomaly"))
    return (out.withColumns({"_cn": cos_n, "_ca": cos_a})
            .withColumns({"anomaly_score": anomaly_probability(F.col("_cn"), F.col("_ca"), tau),
                          "raw_score": F.col("_ca") - F.col("_cn")})
            .drop("m_normal", "m_anomaly", "_cn", "_ca"))


def template_scores(df: DataFrame, text: DataFrame, tau: float, group: str = "category",
                    vector: str = "embedding") -> DataFrame:
    """Attach ``tpl`` (probability per template pair) and ``tplraw`` (cosine margin).

    The polarities are paired by ``template_idx``; a group in which one lacks a partner raises.
    """
    out = attach_groups(df, text_table(text, group), [group])
    v = F.col(vector)
    margins = F.when(F.col("t_paired").isNull() | F.col("t_paired"), F.zip_with(
        "t_normal", "t_anomaly", lambda n, a: dot(v, a) - dot(v, n))).otherwise(F.raise_error(
            F.concat(F.lit("templates without a partner in group "), F.col(group).cast("string"))
        ).cast("array<double>"))
    return (out.withColumn("tplraw", margins)
            .withColumn("tpl", F.transform("tplraw", lambda m: anomaly_probability(
                F.lit(0.0), m, tau)))
            .drop("t_normal", "t_anomaly", "t_paired"))


def score_index(index: DataFrame, embeddings: DataFrame, text: DataFrame, tau: float = 0.01,
                aggregate: str = "mean_embedding", keep_per_template: bool = True,
                group: str = "category", row: str = "image_id") -> DataFrame:
    """Score every index row from its stored embedding.

    A group without text vectors raises at once, a row without an embedding when it is scored:
    index and embeddings are joined one time only. ``embeddings`` holds one shard selection (model, corruption, severity, view), so the same call scores a named
    view or a corrupted copy.
    """
    if aggregate not in AGGREGATES:
        raise KeyError(f"unknown aggregate {aggregate!r}; one of {AGGREGATES}")
    require_none(index.select(group).distinct().join(text, group, "left_anti"),
                 "no text embeddings for a group")
    kind = embeddings.schema["embedding"].dataType
    missing = F.raise_error(F.concat(F.lit("an image has no stored embedding: "),
                                     F.col(row).cast("string"))).cast(kind)
    rows = index.join(embeddings.select(row, "embedding"), row, "left").withColumn(
        "embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(missing))
    if aggregate == "mean_template" or keep_per_template:
        rows = template_scores(rows, text, tau, group)
    if aggregate == "mean_template":
        rows = rows.withColumns({"anomaly_score": array_mean(F.col("tpl")),
                                 "raw_score": array_mean(F.col("tplraw"))})
    else:
        rows = score_mean_embedding(rows, text, tau, group)
    if not keep_per_template:
        rows = rows.drop("tpl", "tplraw")
    return rows.drop("embedding").withColumns({"parse_ok": F.lit(True),
                                               "n_valid_votes": F.lit(1).cast("bigint")})
