"""Entropy of sampled generations after grouping those that say the same."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.columns import dot
from surety.functions.text import canonical_defect
from surety.plans.joins import attach_groups, bounded
from surety.plans.ranking import prefix_sums
from surety.plans.sketch import first_rows
from surety.session import materialise

#: Groups with more samples than this are clustered in rounds instead of in one task.
GROUP_LIMIT = 2000
#: Leaders found per round.
ROUND = 256


def valid_samples(generations: DataFrame) -> DataFrame:
    """Samples with a verdict; the text is the observation, or the raw text without one."""
    text = F.when(F.length("observation") > 0, F.col("observation")).otherwise(F.col("text"))
    return generations.where(F.col("vote").isNotNull()).withColumn("said", F.trim(text))


def hashed_text_vector(df: DataFrame, text: str = "said", name: str = "vector",
                       features: int = 256) -> DataFrame:
    """Unit-length hashed word counts of the whole text, for callers without embeddings."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    df = df.withColumn("_words", words)
    df = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features).transform(df)
    df = Normalizer(inputCol="_tf", outputCol="_unit").transform(df)
    return df.withColumn(name, vector_to_array("_unit")).drop("_words", "_tf", "_unit")


def _first_match(frame: pd.DataFrame, order: str, threshold: float) -> pd.DataFrame:
    """Greedy pass in order: join the first leader that is similar enough, or lead."""
    frame = frame.sort_values(order, kind="stable")
    vectors = np.stack([np.asarray(v, dtype=float) for v in frame["vector"]])
    leaders: list[int] = []
    assigned = np.empty(len(frame), dtype=np.int64)
    for i in range(len(frame)):
        # Summed from left to right, as the column function does: both give the same number.
        alike = np.cumsum(vectors[leaders] * vectors[i], axis=1)[:, -1] if leaders else []
        hits = np.flatnonzero(np.asarray(alike) >= threshold)
        if len(hits):
            assigned[i] = hits[0]
        else:
            assigned[i] = len(leaders)
            leaders.append(i)
    out = frame.drop(columns=["vector"])
    out["cluster"] = assigned
    return out


def greedy_clusters(samples: DataFrame, threshold: float = 0.85, key: str = "image_id",
                    order: str = "sample_idx", keep: Sequence[str] = ("vote",),
                    limit: int = GROUP_LIMIT, round_size: int = ROUND) -> DataFrame:
    """Assign each sample to the first earlier leader with cosine >= ``threshold``.

    ``samples`` carries a unit ``vector``. The order of the samples decides, so a group of
    ordinary size is one small pandas call. A larger group goes through exact rounds: the
    first unassigned samples elect leaders, every later sample takes its first matching
    leader, and the rest go to the next round.
    """
    columns = [key, order, *keep]
    rows = samples.select(*columns, "vector")
    schema = samples.select(*columns).schema.add("cluster", "long")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    large = materialise(sizes.where(F.col("_size") > limit).select(key))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return _first_match(frame, order, threshold)[[f.name for f in schema]]

    if not large.limit(1).count():
        return rows.groupBy(key).applyInPandas(one, schema)
    out = rows.join(large, key, "left_anti").groupBy(key).applyInPandas(one, schema)
    open_rows = rows.join(large, key, "left_semi").withColumn("_base", F.lit(0).cast("long"))
    while True:
        open_rows = materialise(open_rows)
        if not open_rows.limit(1).count():
            return out
        # A rank filter: each map task forwards at most round_size samples per group.
        rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
        head = (open_rows.select(*columns, "vector").withColumn("_r", rank)
                .where(F.col("_r") <= round_size).drop("_r"))
        elected = head.groupBy(key).applyInPandas(
            lambda f: _first_match(f, order, threshold)[[f_.name for f_ in schema]], schema)
        leaders = (elected.groupBy(key, "cluster").agg(F.min(order).alias(order))
                   .join(head.select(key, order, "vector"), [key, order])
                   .groupBy(key).agg(F.array_sort(F.collect_list(
                       F.struct("cluster", "vector"))).alias("_leaders")))
        joined = attach_groups(open_rows, leaders, [key])
        near = F.filter("_leaders", lambda x: dot(x["vector"], F.col("vector")) >= threshold)
        # A leader always matches itself, also when rounding leaves its norm just below 1.
        first = F.when(F.size(near) > 0, near[0]["cluster"])
        placed = materialise(joined.select(*columns, "vector", "_base", first.alias("_c"),
                                           F.size("_leaders").alias("_n")))
        own = elected.select(key, order, F.col("cluster").alias("_own"))
        placed = placed.join(own, [key, order], "left").withColumn(
            "_c", F.coalesce("_own", "_c"))
        out = out.unionByName(placed.where(F.col("_c").isNotNull()).select(
            *columns, (F.col("_base") + F.col("_c")).alias("cluster")))
        open_rows = placed.where(F.col("_c").isNull()).select(
            *columns, "vector", (F.col("_base") + F.col("_n")).alias("_base"))


#: Samples of a key that one task decides one after another in a round of entailment clustering.
PREFIX = 512


def _mutual(pairs: DataFrame, threshold: float, key: str) -> DataFrame:
    """``key, a, b, m``: pairs of samples, the earlier first, that entail each other enough."""
    low, high = F.least("premise", "hypothesis"), F.greatest("premise", "hypothesis")
    forth = F.max(F.when(F.col("premise") == F.col("a"), F.col("entail")))
    back = F.max(F.when(F.col("premise") == F.col("b"), F.col("entail")))
    both = (pairs.where(F.col("premise") != F.col("hypothesis")).select(key, low.alias("a"), high.alias("b"), "premise", "entail")
            .groupBy(key, "a", "b").agg(forth.alias("f"), back.alias("g")))
    return both.where((F.col("f") >= threshold) & (F.col("g") >= threshold)).select(key, "a", "b", F.least("f", "g").alias("m"))


def _followers(links: DataFrame, key: str, prefix: int) -> DataFrame:
    """``key, b``: samples that link to an earlier leader, in rounds over the links that are still open.

    A sample leads if no earlier leader links to it. In a round one task a key decides its first
    ``prefix`` open samples in their order, samples without an open earlier neighbour lead as well,
    and all that link to a new leader follow; links of decided samples are closed.
    """
    spark = links.sparkSession
    schema = T.StructType([links.schema[key], links.schema["a"]])
    ids = T.StructType([links.schema[key], T.StructField("b", links.schema["b"].dataType)])
    done: DataFrame = spark.createDataFrame([], ids)
    open_links = materialise(links.select(key, "a", "b"))

    def leaders(frame: pd.DataFrame) -> pd.DataFrame:
        earlier: dict = {}
        for a, b in zip(frame["a"], frame["b"]):
            earlier.setdefault(b, []).append(a)
        leads: set = set()
        for sample in sorted({*frame["a"], *frame["b"]}):
            if not any(a in leads for a in earlier.get(sample, ())):
                leads.add(sample)
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(leads), "a": sorted(leads)})

    while not open_links.isEmpty():
        samples = open_links.select(key, F.col("a").alias("s")).union(open_links.select(key, "b")).distinct()
        first = first_rows(samples, [key], ["s"], prefix)
        last = bounded(first.groupBy(key).agg(F.max("s").alias("_last")))
        near = open_links.join(last, key).where(F.col("b") <= F.col("_last")).drop("_last")
        free = open_links.select(key, "a").distinct().join(open_links.select(key, F.col("b").alias("a")).distinct(), [key, "a"], "left_anti")
        leading = near.groupBy(key).applyInPandas(leaders, schema).union(free.select(key, "a")).distinct()
        found = materialise(open_links.join(leading, [key, "a"]).select(key, "b").distinct())
        done = done.union(found)
        left = open_links.join(leading, [key, "a"], "left_anti").join(found, [key, "b"], "left_anti")
        open_links = materialise(left.join(found.withColumnRenamed("b", "a"), [key, "a"], "left_anti").select(key, "a", "b"))
    return done


def entailment_clusters(samples: DataFrame, pairs: DataFrame, threshold: float = 0.5,
                        key: str = "image_id", order: str = "sample_idx",
                        keep: Sequence[str] = ("vote",), prefix: int = PREFIX) -> DataFrame:
    """Assign each sample to the leader it mutually entails most, if that is enough.

    ``pairs`` holds ``(key, premise, hypothesis, entail)`` for the sample numbers of a key; what is not
    in it does not entail, and of repeated pairs the largest counts. A sample leads a cluster of
    its own if no earlier leader reaches ``threshold`` (above 0) both ways; else it joins the one
    with the largest mutual score, the earliest of equals. Work follows the pairs that reach the
    threshold; no task holds the samples or the pairs of a key.
    """
    if threshold <= 0:
        raise ValueError(f"threshold must be above 0, got {threshold}")
    columns = [key, order, *keep]
    known = samples.select(key, F.col(order).alias("s"))
    links = _mutual(pairs.select(key, "premise", "hypothesis", "entail"), threshold, key)
    # Pairs of samples that are not there do not count.
    for end in "ab":
        links = links.join(known.withColumnRenamed("s", end).distinct(), [key, end], "left_semi")
    links = materialise(links)
    follows = materialise(_followers(links, key, prefix))
    leads = known.join(follows.withColumnRenamed("b", "s"), [key, "s"], "left_anti").distinct()
    numbered = prefix_sums(leads.withColumn("_one", F.lit(1)), [key], ["s"], ["_one"]).select(
        key, F.col("s").alias("_leader"), F.col("_one_before").cast("bigint").alias("cluster"))
    numbered = materialise(numbered)
    joins = (links.join(follows, [key, "b"]).join(numbered.select(key, F.col("_leader").alias("a")), [key, "a"], "left_semi")
             .groupBy(key, "b").agg(F.min(F.struct((-F.col("m")).alias("m"), "a")).alias("best"))
             .select(key, F.col("b").alias(order), F.col("best.a").alias("_joins")))
    out = samples.select(*columns).join(joins, [key, order], "left").withColumn("_leader", F.coalesce("_joins", F.col(order)))
    return out.join(numbered, [key, "_leader"]).select(*columns, "cluster")


def label_entropy(df: DataFrame, key: str, labels: Sequence[str], name: str = "entropy",
                  normalise: bool = True) -> DataFrame:
    """Entropy of label combinations per key, divided by ``ln n`` unless there is one sample."""
    counts = df.groupBy(key, *labels).agg(F.count(F.lit(1)).alias("_c"))
    # sum of -(c/n) ln(c/n) = ln n - (sum c ln c) / n, so one more aggregation is enough.
    stats = counts.groupBy(key).agg(F.sum("_c").alias("n"),
                                    F.sum(F.col("_c") * F.log("_c")).alias("_s"))
    n = F.col("n")
    h = F.log(n) - F.col("_s") / n
    value = h / F.log(n) if normalise else h
    return stats.select(key, "n", F.when(n == 1, F.lit(0.0)).otherwise(
        F.greatest(value, F.lit(0.0))).alias(name))


def cluster_entropy(clusters: DataFrame, key: str = "image_id") -> DataFrame:
    return label_entropy(clusters, key, ["cluster"])


def joint_entropy(clusters: DataFrame, key: str = "image_id") -> DataFrame:
    """Entropy over (verdict, cluster) pairs."""
    return label_entropy(clusters, key, ["vote", "cluster"])


def semantic_entropy(records: DataFrame, clusters: DataFrame, joint: bool = False,
                     key: str = "image_id") -> DataFrame:
    """Attach ``u_semantic_entropy``: 1 without a valid sample, 0 with a single one."""
    entropy = joint_entropy(clusters, key) if joint else cluster_entropy(clusters, key)
    out = records.join(entropy.select(key, F.col("entropy").alias("_h")), key, "left")
    return out.withColumn("u_semantic_entropy", F.coalesce("_h", F.lit(1.0))).drop("_h")


def signature_entropy(generations: DataFrame, key: str = "image_id") -> DataFrame:
    """Entropy over (verdict, canonical defect) of valid samples, and 1 - mean confidence."""
    from surety.operators.signals import confidence_value
    valid = generations.where(F.col("vote").isNotNull()).withColumn(
        "_defect", canonical_defect(F.col("defect_type")))
    conf: Column = confidence_value(F.col("confidence"))
    means = valid.groupBy(key).agg((F.lit(1.0) - F.avg(conf)).alias("confidence_uncertainty"))
    return label_entropy(valid, key, ["vote", "_defect"], "semantic_entropy").drop("n").join(
        means, key)
