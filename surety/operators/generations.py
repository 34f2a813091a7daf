"""From free-text generations to records: parsing, votes, verdict probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surety.functions.columns import log_sum_exp, logistic, raw_logit
from surety.functions.text import parse_generation

#: Lower-cased tokens that state a verdict, and the word that announces it (fixed values).
VERDICT_TOKENS = ("yes", "no")
MARKER = "ANSWER"


def parse(generations: DataFrame, text: str = "text") -> DataFrame:
    """Attach the parsed fields of each generation."""
    return generations.withColumns(parse_generation(F.col(text)))


def vote_aggregate(parsed: DataFrame, key: str = "image_id",
                   order: str = "sample_idx") -> DataFrame:
    """Votes and the first sample's fields, one row per image."""
    def head(field: str):
        return F.min_by(field, order)

    return parsed.groupBy(key).agg(
        F.avg("vote").alias("vote_fraction"),
        F.count("vote").alias("n_valid_votes"),
        (F.count("vote") > 0).alias("parse_ok"),
        F.count(F.lit(1)).alias("n_generations"),
        head("observation").alias("observation"), head("defect_type").alias("predicted_defect"),
        head("location").alias("predicted_location"),
        head("confidence").alias("predicted_confidence"))


def verdict_probability(tokens: DataFrame, gen: str = "gen_id", pos: str = "pos",
                        candidates: Sequence[str] = VERDICT_TOKENS) -> DataFrame:
    """P(yes) at the token that states the verdict, one row per generation.

    The verdict is the first candidate token after the text ``ANSWER`` has been completed, or
    the last candidate when that text never appears or nothing follows it. A generation is
    bounded by the decoder's length limit, so its window is small.
    """
    here = Window.partitionBy(gen).orderBy(pos)
    # The marker can be cut anywhere: carry enough of the text before the token.
    joined = F.concat(*[F.coalesce(F.lag("token", i).over(here), F.lit(""))
                        for i in range(len(MARKER) - 1, 0, -1)], F.col("token"))
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    flagged = tokens.withColumn("_done", joined.contains(MARKER)).withColumn(
        "_after", F.coalesce(F.max("_done").over(before), F.lit(False)))
    stated = F.lower(F.trim("token")).isin(*candidates)
    after = stated & F.col("_after")
    score = F.struct(pos, "yes_logprobs", "no_logprobs")
    picked = flagged.groupBy(gen).agg(
        F.coalesce(F.min_by(F.when(after, score), F.when(after, F.col(pos))),
                   F.max_by(F.when(stated, score), F.when(stated, F.col(pos)))).alias("_s"))
    p = logistic(log_sum_exp(F.col("_s.yes_logprobs")) - log_sum_exp(F.col("_s.no_logprobs")))
    return picked.select(gen, F.col(f"_s.{pos}").alias("verdict_pos"), p.alias("p_yes"))


def generation_records(votes: DataFrame, p_yes: DataFrame | None = None,
                       key: str = "image_id") -> DataFrame:
    """Scores from the verdict probability where given, else from the votes.

    An image without a usable verdict keeps its row with a missing score.
    """
    if p_yes is None:
        return votes.withColumns({"anomaly_score": F.col("vote_fraction"),
                                  "raw_score": F.col("vote_fraction")})
    out = votes.join(p_yes.select(key, "p_yes"), key, "left")
    return out.withColumns({
        "anomaly_score": F.col("p_yes"), "raw_score": raw_logit(F.col("p_yes")),
        "parse_ok": F.col("p_yes").isNotNull()}).drop("p_yes")
