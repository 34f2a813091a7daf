"""Secrets in text: base patterns, and character Markov models that add to them.

The base spans are fixed patterns: assignments to password-like names, access keys, long
hexadecimal runs. They always stay. For other long runs of key characters two first-order Markov
models of characters are compared, one of random strings and one of ordinary identifiers. Both are
trained on all documents: the values in base spans, and the other words. A run is reported if its
log-likelihood ratio reaches the prior odds ``PRIOR_ODDS`` against a random string.

All of it is DataFrame operations. A pattern's matches are set off by a separator and the text is
split there, so the lengths of the parts give every position. Only the table of character pairs
(at most two rows for each pair) reaches the driver. Each whole text is read once to train and once
to label, and only counts of pairs move.

Defined results: NULL text is empty and has no spans; a NULL ``doc_id`` is kept; repeated rows are
treated alike; without labelled samples all pairs are equally likely and nothing is added; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.functions.columns import let
from surety.llm.common import whole_text

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Characters of the runs that the models judge, and the shortest run judged.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 20
_RUN = "[A-Za-z0-9+/_=-]"
#: Words of at least so many characters are samples of ordinary identifiers.
LEAST_WORD = 8
PRIOR_ODDS = 1000.0
SMOOTHING = 0.5
KINDS = ("assign", "access", "hex", "random")

_MARK, _OTHER = "\ue000", "\ue001"
#: Parts of a text, an even number, whose spans are listed together.
RUN_PARTS = 512
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def matches(text: Column, pattern: str, kind: int, accept) -> Column:
    """Spans of the leftmost non-overlapping matches that ``accept`` keeps, in code points.

    A separator inside the text is first replaced by a character as long that no pattern uses.
    The parts between separators are walked in runs of ``RUN_PARTS``, so that lists of spans grow by
    runs and not by single spans.
    """
    parts = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast(f"array<{SPAN}>")

    def walk(run: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.lit(False).alias("inside"), none.alias("spans"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            spans = F.when(acc["inside"] & accept(part), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), spans.alias("spans"))
        return F.aggregate(run, zero, step, lambda acc: acc["spans"])

    # Parts alternate between text and match, so a run of an even number of parts begins with text.
    def runs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN_PARTS).cast("int")),
                           lambda i: F.slice(parts, i * RUN_PARTS + 1, F.lit(RUN_PARTS)))

    def lengths(runs: Column) -> Column:
        return F.transform(runs, lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda n, part: n + F.length(part)))

    def starts(sizes: Column) -> Column:
        return F.aggregate(sizes, F.array(F.lit(0).cast("bigint")), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))

    found = let(parts, lambda p: let(runs(p), lambda r: let(starts(lengths(r)), lambda at: F.flatten(
        F.transform(r, lambda run, i: walk(run, F.get(at, i)))))))
    # Texts without a match keep an empty list.
    return F.when(text.rlike(pattern), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    # A hexadecimal run is matched whole or not at all, so the shortest accepted length can stand
    # in its pattern; the same holds for access keys, whose matches end where their run ends.
    return F.sort_array(F.concat(
        matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= LEAST_ASSIGN),
        matches(text, rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}", 1, lambda m: F.lit(True)),
        matches(text, rf"[0-9a-f]{{{LEAST_HEX},}}", 2, lambda m: F.lit(True))))


def _pairs(word: Column) -> Column:
    # Pairs that start at even places, then at odd ones: linear in the length of the word.
    return F.concat(F.regexp_extract_all(word, F.lit(".."), 0), F.regexp_extract_all(F.substring(word, 2, 1 << 30), F.lit(".."), 0))


def train(docs: DataFrame) -> list[float]:
    """Log ratio (random to ordinary) of each pair of characters, row by row over ``ALPHABET``."""
    hexes = rf"[0-9a-f]{{{LEAST_HEX},}}"
    access = rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"
    text = F.col("text")
    values = F.filter(F.concat(F.regexp_extract_all(text, F.lit(ASSIGN), 2), F.regexp_extract_all(text, F.lit(access), 0),
                               F.regexp_extract_all(text, F.lit(hexes), 0)), lambda v: F.length(v) >= LEAST_ASSIGN)
    rest = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, access, hexes), text)
    words = F.regexp_extract_all(rest, F.lit(f"{_RUN}{{{LEAST_WORD},}}"), 0)
    labelled = F.concat(F.transform(values, lambda v: F.struct(F.lit(1).alias("random"), v.alias("word"))),
                        F.transform(words, lambda v: F.struct(F.lit(0).alias("random"), v.alias("word"))))
    rows = (docs.select(whole_text().alias("text")).select(F.explode(labelled).alias("label")).select("label.*")
            .where(F.length("word") > 1).select("random", F.explode(_pairs(F.col("word"))).alias("pair"))
            .groupBy("random", "pair").count().collect())
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[SMOOTHING] * n for _ in range(n)] for _ in range(2)]
    for r in rows:
        if all(c in place for c in r["pair"]):
            counts[r["random"]][place[r["pair"][0]]][place[r["pair"][1]]] += r["count"]
    return [math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a]))
            for a in range(n) for b in range(n)]


def log_ratio(word: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a run of at least one character."""
    table, n = F.array(*[F.lit(x) for x in ratios]), len(ALPHABET)
    # Split once: taking single characters by their place would walk from the start each time.
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(
            F.get(table, acc["last"] * n + c))).alias("sum")),
        lambda acc: acc["sum"])


def find(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """``(doc_id, base, spans)``: arrays of ``(start, kind number, end)`` by start, then kind."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("base", base_spans(text))
    likely = matches(text, f"{_RUN}{{{LEAST_RUN},}}", 3, lambda m: log_ratio(m, ratios) >= math.log(PRIOR_ODDS))
    added = F.filter(likely, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))
