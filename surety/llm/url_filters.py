"""URL rules, and trust propagated over the host graph where no rule applies.

A rule is ``host/path``: it fits its host and all subdomains if the path of the url starts with
the rule's path; the longest rule that fits decides. Pages without a rule are judged by their host.

Host graph: every link of a page is an edge from the page's host to the host it names (a relative
link stays on its own host), and a host and its parent domain are linked both ways. Edges are
counted per pair of hosts before anything is joined. Two personalised PageRanks run over it in one
job: trust starts at hosts with allowed pages and follows links; distrust starts at hosts with
blocked pages and follows links backwards, so what links to blocked hosts is distrusted. Both are
set against a walk that starts anywhere. A host is blocked if its distrust, relative to that walk,
reaches ``THRESHOLD`` and is above its relative trust.

All of it is DataFrame operations. The state is one row per host and direction; it is checkpointed
every few rounds. A host with very many pages is one row of the host table, and the join of pages
with hosts is one that adaptive execution can split.

Defined results: a NULL url, or one without ``://``, has empty host and path, no rule, and counts
as host ``''`` without links to others; NULL html has no links; repeated rows count as often as
they occur; hosts no seed reaches are allowed; of rules equally long the smaller string wins; an
empty table gives no rows; other columns of the input are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm.common import free_name
from surety.session import materialise

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DAMPING = 0.85
ROUNDS = 10
CHECKPOINT_ROUNDS = 5
THRESHOLD = 1.0
#: Pages of one host are dealt to so many tasks; the host's row is repeated for each.
SALTS = 16
#: Decimals kept of masses before they are compared, so that the order of sums has no effect.
DECIMALS = 9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_AUTHORITY = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links between hosts with their number, pre-aggregated."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)).alias("href"))
    target = F.translate(F.regexp_extract("href", _AUTHORITY, 1), _UPPER, _LOWER)
    return (links.select(F.col("host").alias("src"), F.when(target == "", F.col("host")).otherwise(target).alias("dst"))
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def _with_domains(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """Edges of all hosts, their parent domains, and a link of each host to itself."""
    chain = hosts.select(F.explode(_suffixes(F.col("host"))).alias("src")).where("src <> '' and src like '%.%'").distinct()
    up = chain.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst"), F.lit(1).cast("bigint").alias("n")).where("dst like '%.%'")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    stay = chain.union(hosts.select("host")).union(edges.select("dst")).distinct().select("src", F.col("src").alias("dst"), F.lit(1).cast("bigint").alias("n"))
    return edges.unionByName(up).unionByName(down).unionByName(stay).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)``, each relative to a walk without preferred starts.

    ``seeds`` has ``host, good, bad``: the weights of trusted and blocked starts. A direction
    without any start gives 0 everywhere.
    """
    both = edges.select(F.lit(0).alias("back"), "src", "dst", "n").unionByName(
        edges.select(F.lit(1).alias("back"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("back", "src").agg(F.sum("n").alias("total"))
    steps = materialise(both.join(out, ["back", "src"]).select("back", "src", "dst", (F.col("n") / F.col("total")).alias("w")))
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    weights = hosts.join(seeds, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("good", "bad")])
    sums = weights.agg(F.sum("good"), F.sum("bad"), F.count("*")).first()
    good, bad, n = (float(x or 0) for x in sums)
    start = materialise(weights.select("host", F.explode(F.array(
        F.struct(F.lit(0).alias("back"), (F.col("good") / F.lit(good or 1.0)).alias("seed")),
        F.struct(F.lit(1).alias("back"), (F.col("bad") / F.lit(bad or 1.0)).alias("seed")))).alias("s"))
        .select("s.back", "host", "s.seed", F.lit(1.0 / max(n, 1.0)).alias("even")))
    state = start.select("back", "host", F.col("seed").alias("mass"), F.col("even").alias("walk"))
    for number in range(1, rounds + 1):
        moved = (state.withColumnRenamed("host", "src").join(steps, ["back", "src"]).groupBy("back", F.col("dst").alias("host"))
                 .agg(F.sum(F.col("mass") * F.col("w")).alias("m"), F.sum(F.col("walk") * F.col("w")).alias("v")))
        state = start.join(moved, ["back", "host"], "left").select(
            "back", "host", *[(F.lit(1 - damping) * F.col(s) + F.lit(damping) * F.coalesce(m, F.lit(0.0))).alias(name)
                              for s, m, name in (("seed", "m", "mass"), ("even", "v", "walk"))])
        if number % CHECKPOINT_ROUNDS == 0 or number == rounds:
            state = materialise(state)
    relative = F.round(F.col("mass") / F.col("walk"), DECIMALS)
    return state.groupBy("host").agg(F.max(F.when(F.col("back") == 0, relative)).alias("trust"),
                                     F.max(F.when(F.col("back") == 1, relative)).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, trust, distrust`` added.

    ``pages`` has ``url`` and ``html``. Rules are matched against distinct hosts first, so any
    number of rules is one join on host names.
    """
    spark = pages.sparkSession
    names = {c: free_name(pages, f"_{c}") for c in ("host", "path", "rules", "trust", "distrust", "rule")}
    host, path = names["host"], names["path"]
    marked = pages.withColumns({host: host_of(F.col("url")), path: path_of(F.col("url"))})
    own = marked.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col("html").alias("html"))
    # One pass over the pages counts hosts and, below, their links.
    hosts = own.select("host").distinct()
    table = spark.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for r, v in rules],
                                  "on string, prefix string, rule string, verdict string")
    fits = (hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("on")).join(table, "on")
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "prefix", "verdict"))).alias("rules")))
    fits = materialise(hosts.join(fits, "host", "left"))

    def deciding(path: Column, rules: Column) -> Column:
        return F.get(F.filter(rules, lambda r: F.startswith(path, r["prefix"])), F.lit(0))

    counts = own.groupBy("host", "path").agg(F.count("*").alias("n")).join(fits, "host")
    verdict = deciding(F.col("path"), F.col("rules"))["verdict"]
    seeds = counts.groupBy("host").agg(F.sum(F.when(verdict == "allow", F.col("n"))).alias("good"),
                                       F.sum(F.when(verdict == "block", F.col("n"))).alias("bad"))
    edges = materialise(_with_domains(host_edges(own), fits.select("host")))
    ranks = propagate(edges, seeds)
    known = fits.join(ranks, "host", "left").select(
        F.col("host").alias(host), F.col("rules").alias(names["rules"]),
        F.coalesce("trust", F.lit(0.0)).alias(names["trust"]), F.coalesce("distrust", F.lit(0.0)).alias(names["distrust"]))
    rule = F.col(names["rule"])
    by_host = F.when((F.col(names["distrust"]) >= threshold) & (F.col(names["distrust"]) > F.col(names["trust"])), "block").otherwise("allow")
    salt = free_name(pages, "_salt")
    known = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = marked.withColumn(salt, F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int"))
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    return (marked.join(known, [host, salt])
            .withColumn(names["rule"], deciding(F.col(path), F.col(names["rules"])))
            .select(*rest, F.col(host).alias("host"), F.col(path).alias("path"), rule["rule"].alias("rule"),
                    F.coalesce(rule["verdict"], by_host).alias("verdict"),
                    F.col(names["trust"]).alias("trust"), F.col(names["distrust"]).alias("distrust")))
