"""Text expressions: structured answers, location claims, defect names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from surety.functions.columns import let

# The layout of a structured answer.
VERDICT = r"(?i)ANSWER:\s*\**\s*(YES|NO)"
OBSERVATION = r"(?is)OBSERVATION:\s*(.+?)(?=DEFECT_TYPE:|ANSWER:|\z)"
DEFECT_TYPE = r"(?is)DEFECT_TYPE:\s*(.+?)(?=DEFECT_LOCATION:|ANSWER:|\z)"
LOCATION = r"(?is)DEFECT_LOCATION:\s*(.+?)(?=CONFIDENCE:|ANSWER:|\z)"
CONFIDENCE = r"(?i)CONFIDENCE:\s*\**\s*(HIGH|MEDIUM|LOW)"

# Location words and the bands they name on the unit square.
LOW, MIDDLE, HIGH = (0.0, 0.42), (0.29, 0.71), (0.58, 1.0)
ROW_TERMS = {
    "top": LOW, "upper": LOW, "above": LOW, "head": LOW,
    "bottom": HIGH, "lower": HIGH, "below": HIGH, "base": HIGH,
    "middle": MIDDLE, "centre": MIDDLE, "center": MIDDLE, "central": MIDDLE,
}
COL_TERMS = {
    "left": LOW, "right": HIGH,
    "middle": MIDDLE, "centre": MIDDLE, "center": MIDDLE, "central": MIDDLE,
}
CORNER_TERMS = ("corner",)
EDGE_TERMS = ("edge", "border", "rim", "perimeter", "boundary", "side", "outer",
              "circumference")
SURFACE_TERMS = ("surface", "throughout", "overall", "entire", "whole", "all over",
                 "everywhere", "body", "face", "front")
NONE_TERMS = ("none", "n/a", "na", "not applicable", "no defect", "nowhere", "-", "")
LOCALISED = ("quadrant", "edge", "corner")

# Spellings of a defect that count as the same.
CANONICAL_DEFECT = {
    "": "none", "none": "none", "n/a": "none", "no defect": "none",
    "broken": "broken part", "break": "broken part", "broken part": "broken part",
    "crack": "crack", "cracked": "crack",
    "scratch": "scratch", "scratched": "scratch",
    "hole": "hole",
    "dent": "dent", "dented": "dent",
    "contamination": "contamination", "contaminated": "contamination",
    "deformation": "deformation", "deformed": "deformation",
    "discoloration": "discoloration", "discolouration": "discoloration",
}


WHITE = " \t\n\r\f\x0b"


def strip(c: Column, extra: str = "") -> Column:
    """Remove white space (and the characters in ``extra``) from both ends, in linear time."""
    return F.btrim(c, F.lit(WHITE + extra))


def clean_field(c: Column) -> Column:
    """A field value without markdown stars, with white space collapsed."""
    bare = strip(F.btrim(strip(c), F.lit("*")))
    return strip(F.regexp_replace(bare, r"\s+", " "))


def class_name(category: Column) -> Column:
    return F.translate(category, "_", " ")


def parse_vote(text: Column) -> Column:
    """1 for YES, 0 for NO, NULL when no verdict can be read.

    The labelled verdict counts first; otherwise the last non-blank line if it is a bare
    YES or NO.
    """
    labelled = F.upper(F.regexp_extract(text, VERDICT, 1))
    lines = F.rtrim(F.translate(text, "\r", "\n"), F.lit(WHITE))
    last = F.upper(strip(F.substring_index(lines, "\n", -1), "*."))
    verdict = F.when(labelled != "", labelled).otherwise(last)
    return F.when(verdict == "YES", 1).when(verdict == "NO", 0)


def parse_generation(text: Column) -> dict[str, Column]:
    """Columns of one parsed generation: vote, observation, defect_type, location, confidence."""
    return {
        "vote": parse_vote(text),
        "observation": clean_field(F.regexp_extract(text, OBSERVATION, 1)),
        "defect_type": clean_field(F.regexp_extract(text, DEFECT_TYPE, 1)),
        "location": clean_field(F.regexp_extract(text, LOCATION, 1)),
        "confidence": F.upper(F.regexp_extract(text, CONFIDENCE, 1)),
    }


def canonical_defect(defect: Column) -> Column:
    """Lower-case defect name with known spellings merged."""
    name = F.lower(strip(F.coalesce(defect, F.lit(""))))
    pairs = [F.lit(x) for kv in CANONICAL_DEFECT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def _any(text: Column, terms: Sequence[str]) -> Column:
    return text.rlike("|".join(terms))


def _band(text: Column, terms: dict[str, tuple[float, float]]) -> Column:
    """The band of the first term present, longer terms first; NULL without one."""
    out = None
    for term in sorted(terms, key=len, reverse=True):
        band = F.array(*[F.lit(x) for x in terms[term]])
        hit = text.rlike(rf"\b{term}\b")
        out = F.when(hit, band) if out is None else out.when(hit, band)
    return out


def location_claim(text: Column) -> Column:
    """Struct of a spatial claim: kind, row band, column band and whether it narrows anything."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\s/-]", " ")
    return let(strip(F.regexp_replace(low, r"\s+", " ")), _claim)


def _claim(low: Column) -> Column:
    bands = F.struct(_band(low, ROW_TERMS).alias("r"), _band(low, COL_TERMS).alias("c"))
    whole = F.array(F.lit(0.0), F.lit(1.0))
    corner = F.array(F.lit(LOW[0]), F.lit(LOW[1]))

    def kind(b: Column) -> Column:
        return (F.when(low.isin(*NONE_TERMS), "none").when(_any(low, CORNER_TERMS), "corner")
                .when(b["r"].isNotNull() | b["c"].isNotNull(), "quadrant")
                .when(_any(low, EDGE_TERMS), "edge").when(_any(low, SURFACE_TERMS), "surface")
                .otherwise("unparsed"))

    def limits(b: Column, k: Column) -> Column:
        default = F.when(k == "corner", corner).otherwise(whole)
        banded = k.isin("corner", "quadrant")
        r = F.when(banded, F.coalesce(b["r"], default)).otherwise(whole)
        c = F.when(banded, F.coalesce(b["c"], default)).otherwise(whole)
        return F.struct(k.alias("kind"), r[0].alias("r0"), r[1].alias("r1"), c[0].alias("c0"),
                        c[1].alias("c1"), k.isin(*LOCALISED).alias("is_localized"))

    return let(bands, lambda b: let(kind(b), lambda k: limits(b, k)))
