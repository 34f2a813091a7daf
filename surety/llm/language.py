"""Language of a text by rank-order profiles.

The profile of a language is the list of its ``PROFILE`` most frequent n-grams, most frequent
first; so is the profile of a document. Their distance is the sum, over the document's n-grams, of
how far each is out of place in the language's list; an n-gram that is not there counts
``PROFILE``. The language with the least distance is predicted.

N-grams have one to ``LONGEST`` characters and lie inside one word with one blank on either side.
Words are runs of letters and marks, lower-cased. Three code points of 21 bits are one 64-bit key,
so keys are exact and their order is that of the n-grams as strings; equally frequent n-grams stand
in that order, in both kinds of profile.

Counts of the languages cover all rows they are learned from. They are added up per slice of rows
before the shuffle, so a language with most of the rows is no hot key, and only the leading
n-grams of each language reach the driver.

Defined results: a text that is NULL or has no letter is ``UNKNOWN`` with score 0, and so is every
text if no language was learned; of languages at the same distance the smallest name is taken;
rows with a NULL language or a NULL ``doc_id`` teach nothing; an empty table gives no rows. Added
columns get underscores where their names are taken.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surety.llm.common import arrow_map, free_name, schema_with

LONGEST = 3
PROFILE = 300
UNKNOWN = "und"
#: More distinct languages than this are taken for a mistake; the profiles of so many are 30 MB.
MOST_LANGUAGES = 2000
#: Characters that are counted in one go.
PIECE = 1 << 18
BITS = np.uint64(21)
BLANK = np.uint64(32)


@cache
def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-cased form if it belongs to words and else 0; whether it is a letter."""
    folded, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        if kind in "LM":
            low = char.lower()
            folded[code] = ord(low) if len(low) == 1 else code
            letter[code] = kind == "L"
    return folded, letter


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all n-grams of a text given by its code points, and how often each occurs."""
    chars = alphabet()[0][codes].astype(np.uint64)
    word = chars > 0
    kept = word.copy()
    kept[1:] |= word[:-1]
    chars[~word] = BLANK
    chars = np.concatenate([[BLANK], chars[kept], [BLANK] * LONGEST]).astype(np.uint64)
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start in range(0, len(chars) - 2, PIECE):
        part = chars[start:start + PIECE + 2]
        a, b, c = part[:-2], part[1:-1], part[2:]
        one, two = a << BITS << BITS, (a << BITS << BITS) | (b << BITS)
        found = np.concatenate([one[a != BLANK], two[(a != BLANK) | (b != BLANK)], (two | c)[b != BLANK]])
        for store, values in zip((keys, counts), np.unique(found, return_counts=True)):
            store.append(values)
    return added_up(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 2 else (keys[-1], counts[-1])


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def leading(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, most frequent first; of equal counts the smaller key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Languages in order of their names, and the rank of every n-gram in each of them."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked: dict[str, list[int]], size: int) -> Profiles:
        """From each language's keys, most frequent first."""
        languages = sorted(ranked)
        keys = np.unique(np.array([k for x in ranked.values() for k in x], np.uint64))
        ranks = np.full((len(keys) + 1, len(languages)), -1, np.int32)
        for column, name in enumerate(languages):
            at = np.searchsorted(keys, np.array(ranked[name], np.uint64))
            ranks[at, column] = np.arange(len(at))
        return cls(languages, keys, ranks, size)

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's profile to each language."""
        at = np.minimum(np.searchsorted(self.keys, profile), len(self.keys) - 1)
        ranks = self.ranks[np.where(self.keys[at] == profile, at, len(self.keys))]
        apart = np.abs(ranks - np.arange(len(profile))[:, None])
        return np.where(ranks < 0, self.size, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and one minus its share of the largest possible distance."""
        codes = code_points(text or "")
        if not self.languages or not alphabet()[1][codes].any():
            return UNKNOWN, 0.0
        profile = leading(*gram_counts(codes), self.size)
        apart = self.distances(profile)
        best = int(np.argmin(apart))
        return self.languages[best], 1.0 - int(apart[best]) / (len(profile) * self.size)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of all languages of ``docs(doc_id, text, lang)`` that are not held out."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts: dict[str, list[str]] = {}
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(name, []).append(text or "")
        names = sorted(texts)
        # No n-gram reaches beyond a blank, so texts of one language are counted as one.
        found = [gram_counts(code_points(" ".join(texts[name]))) for name in names]
        owner = np.repeat(np.arange(len(names)), [len(keys) for keys, _ in found])
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(owner)), pa.array(np.concatenate([k for k, _ in found]).view(np.int64)),
             pa.array(np.concatenate([n for _, n in found]), pa.int64())], names=["lang", "gram", "n"])

    counts = arrow_map(taught.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")),
                       run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark keeps the first ``size`` rows of a language in every partition before it shuffles them.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place")
    rows = top.limit(MOST_LANGUAGES * size + 1).collect()
    ranked: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, at in rows:
        ranked.setdefault(lang, []).append((at, gram))
    if len(rows) > MOST_LANGUAGES * size or len(ranked) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is this a column of labels?")
    return Profiles.of({lang: [gram for _, gram in sorted(grams)] for lang, grams in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, read off the column ``text`` alone."""
    text = docs.columns.index("text")
    names = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    schema = schema_with(docs, names[0], "string").add(names[1], "double")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [profiles.predict(t) for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            names=[*batch.schema.names, *names])

    return arrow_map(docs, run, schema)
