"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad. Its evidence is what the line and the lines next to
it look like: shares of capitals, digits, symbols, bars and exclamation marks, words that repeat
the word before, lines that repeat, lengths. Neighbouring labels are tied by learned transition
weights. Forward-backward gives the probability that each line is good, and the document's score
is their mean weighted by line length.

The model learns from documents with a known label, whose lines all carry the label of the
document. It is fitted in the driver on at most ``TRAIN_DOCUMENTS`` labelled documents, chosen by
a hash of their ids; only their line features leave the executors. Scoring reads each text once
and moves no rows.

Defined results: NULL, empty and blank texts have no line, and their score is the share of good
documents in the sample; rows with NULL ``doc_id`` are scored and never learned from; a document
with several labels has the smallest one; repeated rows are scored alike; without any label every
score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm.common import arrow_map, free_name, schema_with, utf8_steps, whole_text

TRAIN_DOCUMENTS = 4000
STEPS = 200
RATE = 0.08
L2 = 1e-3
THRESHOLD = 0.3

_BYTE = np.arange(256)
_CLASSES = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90), "lower": (_BYTE >= 97) & (_BYTE <= 122), "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "symbol": np.isin(_BYTE, list(b"#$%&*@^~+=_`")), "frame": np.isin(_BYTE, list(b"|<>{}[]\\/")),
    "shout": np.isin(_BYTE, list(b"!?")), "stop": np.isin(_BYTE, list(b".,;:'\"()-")), "other": _BYTE >= 128,
    "blank": np.isin(_BYTE, [9, 11, 12, 13, 32]),
}
_BLANK = _CLASSES["blank"] | (_BYTE == 10)
_MIX = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
OWN_FEATURES = len(_CLASSES) + 6


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-blank lines of several texts, their byte lengths, and lines per text."""
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    if not len(raw):
        return np.zeros((0, 3 * OWN_FEATURES + 1)), np.zeros(0), np.zeros(n, np.int64)
    opens = np.zeros(len(raw), bool)
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    opens[1:] |= raw[:-1] == 10
    starts = np.flatnonzero(opens)
    solid = ~_BLANK[raw]
    full = np.add.reduceat(solid.astype(np.int64), starts)
    size = np.diff(np.append(starts, len(raw)))
    counts = [np.add.reduceat(member[raw].astype(np.int32), starts) for member in _CLASSES.values()]
    # Words, and whether each equals the one before it in its line.
    first = solid.copy()
    first[1:] &= ~solid[:-1] | opens[1:]
    at = np.flatnonzero(first)
    word = np.zeros(len(at), np.uint64)
    line_of_word = np.zeros(len(at), np.int64)
    if len(at):
        begin = np.zeros(len(raw), np.int64)
        begin[at] = at
        place = np.arange(len(raw)) - np.maximum.accumulate(begin)
        value = (raw.astype(np.uint64) + np.uint64(1)) * _MIX[place & 63]
        value[~solid] = 0
        word = np.add.reduceat(value, at)
        line_of_word = np.searchsorted(starts, at, "right") - 1
    again = np.zeros(len(at))
    again[1:] = (word[1:] == word[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    words = np.bincount(line_of_word, minlength=len(starts))
    repeats = np.bincount(line_of_word, weights=again, minlength=len(starts))
    content = np.zeros(len(starts), np.uint64)
    np.add.at(content, line_of_word, word * (np.arange(len(at)).astype(np.uint64) - np.repeat(
        np.cumsum(words) - words, words).astype(np.uint64) + np.uint64(7)))
    keep = full > 0
    owner = text_of[starts]
    starts, size, full, words, repeats, content, owner = (
        x[keep] for x in (starts, size, full, words, repeats, content, owner))
    _, which, often = np.unique(content ^ (owner.astype(np.uint64) << np.uint64(40)), return_inverse=True, return_counts=True)
    shares = [np.sqrt(c[keep] / size) for c in counts]
    letters = np.maximum(counts[0][keep] + counts[1][keep], 1)
    own = np.stack([*shares, counts[0][keep] / letters, repeats / np.maximum(words, 1), (often[which] > 1).astype(float),
                    np.log1p(size) / 5, full / np.maximum(words, 1) / 10, np.log1p(words) / 4], axis=1)
    lines = np.bincount(owner, minlength=n)
    same = np.zeros(len(owner), bool)
    same[1:] = owner[1:] == owner[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same[1:]] = own[:-1][same[1:]]
    after[:-1][same[1:]] = own[1:][same[1:]]
    return np.hstack([own, before, after, np.ones((len(own), 1))]), full.astype(float), lines


@dataclass
class LineField:
    """Weights of the evidence for ``good``, transition weights, and the share of good documents."""

    weights: np.ndarray
    transitions: np.ndarray
    prior: float

    def unary(self, features: np.ndarray) -> np.ndarray:
        """Potentials of (bad, good) for each line."""
        s = np.clip(features @ self.weights, -30, 30) / 2
        return np.exp(np.stack([-s, s], axis=1))

    def passes(self, features: np.ndarray, lines: np.ndarray):
        """Forward and backward messages, each scaled to sum to one, of all texts side by side."""
        u, t = self.unary(features), np.exp(self.transitions)
        order = np.argsort(-lines, kind="stable")
        start, size = (np.cumsum(lines) - lines)[order], lines[order]
        deep = int(size[0]) if len(size) else 0
        active = [int(np.searchsorted(-size, -k, "left")) for k in range(deep)]
        ahead, back = np.ones_like(u), np.ones_like(u)
        for k in range(deep):
            at = start[:active[k]] + k
            a = u[at] * (ahead[at - 1] @ t if k else 1.0)
            ahead[at] = a / a.sum(1, keepdims=True)
        for k in range(deep - 1, 0, -1):
            at = start[:active[k]] + k
            b = (u[at] * back[at]) @ t.T
            back[at - 1] = b / b.sum(1, keepdims=True)
        return u, t, ahead, back

    def good(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Probability that each line is good."""
        _, _, ahead, back = self.passes(features, lines)
        m = ahead * back
        return m[:, 1] / np.maximum(m.sum(1), 1e-300)

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Quality of each text: the mean of its lines' probabilities, weighted by length."""
        features, weight, lines = line_features(raw, offsets)
        owner = np.repeat(np.arange(len(lines)), lines)
        total = np.bincount(owner, weights=weight, minlength=len(lines))
        share = np.bincount(owner, weights=weight * self.good(features, lines), minlength=len(lines))
        return np.where(total > 0, np.clip(share / np.maximum(total, 1e-300), 0.0, 1.0), self.prior)


def fit_field(features: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = STEPS,
              rate: float = RATE, l2: float = L2) -> LineField:
    """Maximum likelihood of the label chains by Adam; every document counts once."""
    width = 3 * OWN_FEATURES + 1
    if not len(labels):
        return LineField(np.zeros(width), np.zeros((2, 2)), 0.5)
    field = LineField(np.zeros(width), np.zeros((2, 2)), float(labels.mean()))
    # Standardised evidence lets one rate suit all weights; the scaling is folded in at the end.
    middle, spread = features.mean(0), features.std(0)
    middle[-1], spread[-1] = 0.0, 1.0
    spread[spread < 1e-9] = 1.0
    features = (features - middle) / spread
    owner = np.repeat(np.arange(len(lines)), lines)
    y, per_line = labels[owner], 1.0 / np.maximum(lines[owner], 1) / len(labels)
    inner = np.zeros(len(owner), bool)
    inner[1:] = owner[1:] == owner[:-1]
    pair = np.flatnonzero(inner)
    moments = [np.zeros(width + 4), np.zeros(width + 4)]
    for step in range(1, steps + 1):
        u, t, ahead, back = field.passes(features, lines)
        m = ahead * back
        m /= m.sum(1, keepdims=True)
        slope = features.T @ ((y - m[:, 1]) * per_line) - l2 * field.weights
        joint = ahead[pair - 1, :, None] * t[None] * (u[pair] * back[pair])[:, None, :]
        joint *= (per_line[pair] / joint.sum((1, 2)))[:, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[pair], y[pair]), per_line[pair])
        slope = np.concatenate([slope, (seen - joint.sum(0) - l2 * field.transitions).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope ** 2
        move = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8)
        field.weights = field.weights + move[:width]
        field.transitions = field.transitions + move[width:].reshape(2, 2)
    weights = field.weights / spread
    weights[-1] -= float(middle @ weights)
    return LineField(weights, field.transitions, field.prior)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> LineField:
    """Fit the field on at most ``most`` labelled documents that are not held out."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cells, lines = [], []
        for _, _, raw, offsets in utf8_steps(batch.column(2)):
            features, _, count = line_features(raw, offsets)
            cells += [x.astype(np.float32).tobytes() for x in np.split(features, np.cumsum(count)[:-1])]
            lines.append(count)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ys), pa.array(np.concatenate(lines)), pa.array(cells, pa.binary())],
                                          names=["doc_id", "y", "lines", "features"])

    # The labelled sample is bounded by its parameter, so it can be sent to every task.
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).join(
        F.broadcast(known), "doc_id").select("doc_id", "y", "text")
    rows = arrow_map(sample, run, "doc_id bigint, y int, lines bigint, features binary")
    rows = sorted(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most).collect())
    lines = np.array([r["lines"] for r in rows], np.int64)
    features = np.frombuffer(b"".join(r["features"] for r in rows), np.float32).reshape(-1, 3 * OWN_FEATURES + 1)
    return fit_field(features.astype(float), lines, np.array([r["y"] for r in rows], np.int64))


def score_documents(docs: DataFrame, field: LineField, out: str = "score") -> DataFrame:
    """``docs`` with the score added as the last column."""
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place).fill_null("")
        scores = [field.scores(raw, offsets) for _, _, raw, offsets in utf8_steps(texts)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, out])

    return arrow_map(docs, run, schema_with(docs, out, "double"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns of ``docs``."""
    out = free_name(docs, "_score")
    scored = score_documents(docs, train(docs, labels), out)
    return scored.where(F.col(out) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
