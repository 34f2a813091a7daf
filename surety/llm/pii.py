"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

The base spans are fixed rules for e-mail addresses, IP addresses, card numbers and phone numbers.
They always stay. The field then labels every token of a text that holds a digit or an ``@`` with
one of these kinds or with none. Its potentials are the shape of the token, the label of the token
before it (chain), and the label of the latest earlier token that repeats it or looks like it (skip
edge: same digits, same last seven digits, same letters in any case, same local part). A token
outside the base spans also has a skip edge to the first token inside one that it repeats or looks
like, wherever that stands. Loopy sum-product message passing, carried on until messages settle,
lets a sure mention of an entity decide about a doubtful one elsewhere in the document. Tokens inside base spans are observed with their label. Other tokens whose belief
in a kind is above ``SURE`` become further spans of that kind.

Training is piecewise: the shape potentials are a softmax regression of the labels that the base
rules give, the edge potentials are log ratios of joint to independent label frequencies. It uses
the tokens of all documents; only counts of equal shapes and of label pairs are collected. Training
and labelling each read every whole text once, and only the counts move.

Defined results: NULL text is empty and has no spans; a NULL ``doc_id`` is kept; repeated rows are
treated alike; each skip edge of a key goes to one earlier token and one in a base span, so a text
of very many equal tokens has as many edges as any other of its length; an empty table gives no rows and learns nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import arrow_map, utf8_steps, whole_text

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
#: Largest change of a log message that counts as settled, and the round after which changes are halved.
SETTLED = 1e-6
CALM = 50
#: Tokens at most this many code points apart are neighbours on the chain.
NEAR = 64

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each ``@`` outwards, so long runs cost no more."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        end = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
            free = end.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` by kind and start, in code points."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


@dataclass
class Tokens:
    """The tokens of several texts that the field labels, and the edges between them."""

    text: np.ndarray        # number of the text
    start: np.ndarray       # first code point
    end: np.ndarray
    shape: np.ndarray       # one row of evidence per token
    given: np.ndarray       # label where a base span covers the token, else -1
    edges: np.ndarray       # (earlier, later, 0 chain, 1 skip or 2 skip to a base span)


#: Evidence of a token: constant, '@', '+' first, letters, three dots, parts up to 255, check digit
#: right, other signs, brackets; then one-hot number of digits, the last entry for more.
_DIGITS_UP_TO = 21
SHAPES = 9 + _DIGITS_UP_TO + 1
_EDGE = "\"'`.,;:!?|*&%#$<>[]{}"


def _shape(token: str) -> tuple[list[int], str]:
    digits = "".join(c for c in token if "0" <= c <= "9")
    parts = token.split(".")
    return [0, "@" in token, token[0] == "+", any(c.isalpha() for c in token), len(parts) == 4,
            len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts),
            len(digits) >= 12 and luhn(digits), "-" in token or "/" in token, "(" in token], digits


def tokens_of(texts: list[str], raw: np.ndarray, offsets: np.ndarray, spans: list[list[tuple[int, int, int]]]) -> Tokens:
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    solid = ~np.isin(raw, [9, 10, 11, 12, 13, 32])
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(first)
    telling = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    at = at[np.logical_or.reduceat(telling, at)] if len(at) else at
    point = np.cumsum((raw & 0xC0) != 0x80) - 1         # code points before each byte
    base = point[np.minimum(offsets[:-1], max(len(raw) - 1, 0))] if len(raw) else offsets[:-1]
    numbers, starts, ends, shapes, given, edges = [], [], [], [], [], []
    latest: dict = {}
    sure: dict = {}
    known: list[set] = []
    previous = (-1, 0)
    walked, waiting, near = -1, [], []
    for owner, begin in zip(text_of[at].tolist(), (point[at] - base[text_of[at]]).tolist()):
        text = texts[owner]
        stop = begin
        while stop < len(text) and text[stop] not in " \t\n\r\x0b\x0c":
            stop += 1
        while begin < stop and text[begin] in _EDGE:
            begin += 1
        while stop > begin and text[stop - 1] in _EDGE:
            stop -= 1
        if begin == stop:
            continue
        token = text[begin:stop]
        shape, digits = _shape(token)
        shape[0] = 1
        row = np.zeros(SHAPES)
        row[:9] = shape
        row[9 + min(len(digits), _DIGITS_UP_TO)] = 1
        if owner != walked:
            walked, waiting, near = owner, sorted(enumerate(spans[owner]), key=lambda x: -x[1][1]), []
        # Tokens and spans both ascend: a span comes near once and is left behind once.
        while waiting and waiting[-1][1][1] < stop:
            near.append(waiting.pop())
        near = [x for x in near if x[1][2] > begin]
        label, a, b = min(near)[1] if near else (-1, 0, 0)
        node = len(starts)
        if previous[0] == owner and begin - previous[1] <= NEAR:
            edges.append((node - 1, node, 0))
        previous = (owner, stop)
        keys = {("token", token.lower())}
        if len(digits) >= 7:
            keys |= {("digits", digits), ("tail", digits[-7:])}
        if label > 0 and begin < b <= stop:
            # A number written in parts is known as a whole by its last token.
            whole = "".join(c for c in text[a:b] if "0" <= c <= "9")
            keys |= {("digits", whole), ("tail", whole[-7:])} if len(whole) >= 7 else set()
        if "@" in token:
            keys.add(("local", token.split("@")[0].lower()))
        for mate in {latest[owner, k] for k in keys if (owner, k) in latest}:
            edges.append((mate, node, 1))
        for k in keys:
            latest[owner, k] = node
            if label >= 0:
                sure.setdefault((owner, k), node)
        known.append(keys)
        numbers.append(owner)
        starts.append(begin)
        ends.append(stop)
        shapes.append(row)
        given.append(label)
    linked = {(a, b) for a, b, kind in edges if kind == 1}
    for node, (owner, keys) in enumerate(zip(numbers, known)):
        for mate in {sure[owner, k] for k in keys if (owner, k) in sure} if given[node] < 0 else ():
            if (pair := (min(mate, node), max(mate, node))) not in linked:
                edges.append((*pair, 2))
    return Tokens(np.array(numbers, np.int64), np.array(starts, np.int64), np.array(ends, np.int64),
                  np.array(shapes).reshape(-1, SHAPES), np.array(given, np.int64), np.array(edges, np.int64).reshape(-1, 3))


@dataclass
class SkipChainField:
    """Log potentials: shape by label, and label by label for chain and skip edges. Label 0 is none."""

    shape: np.ndarray
    pairs: np.ndarray

    def beliefs(self, t: Tokens) -> np.ndarray:
        """Marginals of the labels of each token, by loopy message passing until messages settle.

        Each round sends only messages whose sender has changed. Tokens with a given label are
        observed and take no messages. Evidence can cross a whole text; where messages go on
        changing, changes are halved, and it ends after twice as many rounds as there are tokens.
        """
        own = t.shape @ self.shape
        seen = np.flatnonzero(t.given >= 0)
        own[seen] = -50.0
        own[seen, t.given[seen] + 1] = 0.0
        own -= own.max(1, keepdims=True)
        a, b, kind = t.edges.T
        kind = np.minimum(kind, 1)
        table = np.exp(np.concatenate([self.pairs, self.pairs.transpose(0, 2, 1)]))
        source, target, which = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([kind, kind + 2])
        back = np.roll(np.arange(len(source)), len(a))          # the message the other way
        open_ = t.given[target] < 0
        order = np.flatnonzero(open_)[np.argsort(source[open_], kind="stable")]
        first = np.searchsorted(source[order], np.arange(len(own) + 1))
        message = np.zeros((len(source), own.shape[1]))         # log messages source -> target
        total = own
        active = order
        for number in range(2 * len(own) + CALM):
            change = self._send(total[source[active]] - message[back[active]], table[which[active]]) - message[active]
            moved = np.abs(change).max(1, initial=0.0) > SETTLED
            active, change = active[moved], change[moved]
            if not len(active):
                break
            if number >= CALM:
                change *= 0.5
            message[active] += change
            np.add.at(total, target[active], change)
            nodes = np.unique(target[active])
            counts = first[nodes + 1] - first[nodes]
            following = order[np.repeat(first[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            active = np.unique(np.concatenate([following, active])) if number >= CALM else following
        p = np.exp(total - total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    @staticmethod
    def _send(weight: np.ndarray, potential: np.ndarray) -> np.ndarray:
        w = np.exp(weight - weight.max(1, keepdims=True))
        m = np.einsum("ei,eij->ej", w, potential)
        return np.log(m / m.sum(1, keepdims=True) + 1e-30)


def fit_field(shape: np.ndarray, label: np.ndarray, count: np.ndarray, joint: np.ndarray, steps: int = 300,
              rate: float = 0.1) -> SkipChainField:
    """Piecewise training on ``count`` tokens of each shape and ``label``: 0 (none) or a kind's number plus one.

    ``joint`` counts the label pairs of chain and of skip edges.
    """
    k = len(KINDS) + 1
    weights = np.zeros((SHAPES, k))
    hot = np.eye(k)[label]
    square = np.full((SHAPES, k), 1e-8)
    share = count[:, None] / max(count.sum(), 1)
    for _ in range(steps if len(label) else 0):
        s = shape @ weights
        p = np.exp(s - s.max(1, keepdims=True))
        slope = shape.T @ ((hot - p / p.sum(1, keepdims=True)) * share) - 1e-4 * weights
        square += slope ** 2
        weights += rate * slope / np.sqrt(square) * 3
    pairs = np.zeros((2, k, k))
    for kind in (0, 1):
        both = joint[kind] + 1.0
        both /= both.sum()
        pairs[kind] = np.log(both / np.outer(both.sum(1), both.sum(0)))
    return SkipChainField(weights, pairs)


def unobserved(t: Tokens) -> np.ndarray:
    """Tokens that repeat a token in a base span but are in none: the rules do not tell their label."""
    out = np.zeros(len(t.text), bool)
    a, b = t.edges[t.edges[:, 2] > 0, :2].T
    for one, other in ((a, b), (b, a)):
        out[one[(t.given[one] < 0) & (t.given[other] >= 0)]] = True
    return out


def train(docs: DataFrame) -> SkipChainField:
    """Fit the field on the tokens of all documents; only counts are collected.

    A counted key is a shape and its label, or the kind and the labels of an edge.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, counts = [], []
        for first, end, raw, offsets in utf8_steps(batch.column(0)):
            texts = batch.column(0).slice(first, end - first).to_pylist()
            t = tokens_of(texts, raw, offsets, [base_spans(x) for x in texts])
            label = t.given + 1
            known = ~unobserved(t)
            # Edges to base spans only serve labelling; the others are those of the text itself.
            edges = t.edges[(t.edges[:, 2] < 2) & known[t.edges[:, 0]] & known[t.edges[:, 1]]]
            for rows in (np.column_stack([t.shape[known], label[known]]), np.column_stack([edges[:, 2], label[edges[:, 0]], label[edges[:, 1]]])):
                if len(rows):
                    found, n = np.unique(rows.astype(np.int8), axis=0, return_counts=True)
                    keys += [r.tobytes() for r in found]
                    counts += n.tolist()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["key", "n"])

    rows = sorted(arrow_map(docs.select(whole_text().alias("text")), run, "key binary, n bigint")
                  .groupBy("key").agg(F.sum("n").alias("n")).collect())
    tokens = [(np.frombuffer(r[0], np.int8), r[1]) for r in rows if len(r[0]) > 3]
    table = np.array([x for x, _ in tokens], np.int64).reshape(-1, SHAPES + 1)
    joint = np.zeros((2, len(KINDS) + 1, len(KINDS) + 1))
    for key, n in rows:
        if len(key) == 3:
            joint[tuple(key)] += n
    return fit_field(table[:, :-1].astype(float), table[:, -1], np.array([n for _, n in tokens], float), joint)


def find(texts: list[str], raw: np.ndarray, offsets: np.ndarray, field: SkipChainField, sure: float = SURE):
    """``(base spans, all spans)`` of each text, each by kind and start."""
    base = [base_spans(t) for t in texts]
    t = tokens_of(texts, raw, offsets, base)
    more: list[list] = [[] for _ in texts]
    if len(t.text):
        belief = field.beliefs(t)
        belief[:, 0] = 0
        best: list[tuple] = []
        for i in np.flatnonzero((t.given < 0) & (belief.max(1) > 0.5)).tolist():
            kind, owner, p = int(belief[i].argmax()) - 1, int(t.text[i]), float(belief[i].max())
            last = best[-1] if best else None
            # A phone number may be written in parts; one sure part is enough for all of them.
            if last and last[:2] == (owner, kind) and KINDS[kind] == "phone" and texts[owner][last[3]:t.start[i]] == " ":
                best[-1] = (owner, kind, last[2], int(t.end[i]), max(p, last[4]))
            else:
                best.append((owner, kind, int(t.start[i]), int(t.end[i]), p))
        for owner, kind, a, b, p in best:
            if p > sure:
                more[owner].append((kind, a, b))
    return base, [sorted(b + m) if m else b for b, m in zip(base, more)]


def spans(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """``(doc_id, base, spans)``; both are arrays of ``(kind, start, end)``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        base, found = [], []
        for first, end, raw, offsets in utf8_steps(batch.column(1)):
            texts = batch.column(1).slice(first, end - first).to_pylist()
            for target, lists in zip((base, found), find(texts, raw, offsets, field)):
                target += [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans] for spans in lists]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(found, kind)],
                                          names=["doc_id", "base", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")), run,
                     "doc_id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, "
                     "spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` follows the text."""
    place = docs.columns.index("text")

    def clean(text: str, found: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for kind, a, b in sorted(found, key=lambda s: (s[1], s[2])):
            if a >= at:
                parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(place)
        out: list[str | None] = []
        for first, end, raw, offsets in utf8_steps(column.fill_null("")):
            texts = column.slice(first, end - first).to_pylist()
            _, found = find([t or "" for t in texts], raw, offsets, field)
            out += [t if not f else clean(t, f) for t, f in zip(texts, found)]
        return batch.set_column(place, batch.schema.names[place], pa.array(out, column.type))

    done = arrow_map(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                               .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done
