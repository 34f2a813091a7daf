"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled into one transducer with three layers. The *normaliser* is a machine of
two or three states that puts the dummy prefix before a text, writes blanks as the blank sign and,
where the model says so, leaves out extra blanks. The *pieces* are arcs that read their characters
and write their id. *Byte fallback* arcs read a character that no piece has and write the ids of its
UTF-8 bytes.

Arcs have tropical weights. In a unigram model the weight of a piece is its score with the sign
turned, that of a character without a piece the worst score's and a penalty. In a merge (BPE) model
pieces weigh nothing, but not every way through them is an encoding: a state remembers the piece
that was written last, and an arc from it weighs zero if merging the two pieces' characters by rank
gives these two pieces again, else infinity. That test needs the right halves of the first piece
and the left halves of the second only: whichever of the pending merges comes first decides.

A text is composed with the transducer and the shortest path in the tropical semiring is found
position by position: of all arcs that reach a position the one of least total weight survives, of
equal ones that with the longest piece. One state for each position is enough: unigram arcs do not
look back, and in a merge model a prefix has one way of finite weight. Composition runs over many
strings at once: all substrings are looked up in the piece table by hash, then ends are relaxed
from left to right. As no piece holds a blank sign after another character and none holds a line
feed (other models are refused), words are composed once and remembered.

Decoding is the inverse: ids to characters, byte ids to bytes, blank signs to blanks, and the
dummy prefix taken off. It gives the text back, but for blank signs of the text itself, which
become blanks (the normaliser cannot tell them apart), and for extra blanks that the model leaves out.

Defined results: NULL and empty texts have no ids; a NULL ``doc_id`` is kept; repeated rows are
encoded alike; bytes that are not UTF-8 decode to replacement characters; an empty table gives no
rows. Models with a table of character replacements, with user-defined or unused pieces, or of other
kinds raise ``ValueError``. Weights are added in double precision word by word, so a unigram model's
near-ties, which the library decides in single precision, can come out otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import Numbers, whole_text

BLANK = "▁"
CACHE_WORDS = 600_000
#: Words that are composed together.
WORDS = 20_000
_FAR = np.int64(1) << 60
_BASE = np.uint64(0x9E3779B97F4A7C15)
# Piece and model kinds of the model format, and what a character without a piece costs.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGE = 1, 2
UNKNOWN_PENALTY = 10.0


def _hash_points(points: np.ndarray) -> int:
    h = 0
    for x in points.tolist():
        h = ((h + x + 1) * int(_BASE)) & (2 ** 64 - 1)
    return h


class Normaliser:
    """The first layer: an arc reads a blank or another character and leads to the next state."""

    START, INSIDE, HELD = range(3)

    def __init__(self, prefix: str, squeeze: bool) -> None:
        self.squeeze = squeeze
        # For each state: what is written for a blank, and before any other character; and then where to.
        if squeeze:
            self.arcs = {self.START: (("", self.START), (prefix, self.INSIDE)),
                         self.INSIDE: (("", self.HELD), ("", self.INSIDE)),
                         self.HELD: (("", self.HELD), (BLANK, self.INSIDE))}
        else:
            self.arcs = {self.START: ((prefix + BLANK, self.INSIDE), (prefix, self.INSIDE)),
                         self.INSIDE: ((BLANK, self.INSIDE), ("", self.INSIDE))}

    def run(self, text: str, state: int = START) -> str:
        """What the machine writes for a text; characters that are not blank are written as they are."""
        out = []
        for run in re.findall(" |[^ ]+", text):
            written, state = self.arcs[state][run != " "]
            out += [written, run] if run != " " else [written]
        return "".join(out).rstrip(BLANK) if self.squeeze else "".join(out)


class Transducer:
    """The compiled transducer of a SentencePiece merge or unigram model."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        trained = model.trainer_spec
        if (trained.model_type not in (UNIGRAM, MERGE) or n.precompiled_charsmap or not n.escape_whitespaces
                or trained.treat_whitespace_as_suffix):
            raise ValueError("the transducer takes merge and unigram models without a table of character replacements")
        if any(p.type in (USER, UNUSED) or p.type == NORMAL and ("\n" in p.piece or BLANK in p.piece.lstrip(BLANK)) for p in model.pieces):
            raise ValueError("a piece is user-defined, unused, or goes on behind a blank or line feed")
        self.merges = trained.model_type == MERGE
        self.prefix = BLANK if n.add_dummy_prefix else ""
        self.normaliser = Normaliser(self.prefix, n.remove_extra_whitespaces)
        self.surface = [p.piece for p in model.pieces]
        self.kind = np.array([p.type for p in model.pieces])
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type in (CONTROL, UNKNOWN)
                         else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.byte_id = {self.bytes_of[i]: i for i in np.flatnonzero(self.kind == BYTE).tolist()}
        if trained.byte_fallback and len(self.byte_id) != 256:
            raise ValueError("byte pieces are missing")
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        score = np.array([p.score for p in model.pieces])
        usable = np.flatnonzero(self.kind == NORMAL)
        self.id_of = {self.surface[i]: i for i in usable.tolist()}
        # Merge weights: the better the score, the earlier the merge; equal scores merge alike.
        self.weight = np.full(len(score), _FAR)
        _, self.weight[usable] = np.unique(-score[usable], return_inverse=True)
        self.alive = self.kind == NORMAL
        self.cost, self.unknown_cost = np.zeros(len(score)), 0.0
        if self.merges:
            self._compile_halves()
        else:
            self.cost[usable] = -score[usable]
            self.unknown_cost = UNKNOWN_PENALTY - float(score[usable].min())
        self._compile_arcs()
        self.forget()

    def _compile_halves(self) -> None:
        """The two halves that the last merge of each piece joins (-1: one character)."""
        size = len(self.surface)
        self.left, self.right, self.alive = np.full(size, -1), np.full(size, -1), np.zeros(size, bool)
        for text, i in self.id_of.items():
            parts = list(text)
            while len(parts) > 2:
                ids = [self.id_of.get(a + b) for a, b in zip(parts, parts[1:])]
                best = min(((int(self.weight[j]), k) for k, j in enumerate(ids) if j is not None), default=None)
                if best is None:
                    break
                k = best[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                self.alive[i] = True
            elif len(parts) == 2 and all(p in self.id_of for p in parts):
                self.alive[i] = True
                self.left[i], self.right[i] = (self.id_of[p] for p in parts)
        # The weight at which two neighbours merge, as a table sorted by the pair.
        keys, weights = [], []
        for text, i in self.id_of.items():
            for cut in range(1, len(text)):
                a, b = self.id_of.get(text[:cut]), self.id_of.get(text[cut:])
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    weights.append(int(self.weight[i]))
        order = np.argsort(keys)
        self.pair_key, self.pair_weight = np.array(keys, np.int64)[order], np.array(weights, np.int64)[order]

    def _compile_arcs(self) -> None:
        """Hashes of the pieces that a path can write, by length."""
        self.arcs: list[tuple[int, np.ndarray, np.ndarray]] = []
        by_length: dict[int, list[tuple[int, int]]] = {}
        for text, i in self.id_of.items():
            if self.alive[i]:
                by_length.setdefault(len(text), []).append((_hash_points(np.array([ord(c) for c in text])), i))
        for length in sorted(by_length):
            keys, ids = zip(*sorted(by_length[length]))
            self.arcs.append((length, np.array(keys, np.uint64), np.array(ids, np.int64)))

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of ``a`` and ``b`` gives the pieces ``a, b`` again.

        The merges inside both pieces are undone from the last one back. At every stage the parts
        that meet are looked up: if they merge before what joined them to the rest, the border
        does not survive. On equal weight the left one of two merges comes first.
        """
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), _FAR), np.full(len(a), _FAR)     # when x and y are merged on inside a and b
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        while len(open_):
            key = x[open_] * len(self.surface) + y[open_]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            w = np.where(self.pair_key[at] == key, self.pair_weight[at], _FAR)
            broken = (w < until_x[open_]) & (w <= until_y[open_]) & (w < _FAR)
            good[open_[broken]] = False
            open_ = open_[~broken]
            # Undo the later of the two last merges; on equal weight the right piece's came later.
            wx = np.where(self.left[x[open_]] >= 0, self.weight[x[open_]], -1)
            wy = np.where(self.left[y[open_]] >= 0, self.weight[y[open_]], -1)
            go_on = (wx >= 0) | (wy >= 0)
            open_, wx, wy = open_[go_on], wx[go_on], wy[go_on]
            in_y = wy >= wx
            ky, kx = open_[in_y], open_[~in_y]
            until_y[ky] = wy[in_y]
            y[ky] = self.left[y[ky]]
            until_x[kx] = wx[~in_y]
            x[kx] = self.right[x[kx]]
        return good

    def border(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Weight of writing ``piece`` behind ``before``; negative ids stand for no piece."""
        out = np.zeros(len(piece))
        ask = np.flatnonzero((before >= 0) & (piece >= 0)) if self.merges else ()
        if len(ask):
            size = len(self.surface)
            pair, back = np.unique(before[ask] * size + piece[ask], return_inverse=True)
            out[ask] = np.where(self.follows(pair // size, pair % size), 0.0, np.inf)[back]
        return out

    # --- composition -----------------------------------------------------------------------------

    def compose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings along their shortest paths, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        total = len(points)
        ends = np.cumsum(lengths)
        stop = np.repeat(ends, lengths)
        start = np.repeat(ends - lengths, lengths)
        position = np.arange(total)
        # Arcs of the composed machine: (from, to, piece), found one length at a time.
        heads, tails, pieces = [], [], []
        running = np.zeros(total, np.uint64)
        done = 0
        for length, keys, ids in self.arcs:
            while done < length and done < total:
                running[:total - done] = (running[:total - done] + points[done:] + np.uint64(1)) * _BASE
                done += 1
            at = np.flatnonzero(position + length <= stop)
            if not len(at):
                break
            found = np.minimum(np.searchsorted(keys, running[at]), len(keys) - 1)
            hit = keys[found] == running[at]
            heads.append(at[hit])
            tails.append(at[hit] + length)
            pieces.append(ids[found[hit]])
        head, tail, piece = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (heads, tails, pieces))
        known = np.zeros(total, bool)
        known[head[tail == head + 1]] = True
        lone = np.flatnonzero(~known)                       # characters without a piece: byte fallback
        head, tail = np.concatenate([head, lone]), np.concatenate([tail, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        # Relax ends from left to right, in all words at once.
        depth = tail - start[head]
        order = np.argsort(depth, kind="stable")
        head, tail, piece, depth = head[order], tail[order], piece[order], depth[order]
        borders = np.searchsorted(depth, np.arange(int(lengths.max(initial=0)) + 2))
        # Of the prefix that ends before a position: least weight, last piece, and where that began.
        least, last, came = np.full(total + 1, np.inf), np.full(total + 1, -1), np.zeros(total + 1, np.int64)
        for d in range(1, len(borders) - 1):
            a, b = borders[d], borders[d + 1]
            h, t, p = head[a:b], tail[a:b], piece[a:b]
            begins = h == start[h]
            weight = np.where(begins, 0.0, least[h]) + np.where(p < 0, self.unknown_cost, self.cost[p])
            open_ = np.flatnonzero(weight < np.inf)
            weight[open_] += self.border(np.where(begins[open_], -1, last[h[open_]]), p[open_])
            open_ = open_[weight[open_] < np.inf]
            # The least weight that reaches each position; of equal ones the earliest beginning.
            open_ = open_[np.lexsort((h[open_], weight[open_], t[open_]))]
            open_ = open_[np.append(True, np.diff(t[open_]) > 0)[:len(open_)]]
            at = t[open_]
            least[at], last[at], came[at] = weight[open_], p[open_], h[open_]
        # Read every path back from its end; negative values stand for characters without a piece.
        counts = np.zeros(len(words), np.int64)
        now, word = ends.copy(), np.flatnonzero(lengths)
        steps = []
        while len(word):
            at = now[word]
            value = last[at]
            now[word] = came[at]
            steps.append((word, np.where(value < 0, -1 - points[came[at]].astype(np.int64), value)))
            counts[word] += 1
            word = word[now[word] > (ends - lengths)[word]]
        final = np.cumsum(counts)
        flat = np.zeros(int(counts.sum()), np.int64)
        for k, (word, value) in enumerate(steps):
            flat[final[word] - 1 - k] = value
        return self._spell_bytes(flat, counts)

    def _spell_bytes(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the byte pieces of characters without a piece in their places."""
        at = np.flatnonzero(flat < 0)
        if not len(at):
            return flat, counts
        spelled = [self.fallback(chr(-1 - x)) for x in flat[at].tolist()]
        width = np.ones(len(flat), np.int64)
        width[at] = list(map(len, spelled))
        out = np.repeat(flat, width)
        first = np.cumsum(width) - width
        for k, ids in zip(first[at].tolist(), spelled):
            out[k:k + len(ids)] = ids
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)

    def fallback(self, character: str) -> list[int]:
        if not self.byte_id:
            return [self.unknown]
        return [self.byte_id[bytes([x])] for x in character.encode()]

    # --- whole texts ---------------------------------------------------------------------------

    def forget(self) -> None:
        self.known = Numbers()
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def _learn(self, chunks: list[str]) -> None:
        spelled = [self._spelled(c) for c in chunks]
        ids, counts = self.compose([s for group in spelled for s in group])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        groups = np.fromiter(map(len, spelled), np.int64, len(spelled))
        size = np.add.reduceat(counts, np.cumsum(groups) - groups)
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(ids)

    def _chunks(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses; a part that does not start with a line feed or
        blank sign has a blank sign before it."""
        if not text:
            return []
        if self.normaliser.squeeze or "  " in text or text[0] == " " or BLANK in text or not self.prefix:
            parts = re.findall(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n", self.normaliser.run(text))
            # Marked with a line feed in front where no blank sign is to be added.
            return ["\n\n" if p == "\n" else "\n\n" + p for p in parts]
        return text.replace("\n", " \n").split(" ")

    def _spelled(self, chunk: str) -> list[str]:
        """The strings to compose for a chunk."""
        if chunk[:2] == "\n\n":
            return [chunk[2:] or "\n"]
        if chunk[:1] == "\n":
            return ["\n", chunk[1:]]
        return [self.normaliser.run(" " + chunk, Normaliser.INSIDE)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        chunked = [self._chunks(t) for t in texts]
        counts = np.fromiter(map(len, chunked), np.int64, len(chunked))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunked)), np.int64, int(counts.sum()))
        for first in range(0, len(self.known.new), WORDS):
            self._learn(self.known.new[first:first + WORDS])
        self.known.new = []
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[which] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        borders = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            yield ids[a:b]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """The transducer of this Python worker, compiled once."""
    return Transducer(path)


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, round_trip)`` and, with ``keep_ids``, ``ids``.

    ``round_trip`` tells whether decoding the ids gives the text again (blank signs as blanks).
    """
    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1)
            for first in range(0, batch.num_rows, 500):
                part = texts.slice(first, 500).to_pylist()
                codes = list(machine.encode(part))
                columns = [docs_.slice(first, 500), pa.array([len(c) for c in codes], pa.int64()),
                           pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in codes], pa.int64()),
                           pa.array([machine.decode(c) == t.replace(BLANK, " ") for c, t in zip(codes, part)])]
                if keep_ids:
                    columns.append(pa.array([c.astype(np.int32) for c in codes], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"][:len(columns)])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; NULL ids give NULL text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = [None if ids is None else machine.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id bigint, text string")
