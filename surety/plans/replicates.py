"""Bootstrap weights: how often a replicate draws each row, as a function of keys alone.

Two laws. *Stratified* draws as many rows from every stratum as it has, so the weights of a
stratum add up to its size in every replicate. The rows of a stratum are numbered; the number of
draws that fall on each half of a range of numbers is a binomial draw keyed by that range, and so
on down to ranges of ``LEAF`` numbers, in which every draw picks its row by a hash. A task walks
only the ranges its own rows lie in, so no task sees a stratum and all tasks agree on its totals.
*Poisson* weights are independent of each other and of the size.

Keys are hashed with the SplitMix64 finaliser, so a retried task draws the same numbers, and so
does any other program that multiplies and shifts modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.plans.ranking import prefix_sums

GOLD = 0x9E3779B97F4A7C15
#: Tells the rows with label 0 of a group from those with label 1.
NEGATIVE = 0x5851F42D4C957F2D
#: Rows of a stratum that one range of direct draws holds.
LEAF = 1 << 14
#: Ranges whose halves are remembered.
HALVES = 256
#: Weights made at once.
DRAWS = 1 << 19
WORD = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (a public-domain mixing function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_in_place(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """:func:`mix` without new arrays."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor != 1:
            np.multiply(x, np.uint64(factor), out=x)
    return x


def steps(n: int, first: int = 1) -> np.ndarray:
    """``n`` multiples of the golden ratio modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.arange(first, first + n, dtype=np.uint64) * np.uint64(GOLD)


def seeded(key: int, seed: int) -> np.uint64:
    """The key of a stratum or row under a seed."""
    with np.errstate(over="ignore"):
        return mix(np.array([(key + seed * GOLD) & WORD], np.uint64))[0]


def text_key(*names: str) -> Column:
    """A 60-bit key of the given columns, the same in every SQL engine that has md5."""
    text = F.concat_ws(":", *[F.col(f"`{c}`").cast("string") for c in names])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


class Multinomial:
    """Draws with replacement of ``n`` out of ``n`` numbered rows, ``n_boot`` times."""

    def __init__(self, key: int, n: int, n_boot: int, seed: int) -> None:
        self.key, self.n, self.n_boot = seeded(key, seed), n, n_boot
        self.leaf: tuple[int, np.ndarray] | None = None
        #: Draws on the lower half of the ranges walked last, by their middle.
        self.halves: dict[int, np.ndarray] = {}

    def before(self, places: np.ndarray) -> np.ndarray:
        """How many draws of each replicate fall on rows before each of the sorted ``places``."""
        out = np.zeros((len(places), self.n_boot), np.int64)
        self._fill(0, self.n, np.zeros(self.n_boot, np.int64), np.full(self.n_boot, self.n), places, out)
        return out

    def weights(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Weights of the runs ``first .. first + size``."""
        if len(first) and (first[1:] == first[:-1] + size[:-1]).all():
            return np.diff(self.before(np.append(first, first[-1] + size[-1])), axis=0)
        places, at = np.unique(np.concatenate([first, first + size]), return_inverse=True)
        found = self.before(places)
        return found[at[len(first):]] - found[at[:len(first)]]

    def _fill(self, low: int, high: int, base: np.ndarray, draws: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
        """Counts before the ``places``, all of them within ``low .. high``, of ``draws`` in that range."""
        inside = slice(np.searchsorted(places, low, "right"), np.searchsorted(places, high, "left"))
        out[:inside.start] = base
        out[inside.stop:] = base + draws
        if inside.start >= inside.stop:
            return
        places, out = places[inside], out[inside]
        if high - low <= LEAF:
            out[:] = base + self._counts(low, high, draws)[:, places - low].T
            return
        middle = (low + high) // 2
        if middle not in self.halves:
            if len(self.halves) >= HALVES:
                self.halves.clear()
            rng = np.random.Generator(np.random.Philox(key=[int(self.key), middle]))
            self.halves[middle] = rng.binomial(draws, (middle - low) / (high - low))
        left = self.halves[middle]
        cut = np.searchsorted(places, middle, "left")
        self._fill(low, middle, base, left, places[:cut], out[:cut])
        self._fill(middle, high, base + left, draws - left, places[cut:], out[cut:])

    def _counts(self, low: int, high: int, draws: np.ndarray) -> np.ndarray:
        """Draws before every place of a leaf and after its end, a row per replicate.

        Replicates are drawn one by one, so that their numbers stay in the processor's cache.
        """
        if self.leaf is not None and self.leaf[0] == low:
            return self.leaf[1]
        size = high - low
        table = np.zeros((self.n_boot, size + 1), np.int32)
        with np.errstate(over="ignore"):
            start = mix(mix(np.array([self.key], np.uint64) ^ np.uint64(low)) + steps(self.n_boot))
            number = steps(int(draws.max(initial=0)))
            bits, spare = np.empty_like(number), np.empty_like(number)
            for row, first, m in zip(table, start, draws.tolist()):
                drawn = mix_in_place(np.add(number[:m], first, out=bits[:m]), spare[:m])
                np.right_shift(drawn, np.uint64(11), out=drawn)
                place = (drawn.astype(np.float64) * (2.0 ** -53 * size)).astype(np.int64)
                np.cumsum(np.bincount(place, minlength=size), out=row[1:])
        self.leaf = (low, table)
        return table


@lru_cache(maxsize=64)
def poisson_table(n: int) -> tuple[int, np.ndarray]:
    """Cumulative Poisson(n) probabilities and the count they begin at.

    Built outwards from the most likely count, as far as a double can tell from 0 and 1, so the
    table of a tie of any size has a length of its square root.
    """
    width = int(40 * np.sqrt(n) + 40)
    low, high = max(n - width, 0), n + width
    # log p(k) - log p(n), from the ratio of neighbours.
    up = np.cumsum(np.log(n / np.arange(n + 1, high + 1)))
    down = np.cumsum(np.log(np.arange(n, low, -1) / n))[::-1]
    weights = np.exp(np.concatenate([down, [0.0], up]))
    return low, np.cumsum(weights / weights.sum())


def poisson_weights(keys: np.ndarray, n: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """``len(keys) x n_boot`` Poisson(n) draws, a function of key, replicate and seed only."""
    keys = np.asarray(keys).astype(np.int64).view(np.uint64)
    n = np.asarray(n, dtype=np.int64)
    out = np.zeros((len(keys), n_boot))
    with np.errstate(over="ignore"):
        start = mix(keys + np.uint64(seed & 0xFFFFFFFF) * np.uint64(GOLD))
        for size in np.unique(n):
            rows = np.flatnonzero(n == size)
            if size <= 0:
                continue
            bits = mix(start[rows][:, None] + steps(n_boot)[None, :])
            u = (bits >> np.uint64(11)).astype(np.float64) * (2.0 ** -53)
            low, table = poisson_table(int(size))
            out[rows] = low + np.searchsorted(table, u.ravel(), side="right").reshape(u.shape)
    return out


def with_weights(rows: DataFrame, strata: Sequence[str], row: str, n_boot: int, seed: int = 0,
                 stratified: bool = True, name: str = "_w") -> DataFrame:
    """Add ``name``: one byte per replicate, how often it draws the row.

    Stratified weights number the rows of a stratum in the order of ``row``; Poisson weights follow
    ``row`` alone, so rows that share it share their weights. (A row is drawn more than 255
    times with a probability below 1e-500.)
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])
    columns = rows.columns

    def packed(batch: pa.RecordBatch, weights: np.ndarray) -> pa.RecordBatch:
        if weights.max(initial=0) > 255:
            raise OverflowError("a row was drawn more than 255 times")
        small = weights.astype(np.uint8)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array([r.tobytes() for r in small], pa.binary())], names=schema.names)

    def poisson(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, n_boot):
                yield packed(part, poisson_weights(part.column("_key").to_numpy(), np.ones(part.num_rows, np.int64), n_boot, seed))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, draws = None, None
        for batch in batches:
            for part in _parts(batch, n_boot):
                key, n, first = (part.column(c).to_numpy() for c in ("_key", "_one_total", "_one_before"))
                out = np.zeros((part.num_rows, n_boot), np.int64)
                edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
                    if at != int(key[a]):
                        at, draws = int(key[a]), Multinomial(int(key[a]), int(n[a]), n_boot, seed)
                    out[a:b] = draws.weights(first[a:b], np.ones(b - a, np.int64))
                yield packed(part, out)

    if not stratified:
        return rows.withColumn("_key", text_key(row)).mapInArrow(poisson, schema)
    numbered = prefix_sums(rows.withColumns({"_one": F.lit(1), "_key": text_key(*strata)}), list(strata), [row], ["_one"], costly=True)
    return numbered.sortWithinPartitions("_key", "_one_before").mapInArrow(drawn, schema)


def _parts(batch: pa.RecordBatch, n_boot: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose weights make up ``DRAWS`` numbers."""
    rows = max(DRAWS // max(n_boot, 1), 1)
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def weights_of(column: Iterable[bytes], n_boot: int) -> np.ndarray:
    """The weights of rows, rows by replicates."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, n_boot)
