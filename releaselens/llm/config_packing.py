"""Packs documents into as few sequences as it can: a configuration linear program over the length histogram.

Only the histogram of piece lengths (as many rows as a sequence has places) reaches the driver, so the plan costs the same
at any size. The program covers the count of every class of lengths with configurations (multisets of classes that fit one
sequence); multiplicative weights price the classes, a knapsack dynamic program finds the best configuration at those
prices, until the fractional solution is within ``TOLERANCE`` of a bound that the prices prove. The solution is rounded to
whole sequences of real pieces. Only what rounding leaves is placed by best fit, also into the rooms of those sequences.

Pieces find their places by their rank among pieces of their length. Ranks come from running totals over ranges of
rows, so a length that a third of all pieces share is spread over as many tasks as its share; the plan's table of slots has a
bounded number of rows.

Null texts are empty: they hold the end id alone. Rows with equal or null ids are packed each. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes
from releaselens.llm.encoding import KEPT_UNITS, encoder, vocabulary
from releaselens.operators.ordering import running_totals
from releaselens.session import materialize

SIZE, STEPS, RATE, STEP, TURNS = 2048, 40_000, 8.0, 0.25, 20
#: Solution and bound of the program differ by at most this share; classes of lengths.
TOLERANCE, CLASSES = 0.01, 256


def pieces(
    docs: DataFrame, vocab: str, end_id: int, size: int = SIZE, text: str = "text", doc_id: str = "doc_id",
    kept: int = KEPT_UNITS,
) -> DataFrame:
    """Pieces of the encoded documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids`` (unsigned 32-bit).

    Each document ends with ``end_id``. One longer than ``size`` is cut so that only its first piece may be shorter.
    A worker's encoder holds ``kept`` units at most: fewer take less memory and more time.
    """
    path = vocabulary(vocab)
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, kept)
        for batch in by_bytes(batches, "text", 4 << 20):
            rows = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = code.encode(t) + end
                n = len(ids) // 4
                first = n % size or min(n, size)
                cuts = [0, *range(first, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, ids[4 * a : 4 * b]))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_config(prices: np.ndarray, size: int) -> dict[int, int]:
    """The multiset of lengths of the highest total price that fits ``size``, by dynamic programming."""
    lengths = np.flatnonzero(prices > 0)
    lengths = lengths[lengths <= size]
    worth, value, pick = prices[lengths], np.zeros(size + 1), np.zeros(size + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(size + 1), "right").tolist()
    for room in range(1, size + 1):
        k = upto[room]
        value[room] = value[room - 1]
        if k:
            gain = value[room - lengths[:k]] + worth[:k]
            best = gain.argmax()
            if gain[best] > value[room]:
                value[room], pick[room] = gain[best], lengths[best]
    out: dict[int, int] = {}
    room = size
    while room > 0:
        if pick[room]:
            out[int(pick[room])] = out.get(int(pick[room]), 0) + 1
            room -= int(pick[room])
        else:
            room -= 1
    return out


@dataclass
class Fractional:
    """A solution of the program: how often each configuration (length, pieces), a lower bound, and the prices that prove it.

    At ``prices`` (by length) no configuration is worth more than 1.
    """

    often: dict[tuple[tuple[int, int], ...], float]
    bound: float
    prices: np.ndarray

    @property
    def gap(self) -> float:
        return sum(self.often.values()) / self.bound - 1


def covering(counts: np.ndarray, size: int, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fractional:
    """The covering program by multiplicative weights: every length's count is covered, with the fewest sequences.

    A step adds the best configuration at the current prices, as often as raises the cover of no length by more than
    ``STEP`` of its count; prices fall by powers of the cover. The solution is the sum of the steps over the least cover; it
    starts anew with steps of half the size, at the prices reached, when all lengths are covered ``TURNS`` times.
    Prices at which no configuration is worth more than 1 bound the optimum from below; it ends when solution and bound
    are within ``tolerance``, or after ``steps``.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return Fractional({}, 0.0, np.zeros(len(counts)))
    need, place = counts[lengths].astype(np.float64), {int(l): i for i, l in enumerate(lengths)}
    cover, heat, mean, prices = *np.zeros((3, len(lengths))), np.zeros(len(counts))
    often: dict[tuple, float] = {}
    total, bound, size_of_step, found = 0.0, 0.0, STEP, None
    proof = np.zeros(len(lengths))

    def best(worth: np.ndarray) -> tuple[dict[int, int], float]:
        nonlocal bound, proof
        prices[lengths] = worth
        config = best_config(prices, size)
        value = sum(worth[place[l]] * a for l, a in config.items())
        if worth @ need > bound * value:
            bound, proof = float(worth @ need) / value, worth / value
        return config, value

    for step in range(1, steps + 1):
        worth = lengths / size * np.exp(heat.min() - heat)
        config, value = best(worth)
        mean += worth / value
        much = size_of_step * min(need[place[l]] / a for l, a in config.items())
        for l, a in config.items():
            cover[place[l]] += a * much / need[place[l]]
            heat[place[l]] += RATE * a * much / need[place[l]]
        key = tuple(sorted(config.items(), reverse=True))
        often[key] = often.get(key, 0.0) + much
        total += much
        least = float(cover.min())
        if least and (found is None or total / least < found[0]):
            found = (total / least, least, often) if least >= TURNS else found
            if total / least <= bound * (1 + tolerance):
                found = total / least, least, often
                break
        if least >= TURNS:
            best(mean)
            size_of_step, total, often, cover, mean = size_of_step / 2, 0.0, {}, *np.zeros((2, len(lengths)))
        elif step % 250 == 0:
            best(mean)
    if found is None:  # too few steps for a first solution: lengths that none reached stay uncovered
        found = total, float(cover.min() or cover[cover > 0].min()), often
    _, least, often = found
    prices[lengths] = proof
    return Fractional({k: n / least for k, n in often.items()}, bound, prices)


def rounded(
    solution: Fractional, counts: np.ndarray, tolerance: float = TOLERANCE
) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole sequences within the counts: whole parts first, then one more each while pieces last.

    Configurations of few, long pieces come first, those by falling fraction: best fit finds room for short ones more easily.
    An optimal solution uses only configurations of worth 1; those further below than ``tolerance`` are left out.
    """
    left, whole = counts.copy(), {}
    worth = {c: sum(float(solution.prices[l]) * a for l, a in c) for c in solution.often}
    good = [(c, n) for c, n in solution.often.items() if worth[c] >= 1 - tolerance]

    def take(config: tuple, n: int) -> None:
        n = min(n, *(int(left[l]) // a for l, a in config))
        if n > 0:
            whole[config] = whole.get(config, 0) + n
            for l, a in config:
                left[l] -= a * n

    for config, n in sorted(good, key=lambda x: (-worth[x[0]], x[0])):
        take(config, int(n))
    for config, n in sorted(good, key=lambda x: (sum(a for _, a in x[0]), int(x[1]) - x[1], x[0])):
        take(config, 1)
    return list(whole.items())


def of_lengths(plan: list[tuple[tuple, int]], counts: np.ndarray, unit: int) -> list[tuple[tuple, int]]:
    """Configurations of classes as configurations of lengths: each class gives its longest pieces first."""
    stock: dict[int, list[list[int]]] = {}
    for l in np.flatnonzero(counts):
        stock.setdefault(-(-int(l) // unit), []).append([int(l), int(counts[l])])
    out = []
    for config, n in plan:
        while n:
            # As many sequences as need no second length of a class, else one of mixed lengths.
            alike = min(n, *(stock[k][-1][1] // a for k, a in config))
            parts: dict[int, int] = {}
            for k, a in config:
                for _ in range(1 if alike else a):
                    length, each = stock[k][-1][0], a if alike else 1
                    parts[length] = parts.get(length, 0) + each
                    stock[k][-1][1] -= each * max(alike, 1)
                    if not stock[k][-1][1]:
                        stock[k].pop()
            out.append((tuple(parts.items()), max(alike, 1)))
            n -= max(alike, 1)
    return out


def best_fit(
    counts: np.ndarray, size: int, begun: Sequence[tuple[tuple, int]] = ()
) -> list[tuple[dict[int, int], int]]:
    """Best fit, largest first, on counts, also into the rooms of ``begun``; sequences of one pattern and room are one entry."""
    room: dict[int, list[tuple[tuple, int]]] = {}
    full: dict[tuple, int] = {}

    def put(pattern: tuple, space: int, n: int) -> None:
        if space:
            room.setdefault(space, []).append((pattern, n))
        else:
            full[pattern] = full.get(pattern, 0) + n

    for pattern, n in begun:
        put(pattern, size - sum(l * a for l, a in pattern), n)
    for l in range(min(size, len(counts) - 1), 0, -1):
        left = int(counts[l])
        for space in sorted(s for s in room if s >= l):
            while left and room.get(space):
                pattern, n = room[space].pop()
                each = min(space // l, -(-left // n))  # this many in each of these sequences
                used = min(n, left // each)
                if not used:
                    each, used = left, 1
                put(pattern + ((l, each),), space - each * l, used)
                if n > used:
                    room[space].append((pattern, n - used))
                left -= each * used
            if not room.get(space):
                room.pop(space, None)
            if not left:
                break
        each = size // l
        if left >= each:
            put(((l, each),), size - each * l, left // each)
        if left % each:
            put(((l, left % each),), size - left % each * l, 1)
    out = dict(full)
    for entries in room.values():
        for pattern, n in entries:
            out[pattern] = out.get(pattern, 0) + n
    return [({l: sum(a for x, a in p if x == l) for l, _ in p}, n) for p, n in out.items()]


def program(counts: np.ndarray, size: int, steps: int = STEPS) -> list[tuple[tuple, int]]:
    """Sequences by the configuration program, solved and rounded.

    Lengths of ``size`` / ``CLASSES`` tokens share a class and count as its longest, so the program has at most
    ``CLASSES`` rows.
    """
    unit = max(1, size // CLASSES)
    classes = np.zeros(-(-size // unit) + 1, np.int64)
    np.add.at(classes, -(-np.arange(len(counts)) // unit), counts)
    return of_lengths(rounded(covering(classes, size // unit, steps), classes), counts, unit)


def solve(counts: np.ndarray, size: int = SIZE, steps: int = STEPS) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each; every piece has a place. Best fit places what the program's rounding leaves."""
    whole = [({size: 1}, int(counts[size]))] if counts[size] else []
    left = counts.copy()
    left[size] = 0
    plan = program(left, size, steps)
    for config, n in plan:
        for l, a in config:
            left[l] -= a * n
    return whole + best_fit(left, size, plan)


@dataclass
class Slots:
    """For one length: the first rank of each entry, its first sequence, pieces a sequence and first offset."""

    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, Slots]:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for config, n in plan:
        offset = 0
        for l, each in sorted(config.items(), reverse=True):
            rows.setdefault(l, []).append((ranks.get(l, 0), first, each, offset))
            ranks[l] = ranks.get(l, 0) + n * each
            offset += l * each
        first += n
    return {l: Slots(*np.array(r, np.int64).T) for l, r in rows.items()}


def pack(table: DataFrame, size: int = SIZE, steps: int = STEPS) -> DataFrame:
    """Add ``ids_crc32``, ``sequence_id`` and ``offset`` to each piece; offsets of a sequence are gapless from 0.

    The pieces with their ids are written once; ranks move narrow rows only. ``sequences`` joins the ids again.
    """
    table = materialize(table.withColumn("row", F.monotonically_increasing_id()))
    narrow = table.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "row")
    order = [F.col("doc_id").asc_nulls_first(), "piece", "row"]
    ranked = materialize(running_totals(narrow, order, by=["length"], before="rank"))
    counts = np.zeros(size + 1, np.int64)
    for r in ranked.groupBy("length").count().collect():  # one row for each length up to ``size``
        counts[r["length"]] = r["count"]
    places = slots(solve(counts, size, steps))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for l in np.unique(length).tolist():
                at, s = np.flatnonzero(length == l), places[l]
                k = np.searchsorted(s.rank, rank[at], "right") - 1
                inside = rank[at] - s.rank[k]
                sequence[at] = s.sequence[k] + inside // s.each[k]
                offset[at] = s.offset[k] + inside % s.each[k] * l
            own = [batch.column(c) for c in names]
            yield pa.record_batch([*own, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(run, kinds)


def sequences(packed: DataFrame, table: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: whole sequences, from ``pack`` and the pieces with the same ``row`` column."""
    met = packed.join(table.select("row", "ids"), "row")
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = met.groupBy("sequence_id").agg(inside.alias("p"))  # at most one sequence of ids in a group
    return whole.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
