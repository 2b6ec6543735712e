"""Finds every periodic run of words: the maximal stretches that repeat a block four times or more.

Suffixes of a text are sorted by doubling, with the common prefix of each with the next. Kruskal's scheme then unites
suffix classes by decreasing common prefix: a union-find holds the classes, each with its positions in order. When two
classes meet at prefix length L, a position of the smaller one and its neighbour in the larger one have a common
prefix of exactly L words; if they are newly adjacent at a distance q with 3 q <= L, the words from the first of them on
repeat with smallest period q for q + L words. The first position of such a stretch gives the run, once.

A run has at least ``max(LEAST, TIMES * q)`` words, so prefixes below ``least_prefix`` never matter: a text in which no
window of so many words recurs (found by hash; a collision costs time only) has no run and is not sorted. Texts are
independent rows, so nothing is shuffled; a task holds some megabytes of texts at once, or one longer text with a rank a
word for each doubling.

Null texts have no words. Repeated rows each come back, null ids are allowed (``loop`` leaves them alone), only the id
and the text are read, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, text_bytes

LEAST, TIMES = 6, 4
BATCH = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def looped_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, their tail repeating one block if crc32 of the decimal id is divisible by 10."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def least_prefix(least: int, times: int) -> int:
    """What the first two blocks of any run have in common at least: with period 1, or with a longer one."""
    return min(max(least, times) - 1, 2 * (times - 1))


def recurring(words: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Texts in which some window of ``width`` words occurs twice, by hash."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    h = owner[: len(words) - width + 1].astype(np.uint64)
    for k in range(width):
        h = (h ^ words[k : len(words) - width + 1 + k].astype(np.uint64)) * _ODD
        h ^= h >> np.uint64(29)
    inside = owner[width - 1 :] == owner[: len(owner) - width + 1]
    h, own = h[inside], owner[: len(owner) - width + 1][inside]
    order = np.argsort(h)
    again = order[1:][h[order][1:] == h[order][:-1]]
    return np.unique(own[again])


def suffixes(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of texts laid end to end, and the common prefix of each suffix with the next one.

    A word is its pair of text and spelling, so prefixes that are equal lie in one text.
    """
    n = len(words)
    rank = np.unique(owner.astype(np.int64) << np.int64(32) | words, return_inverse=True)[1].astype(np.int32)
    ranks, span = [rank], 1
    while span < n and rank.max() + 1 < n:
        after = np.zeros(n, np.int64)
        after[:-span] = rank[span:] + 1
        rank = np.unique(rank.astype(np.int64) << np.int64(32) | after, return_inverse=True)[1].astype(np.int32)
        ranks.append(rank)
        span *= 2
    order = np.argsort(rank, kind="stable")
    x, y = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero((x < n) & (y < n))
        same = inside[ranks[k][x[inside]] == ranks[k][y[inside]]]
        lcp[same] += 1 << k
        x[same] += 1 << k
        y[same] += 1 << k
    return order, lcp


def kruskal_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of texts laid end to end, places counted over all of them."""
    if len(words) < 2:
        return []
    order, lcp = suffixes(words, owner)
    edges = np.flatnonzero(lcp >= least_prefix(least, times))
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    spelt, at = words.tolist(), order.tolist()
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    out = []

    def find(v: int) -> int:
        while (up := root.setdefault(v, v)) != v:
            root[v] = root[up]
            v = up
        return v

    def seed(p: int, q: int, common: int) -> None:
        first = p == 0 or owner[p - 1] != owner[p] or spelt[p - 1] != spelt[p - 1 + q]
        if first and q + common >= max(least, times * q):
            out.append((p, q + common, q))

    for t, common in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = find(t), find(t + 1)
        large = places.pop(a, None) or [at[t]]
        small = places.pop(b, None) or [at[t + 1]]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        reach = common // (times - 1)
        slots = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for j, (p, i) in enumerate(zip(small, slots)):
            # neighbours in the united class: nothing of either class lies between
            if i and p - large[i - 1] <= reach and (j == 0 or small[j - 1] < large[i - 1]):
                seed(large[i - 1], p - large[i - 1], common)
            if i < len(large) and large[i] - p <= reach and (j == last or small[j + 1] > large[i]):
                seed(p, large[i] - p, common)
        for p, i in zip(reversed(small), reversed(slots)):
            large.insert(i, p)
        root[b] = a
        places[a] = large
    return out


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    names: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in texts], np.int64)
    total = int(sizes.sum())
    words = np.fromiter((names[w] for text in texts for w in text), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), sizes)
    hot = recurring(words, owner, least_prefix(least, times))
    if not len(hot):
        return out
    kept = np.isin(owner, hot)
    words, owner = words[kept], owner[kept]
    begins = np.cumsum(sizes[hot]) - sizes[hot]
    for start, length, period in sorted(kruskal_runs(words, owner, least, times), key=lambda r: (r[0], r[2])):
        i = int(np.searchsorted(begins, start, "right")) - 1
        out[hot[i]].append((start - int(begins[i]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside all runs' repetitions, joined by blanks: each run keeps its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
    return b" ".join(words)


def find_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, times: int = TIMES, loop: bool = False
) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period by start, then period) and ``collapsed`` text of each row.

    ``loop`` first lets the tails of some texts repeat (``looped_words``).
    """
    if least < 2 or times < 3:
        raise ValueError("a run has at least two words, and three blocks or more")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in by_bytes(batches, "t", BATCH):
            texts = [t.split() for t in text_bytes(batch.column("t"))]  # of bytes: at ASCII white space only
            if loop:
                texts = [looped_words(i, w) for i, w in zip(batch.column("doc_id").to_pylist(), texts)]
            found = runs_of(texts, least, times)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
            kept = [collapse(w, own).decode() for w, own in zip(texts, found)]
            columns = [batch.column("doc_id"), pa.array(runs, kind), pa.array(kept, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: count of runs, the run of most periods, and digests of the runs and the collapsed text."""

    def most_periods(a, b):
        # lengths over periods, compared as products; then by start, then by period
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        later = (left < right) | ((left == right) & ((a["start"] > b["start"]) | ((a["start"] == b["start"]) & (a["period"] > b["period"]))))
        return F.when(later, 1).otherwise(-1)

    best = F.get(F.array_sort("runs", most_periods), F.lit(0))
    spelt = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(spelt, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
