"""Removes every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else in the table.

Whole texts are cut into runs of window starts that share the least hash of a 32-byte gram in the window: equal windows
have equal keys, so they meet under one key, and each window start belongs to one run. Runs with equal bytes are settled by
counting (key, digest of the bytes): what thousands of copies share is one row a task before it moves. Only keys with
several different contexts, or with a gram that recurs inside one, go to a suffix array, one representative of each.

Suffix arrays are built by two-stage sorting over bounded batches of contexts: suffixes smaller than their successors
are sorted directly, bucket by bucket; the others follow from scanning the buckets in ascending order; adjacent common
prefixes of ``LENGTH`` or more mark repeated windows. A key with more than ``HOT`` contexts is not gathered: its
windows meet by their own digests, which gives the same result.

Texts are compared as UTF-8 bytes and never across documents. Null texts are empty. Equal rows are copies of each other, so
all of their bytes go if there are ``LENGTH`` of them. Null ids are allowed. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, text_bytes
from releaselens.session import materialize

LENGTH, GRAM, HOT = 400, 32, 8192
#: Bytes of texts hashed at once, and of contexts sorted at once.
BATCH, SORTED = 1 << 20, 1 << 19
END = 0xFF  # never a byte of UTF-8

_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on, of doubling parts."""
    h, span = _TABLE[data], 1
    for odd in _ODD:
        h = h[:-span] * odd + h[span:]
        h ^= h >> np.uint64(31)
        span *= 2
    h *= _ODD[0]
    return h ^ (h >> np.uint64(29))


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of so many places."""
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - span : width - span + len(h) - width + 1])


def runs_of(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(text, key, digest, first start, starts, whether the key's gram recurs) of each run of window starts."""
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return
    data = b"".join([texts[i] for i in long])
    sizes = np.array([len(texts[i]) for i in long])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = gram_hashes(np.frombuffer(data, np.uint8))
    width = length - GRAM + 1
    least = least_in(h, width)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(long)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    keys = least[starts]
    cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]))
    n_of = np.diff(np.concatenate([cut, [len(keys)]]))
    signed = keys[cut].view("<i8").tolist()
    first, who = starts[cut], owner[cut]
    for at, n, key, raw, text in zip(first.tolist(), n_of.tolist(), signed, keys[cut], who.tolist()):
        digest = hashlib.blake2b(data[at : at + n - 1 + length], digest_size=8).digest()
        recurs = np.count_nonzero(h[at : at + n - 1 + width] == raw) > 1
        yield long[text], key, int.from_bytes(digest, "little", signed=True), at - int(begins[text]), n, recurs


def suffix_array(data: bytes, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes at least, by two-stage sorting."""
    t = np.frombuffer(data, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    # smaller: the suffix is less than its successor; in a run of equal bytes that is decided where the run ends
    last = np.concatenate([t[1:] != t[:-1], [True]])
    ends = np.flatnonzero(last)
    run = np.searchsorted(ends, np.arange(n))
    smaller_at_end = np.concatenate([t[ends[:-1]] < t[ends[:-1] + 1], [False]])
    direct = np.flatnonzero(smaller_at_end[run])
    # first stage: sort these directly, one bucket of two leading bytes after the other
    lead = t[direct].astype(np.uint16) << 8 | t[np.minimum(direct + 1, n - 1)]
    order = np.argsort(lead, kind="stable")
    direct, lead = direct[order], lead[order]
    spelt = data.decode("latin-1")
    edges = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1], [True]])) if len(direct) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            direct[a:b] = sorted(direct[a:b].tolist(), key=lambda p: spelt[p : p + depth])
    heads = np.searchsorted(t[direct], np.arange(257))
    # second stage: scan the buckets upwards; what stands before a scanned suffix and is larger follows in its bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = waiting[c]
        step = np.concatenate(found) if found else np.zeros(0, np.int64)
        parts = [step]
        while len(step):
            step = step[step > 0] - 1
            step = step[t[step] == c]
            parts.append(step)
        bucket = np.concatenate([*parts, direct[heads[c] : heads[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        letters = t[before]
        before, letters = before[letters > c], letters[letters > c]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]])) if len(letters) else []
        for part, letter in zip(np.split(before, cuts[1:]) if len(letters) else [], letters[cuts] if len(letters) else []):
            waiting[letter].append(part)
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``depth``."""
    t = np.frombuffer(data + bytes(depth + 8), np.uint8)
    words = np.zeros(len(t) - 7, np.uint64)
    for k in range(8):
        words |= t[k : len(t) - 7 + k].astype(np.uint64) << np.uint64(8 * (7 - k))
    lcp = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(alive):
            break
        both = words[order[alive] + at] ^ words[order[alive - 1] + at]
        same = both == 0
        differ = alive[~same]
        # leading equal bytes of the first words that differ
        rest = both[~same]
        high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
        used = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        lcp[differ] = at + (64 - used) // 8
        alive = alive[same]
    lcp[alive] = depth
    return np.minimum(lcp, depth)


def repeated_windows(contexts: list[bytes], starts: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context, ranges (first, last) of its first ``starts`` window starts that occur elsewhere in the list."""
    end = bytes([END])
    data = end.join(contexts) + end
    sizes = np.array([len(c) + 1 for c in contexts])
    begins = np.cumsum(sizes) - sizes
    wanted = np.zeros(len(data), bool)
    for b, n in zip(begins.tolist(), starts):
        wanted[b : b + n] = True
    order = suffix_array(data, length)
    order = order[wanted[order]]
    again = np.flatnonzero(common_prefixes(data, order, length) >= length)
    marked = np.zeros(len(data) + 1, bool)
    marked[order[again]] = True
    marked[order[again - 1]] = True
    marked &= np.concatenate([wanted, [False]])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8)])))
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    firsts, lasts = edges[::2], edges[1::2] - 1
    where = np.searchsorted(begins, firsts, "right") - 1
    for w, a, b in zip(where.tolist(), firsts.tolist(), lasts.tolist()):
        out[w].append((a - int(begins[w]), b - int(begins[w])))
    return out


def window_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``d`` (digest of the text), ``key``, ``c`` (digest of the run's bytes), ``lo``, ``n``, ``tie``."""
    names = ["doc_id", "d", "key", "c", "lo", "n", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", BATCH):
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("d").to_pylist()
            rows = [(ids[i], digests[i], *rest) for i, *rest in runs_of(text_bytes(batch.column("t")), length)]
            if rows:
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    return docs.mapInArrow(run, "doc_id long, d binary, key long, c long, lo long, n long, tie boolean")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of representative runs: ``key``, ``c``, ``n``, ``hot``, ``bytes``."""
    lists = wanted.groupBy("d", "doc_id").agg(F.collect_list(F.struct("key", "c", "lo", "n", "hot")).alias("own"))
    lists = lists.withColumnsRenamed({"d": "_d", "doc_id": "_id"})
    met = docs.join(lists, (docs["d"] == lists["_d"]) & docs["doc_id"].eqNullSafe(lists["_id"]))
    one = met.select("t", F.explode("own").alias("r"))
    return one.select(
        "r.key", "r.c", "r.n", "r.hot", F.expr(f"substring(t, cast(r.lo as int) + 1, cast(r.n as int) + {length - 1})").alias("bytes")
    )


def _sorted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of each context by suffix arrays: ``key``, ``c``, ``a``, ``b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def solve() -> list[tuple[int, int, int, int]]:
            found = repeated_windows([r[3] for r in held], [r[2] for r in held], length)
            return [(r[0], r[1], a, b) for r, ranges in zip(held, found) for a, b in ranges]

        def rows(found: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], ["key", "c", "a", "b"])

        for batch in by_bytes(batches, "bytes", SORTED):
            for row in zip(*[batch.column(k).to_pylist() for k in ("key", "c", "n", "bytes")]):
                if held and row[:2] == held[-1][:2]:
                    continue  # the same representative of a repeated row
                if size > SORTED and row[0] != held[-1][0]:
                    if found := solve():
                        yield rows(found)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held and (found := solve()):
            yield rows(found)

    dealt = contexts.repartition("key").sortWithinPartitions("key", "c").select("key", "c", "n", "bytes")
    return dealt.mapInArrow(run, "key long, c long, a long, b long")


def _counted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded keys, by digests of single windows that are counted before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "bytes", BATCH):
            for key, c, n, data in zip(*[batch.column(k).to_pylist() for k in ("key", "c", "n", "bytes")]):
                w = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                columns = [pa.array([key] * n, pa.int64()), pa.array([c] * n, pa.int64())]
                yield pa.record_batch([*columns, pa.array(range(n), pa.int64()), pa.array(w)], ["key", "c", "a", "w"])

    each = materialize(contexts.dropDuplicates(["key", "c"]).select("key", "c", "n", "bytes").mapInArrow(run, "key long, c long, a long, w binary"))
    again = each.groupBy("w").count().where("count > 1").select("w")
    return each.join(again, "w", "left_semi").select("key", "c", "a", F.col("a").alias("b"))


def covered(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``d`` of each text with repeated windows and its covered ``ranges`` (start, end), not merged."""
    runs = materialize(window_runs(docs, length))
    same = runs.groupBy("key", "c").agg(
        F.count("*").alias("k"), F.min(F.struct("d", "doc_id", "lo", "n")).alias("rep"), F.max("tie").alias("tie")
    )
    same = materialize(same)
    contested = same.groupBy("key").agg(F.count("*").alias("contexts"), F.max("tie").alias("tied"))
    contested = contested.where("contexts > 1 or tied").select("key", (F.col("contexts") > hot).alias("hot"))
    wanted = same.join(contested, "key").select("key", "c", "hot", "rep.*")
    contexts = materialize(_contexts(docs, wanted, length))
    sorted_ = _sorted_ranges(contexts.where("not hot"), length)
    counted = _counted_ranges(contexts.where("hot"), length)
    whole = same.where("k > 1").select("key", "c", F.lit(0).cast("long").alias("a"), (F.col("rep.n") - 1).alias("b"))
    ranges = sorted_.unionByName(counted).join(same.where("k > 1").select("key", "c"), ["key", "c"], "left_anti")
    ranges = materialize(ranges.unionByName(whole))
    # equal texts give equal ranges: one row of each before they meet
    met = runs.join(ranges, ["key", "c"]).select(
        "d", (F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("b") + length).alias("end")
    )
    return met.distinct().groupBy("d").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def remove_repeats(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, hot: int = HOT
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs) and ``kept`` (bytes left) of each row."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(content)).alias("d"), content.cast("binary").alias("t")
    )
    found = covered(rows, length, hot).withColumnRenamed("d", "_d")
    met = rows.join(found, rows["d"] == found["_d"], "left").select("doc_id", "t", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"

    def cut(data: bytes, ranges: list | None) -> tuple[int, int, list, bytes]:
        spans: list[list[int]] = []
        for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        at, kept = 0, []
        for start, end in spans:
            kept.append(data[at:start])
            at = end
        kept.append(data[at:])
        own = [{"start": a, "end": b} for a, b in spans]
        return len(data), sum(b - a for a, b in spans), own, b"".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), span, pa.binary()]
        for batch in by_bytes(batches, "t", 8 << 20):
            out = [cut(t, r) for t, r in zip(batch.column("t").to_pylist(), batch.column("ranges").to_pylist())]
            own = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.record_batch([batch.column("doc_id"), *own], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return met.mapInArrow(run, schema)
