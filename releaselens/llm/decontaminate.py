"""Benchmark passages in documents, paraphrases included, by latent semantic retrieval and checks of the words.

Passages of ``SEGMENT`` words become TF-IDF rows over ``BUCKETS`` hashed words; document frequencies are counted over all
documents. A distributed randomised singular value decomposition gives ``RANK`` latent directions: every task reduces its
rows to small matrices of fixed size that are added up by blocks in tasks; the basis is fitted on every passage and all
benchmark items. A window of two
neighbouring passages and an item are compared by the cosine of their whitened projections; the benchmark is the stated
query set and is broadcast as one matrix, its size checked. Candidates whose words weigh enough in common with the
item (a bound from a table of bits) are verified by the longest common subsequence of
words between the item and the text around the window, and by the answer, the item's last words, which must be there too.

Only A-Z are folded with the rest of the case by Unicode rules; words are runs of letters and digits. Null texts and items
without words never match. Repeated rows and repeated items are reported each. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, free_name, spark_type, text_digest
from releaselens.session import materialize

BUCKETS, SEGMENT, RANK, OVER = 1 << 15, 16, 64, 8
PARTS, MAX_ITEMS = 6, 200_000
#: Tasks of a job of the fit for each core; words that a task works on at once.
TASKS_A_CORE, WORDS_AT_ONCE, ITEMS_AT_ONCE, SUMS = 2, 1 << 18, 1 << 12, 512
#: Buckets of a block of the dense matrices (``BUCKETS`` is a multiple of it).
BLOCK = 1 << 11
#: Least cosine of a candidate; least share of weighted words that it has in common with the item; least shares of an item's and of its answer's words that stand in order.
COSINE, SHARED, LEAST, ANSWER = 0.4, 0.35, 0.6, 0.5
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """32-bit hash of each word, kept in a bounded table."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = found = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = _Hashes()


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text: what is neither becomes a blank, unless too many characters do."""
    if not text:
        return []
    text = text.lower()
    other = [c for c in set(text) if not c.isalnum() and not c.isspace()]
    if len(other) > 40:
        return _WORD.findall(text)
    for c in other:
        text = text.replace(c, " ")
    return text.split()


def word_hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint32, len(words))


def tokens(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Hashed words of each whole text beside the columns ``keep``."""
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("words", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_read", 16 << 20):
            own = [word_hashes(t).tobytes() for t in batch.column("_read").to_pylist()]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(own, pa.binary())], [*keep, "words"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_read")).mapInArrow(run, schema)


def _words(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def document_frequency(table: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents): one row for each bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, held = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
        for batch in batches:
            for data in batch.column("words").to_pylist():
                w = _words(data) & np.uint32(BUCKETS - 1)
                held[w] = True
                seen = np.flatnonzero(held)
                df[seen] += 1
                held[seen] = False
                n += 1
        at = np.concatenate([np.arange(BUCKETS), [-1]])
        yield pa.record_batch([pa.array(at), pa.array(np.concatenate([df, [n]]))], ["at", "n"])

    found = table.select("words").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in found.collect():  # BUCKETS + 1 rows
        out[r["at"]] = r["n"]
    return out[:BUCKETS], int(out[-1])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


@dataclass(frozen=True)
class Rows:
    """TF-IDF rows, the buckets of their words laid end to end: ``whole`` rows of ``SEGMENT`` words, then the others."""

    buckets: np.ndarray
    starts: np.ndarray
    whole: int
    norms: np.ndarray

    @staticmethod
    def of(whole: list[np.ndarray], others: list[np.ndarray], squares: np.ndarray) -> Rows:
        buckets = (np.concatenate([*whole, *others]) & np.uint32(BUCKETS - 1)).astype(np.uint16)
        n = sum(map(len, whole)) // SEGMENT
        sizes = np.array([SEGMENT] * n + [len(w) for w in others])
        starts = np.cumsum(sizes) - sizes
        return Rows(buckets, starts, n, np.sqrt(np.add.reduceat(squares.take(buckets), starts))[:, None])


def passages(texts: Iterable[np.ndarray], squares: np.ndarray) -> Iterator[Rows]:
    """All passages of ``SEGMENT`` words of the texts, about ``WORDS_AT_ONCE`` words at a time."""
    whole, tails, n = [], [], 0
    for words in texts:
        for at in range(0, len(words), WORDS_AT_ONCE):  # a multiple of the passages
            w = words[at : at + WORDS_AT_ONCE]
            cut = len(w) - len(w) % SEGMENT
            if cut:
                whole.append(w[:cut])
            if cut < len(w):
                tails.append(w[cut:])
            n += len(w)
            if n >= WORDS_AT_ONCE:
                yield Rows.of(whole, tails, squares)
                whole, tails, n = [], [], 0
    if n:
        yield Rows.of(whole, tails, squares)


def _runs(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; two columns are added at once."""
    return np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32)


def _sixteens(dense: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each ``SEGMENT`` rows of ``dense`` in the order of ``at``, few at a time."""
    out = np.empty((len(at) // SEGMENT, dense.shape[1]), np.float32)
    for k in range(0, len(out), SUMS):
        some = dense.take(at[k * SEGMENT : (k + SUMS) * SEGMENT], axis=0)
        np.einsum("ijk->ik", some.reshape(-1, SEGMENT, dense.shape[1]), out=out[k : k + SUMS])
    return out


def _times(rows: Rows, weighted: np.ndarray) -> np.ndarray:
    """The TF-IDF rows times a dense matrix whose rows are weighted by idf."""
    cut = rows.whole * SEGMENT
    out = _sixteens(weighted, rows.buckets[:cut])
    if cut < len(rows.buckets):
        out = np.concatenate([out, _runs(weighted.take(rows.buckets[cut:], axis=0), rows.starts[rows.whole :] - cut)])
    out /= rows.norms
    return out


def _add_transposed(out: np.ndarray, rows: Rows, dense: np.ndarray) -> None:
    """Add the transpose of the rows, idf left out, times a dense matrix.

    The words of a bucket are cut into pieces of ``SEGMENT``, the last one filled with rows of zeros.
    """
    dense = np.concatenate([dense / rows.norms, np.zeros((1, dense.shape[1]), np.float32)])
    n = len(rows.buckets)
    row = np.repeat(np.arange(len(rows.starts)), np.diff(np.append(rows.starts, n)))
    order = np.argsort(rows.buckets, kind="stable")
    b = rows.buckets.take(order)
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    many = np.diff(np.append(first, n))
    pieces = -(-many // SEGMENT)
    piece = np.cumsum(pieces) - pieces
    filled = np.full(int(pieces.sum()) * SEGMENT, len(dense) - 1)
    filled[np.arange(n) + np.repeat(piece * SEGMENT - first, many)] = row.take(order)
    out[b[first]] += _runs(_sixteens(dense, filled), piece)


def _blocks() -> list[slice]:
    """Rows of the dense matrices that are added up, shuffled and turned at once."""
    return [slice(at, at + BLOCK) for at in range(0, BUCKETS, BLOCK)]


def orthonormal(dense: np.ndarray) -> None:
    """Replace the columns by an orthonormal basis of them, in place: blocks of rows first, then their triangles."""
    turns, triangles = [], []
    for rows in _blocks():
        turn, triangle = np.linalg.qr(dense[rows].astype(np.float64))
        dense[rows] = turn
        triangles.append(triangle)
    turns = np.split(np.linalg.qr(np.concatenate(triangles))[0], len(triangles))
    for rows, turn in zip(_blocks(), turns):
        dense[rows] = dense[rows].astype(np.float64) @ turn


def added_up(parts: RDD, thin: int) -> np.ndarray:
    """Sum of matrices that come as (block, (task, rows)), added in tasks, in the order of the tasks that made them.

    The driver gets the sum alone, whatever the number of tasks.
    """

    def add(own: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
        own = sorted(own, key=lambda x: x[0])
        total = own[0][1].copy()
        for _, rows in own[1:]:
            total += rows
        return total

    found = parts.groupByKey(PARTS).mapValues(add).collect()
    out = np.zeros((BUCKETS, thin), np.float32)
    while found:  # what is copied is dropped
        k, rows = found.pop()
        out[_blocks()[k]] = rows
    return out


def fit(
    table: DataFrame, idf: np.ndarray, rank: int = RANK, items: Sequence[np.ndarray] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """(word directions, singular values) by a randomised decomposition with one power step.

    Rows are all passages of the texts of ``table`` and the ``items``, each a row of its own. A step is one job, whose tasks
    return the product of their rows' gram matrix with a thin basis: ``BUCKETS`` x (rank + ``OVER``) numbers, added up by blocks
    in tasks. There are ``TASKS_A_CORE`` tasks a core, so what is added up does not grow with the table; a task works on few rows
    at a time. The last step needs the small matrix of the projected rows only. The driver holds three matrices at most and
    works on them by blocks.
    """
    spark = table.sparkSession
    texts = table.select("words", F.lit(False).alias("item"))
    if items:
        own = spark.createDataFrame([(bytearray(w.tobytes()), True) for w in items], "words binary, item boolean")
        texts = texts.unionByName(materialize(own))
    texts = texts.coalesce(max(PARTS, TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    thin, squares = rank + OVER, idf * idf

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        apart = []

        def cut() -> Iterator[np.ndarray]:
            for batch in batches:
                for data, item in zip(batch.column("words").to_pylist(), batch.column("item").to_pylist()):
                    if not item:
                        yield _words(data)
                    elif data:
                        apart.append(_words(data))

        yield from passages(cut(), squares)
        for at in range(0, len(apart), ITEMS_AT_ONCE):
            yield Rows.of([], apart[at : at + ITEMS_AT_ONCE], squares)

    def from_tasks(dense: np.ndarray, work: Callable[[np.ndarray, Iterator[Rows]], Iterator[np.ndarray]]) -> RDD:
        """(block, (task, matrix)) of what each task makes of its rows and a dense matrix, weighted by idf."""
        shared = spark.sparkContext.broadcast(dense)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            for at, own in enumerate(work(shared.value, rows(batches))):
                yield pa.record_batch([pa.array([at]), pa.array([task]), pa.array([own.tobytes()])], ["at", "task", "own"])

        found = texts.mapInArrow(run, "at long, task long, own binary").rdd
        return found.map(lambda r: (r[0], (r[1], np.frombuffer(r[2], np.float32).reshape(-1, thin))))

    def weighted(dense: np.ndarray) -> np.ndarray:
        for own in _blocks():
            dense[own] *= idf[own, None]
        return dense

    def gram(dense: np.ndarray, rows: Iterator[Rows]) -> Iterator[np.ndarray]:
        out = np.zeros((BUCKETS, thin), np.float32)
        for some in rows:
            _add_transposed(out, some, _times(some, dense))
        for own in _blocks():
            yield out[own] * idf[own, None]

    def small_gram(dense: np.ndarray, rows: Iterator[Rows]) -> Iterator[np.ndarray]:
        out = np.zeros((thin, thin))
        for some in rows:
            projected = _times(some, dense).astype(np.float64)
            out += projected.T @ projected
        yield out.astype(np.float32)

    rng, basis = np.random.default_rng(11), np.empty((BUCKETS, thin), np.float32)
    for own in _blocks():
        basis[own] = rng.standard_normal((BLOCK, thin))
    for _ in range(2):
        basis = added_up(from_tasks(weighted(basis), gram), thin)
        orthonormal(basis)
    # thin x thin numbers a task
    found = sorted(from_tasks(weighted(basis.copy()), small_gram).values().collect(), key=lambda x: x[0])
    small = sum(own.astype(np.float64) for _, own in found)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    values = np.sqrt(np.maximum(values[order], 1e-12))
    turn = turn[:, order]
    directions = np.empty((BUCKETS, len(order)), np.float32)
    for own in _blocks():
        directions[own] = basis[own].astype(np.float64) @ turn
    return directions, values


def places_of(words: np.ndarray) -> dict[int, int]:
    """The places of each word as bits."""
    places: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    return places


def lcs_of_hits(n: int, hits: list[int]) -> int:
    """Length of the longest common subsequence of ``n`` words and a text, from the places of each word of the text that
    they have: one machine word of bits for each."""
    row = full = (1 << n) - 1
    for hit in hits:
        u = row & hit
        row = (row + u) | (row - u)
        row &= full
    return n - row.bit_count()


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    places = places_of(a)
    return lcs_of_hits(len(a), [places[w] for w in b.tolist() if w in places])


def answer_of(item: np.ndarray) -> np.ndarray:
    """The last words of an item."""
    return item[-max(3, len(item) // 5) :]


def verify(item: np.ndarray, words: np.ndarray, at: int, places: dict[int, int] | None = None) -> tuple[float, int]:
    """(share of the item's words in order, 0 if the answer is missing; first word of the text compared).

    The item's words that occur at all bound those in order, so words are aligned only where the bound reaches ``LEAST``.
    """
    first = max(0, at - len(item))
    around = words[first : at + 2 * SEGMENT + len(item)]
    places = places_of(item) if places is None else places
    hits = [places[w] for w in around.tolist() if w in places]
    occur = 0
    for hit in hits:
        occur |= hit
    if min(len(hits), occur.bit_count()) / len(item) < LEAST:
        return 0.0, first
    share = lcs_of_hits(len(item), hits) / len(item)
    if share < LEAST:
        return 0.0, first
    answer = answer_of(item)
    return (share, first) if lcs(answer, around) >= ANSWER * len(answer) else (0.0, first)


class Lexicon:
    """Words of each item in one table of bits, to bound what a window can share with an item before words are aligned."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray):
        self.idf = idf
        self.bits = np.zeros(1 << max(16, int(64 * sum(map(len, items))).bit_length()), bool)
        for q, item in enumerate(items):
            self.bits[self._at(np.int64(q), (item & np.uint32(BUCKETS - 1)).astype(np.int64))] = True
        self.mass = np.array([idf[item & np.uint32(BUCKETS - 1)].sum() for item in items])

    def _at(self, q, bucket):
        return (q * 0x9E3779B1 + bucket * 0x85EBCA6B) & (len(self.bits) - 1)

    def windows(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scrambled bucket, weight) of each word of each window of one document; weight 0 past its end."""
        n = -(-len(buckets) // SEGMENT) * SEGMENT
        key, weight = np.zeros(n, np.int64), np.zeros(n, np.float32)
        key[: len(buckets)] = buckets * 0x85EBCA6B
        weight[: len(buckets)] = self.idf[buckets]
        if n == SEGMENT:
            return key[None, :], weight[None, :]
        both = [x.reshape(-1, SEGMENT) for x in (key, weight)]
        return tuple(np.concatenate([x[:-1], x[1:]], axis=1) for x in both)

    def likely(self, key: np.ndarray, weight: np.ndarray, mass: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the words of window ``w`` that item ``q`` has weigh enough against the lighter of the two."""
        out = []
        for at in range(0, len(q), 1 << 12):
            v, k = w[at : at + (1 << 12)], q[at : at + (1 << 12)]
            place = key.take(v, axis=0)
            place += (k * 0x9E3779B1)[:, None]
            place &= len(self.bits) - 1
            shared = weight.take(v, axis=0)
            shared *= self.bits.take(place)
            out.append(shared.sum(1) >= SHARED * np.minimum(mass[v], self.mass[k]))
        return np.concatenate(out) if out else np.zeros(0, bool)


def segment_sums(project: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Sum of the projected words of each passage."""
    words = project.take(buckets, axis=0)
    whole = len(buckets) // SEGMENT
    sums = np.empty((-(-len(buckets) // SEGMENT), project.shape[1]), project.dtype)
    words[: whole * SEGMENT].reshape(whole, SEGMENT, project.shape[1]).sum(1, out=sums[:whole])
    if whole < len(sums):
        sums[whole] = words[whole * SEGMENT :].sum(0)
    return sums


def search(
    words: np.ndarray, project: np.ndarray, queries: np.ndarray, lexicon: Lexicon, cosine: float
) -> Iterator[tuple[int, int]]:
    """(first word of a window, item) of each candidate in one document."""
    buckets = (words & np.uint32(BUCKETS - 1)).astype(np.int64)
    sums = segment_sums(project, buckets)
    windows = sums[:-1] + sums[1:] if len(sums) > 1 else sums
    norm = np.sqrt((windows * windows).sum(1))
    windows = windows / np.maximum(norm, 1e-12)[:, None]
    key = weight = mass = None
    for at in range(0, len(windows), 4096):
        w, q = np.divmod(np.flatnonzero(windows[at : at + 4096] @ queries >= cosine), queries.shape[1])
        if len(q):
            if key is None:
                key, weight = lexicon.windows(buckets)
                mass = weight.sum(1)
            likely = lexicon.likely(key, weight, mass, w + at, q)
            yield from zip(((w + at) * SEGMENT)[likely].tolist(), q[likely].tolist())


def leaks(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_text: str = "text",
    item_id: str = "item_id", cosine: float = COSINE,
) -> DataFrame:
    """``keep`` and ``items``: an array of (item_id, score, word) for each document, empty where it is clean."""
    spark = docs.sparkSession
    table = materialize(tokens(docs, text, keep))
    size = benchmark.count()
    if size > MAX_ITEMS:
        raise ValueError(f"{size} items: search them in blocks of at most {MAX_ITEMS}")
    known = [(r[0], word_hashes(r[1])) for r in benchmark.select(item_id, item_text).collect()]
    known = sorted(((i, w) for i, w in known if len(w)), key=lambda x: (x[0] is None, x[0] or 0, x[1].tobytes()))
    found_type = "array<struct<item_id:long,score:double,word:long>>"
    if not known:
        return table.select(*[F.col(f"`{c}`") for c in keep], F.array().cast(found_type).alias("items"))
    df, n = document_frequency(table)
    idf = idf_of(df, n)
    directions, values = fit(table, idf, items=[w for _, w in known])
    project = directions  # of the same size: turned into the projection in place
    project /= np.maximum(values, values[0] * 1e-3).astype(np.float32)
    project *= idf[:, None]
    queries = np.stack([project[w & np.uint32(BUCKETS - 1)].sum(0) for _, w in known])
    queries = (queries / np.maximum(np.linalg.norm(queries, axis=1), 1e-12)[:, None]).T.astype(np.float32).copy()
    lexicon = Lexicon([w for _, w in known], idf)
    shared = spark.sparkContext.broadcast((project, queries, known, lexicon))  # BUCKETS x RANK, and the query set
    schema = table.drop("words").schema.add("items", spark_type(found_type))
    item = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project_, queries_, known_, lexicon_ = shared.value
        places = [places_of(w) for _, w in known_]
        for batch in by_bytes(batches, "words", 16 << 20):
            out = []
            for data in batch.column("words").to_pylist():
                words, best = _words(data), {}
                if len(words):
                    for at, q in search(words, project_, queries_, lexicon_, cosine):
                        if best.get(q, (0.0, 0))[0] >= 1.0:
                            continue
                        score, first = verify(known_[q][1], words, at, places[q])
                        if score > best.get(q, (0.0, 0))[0]:
                            best[q] = (score, first)
                out.append([{"item_id": known_[q][0], "score": s, "word": w} for q, (s, w) in sorted(best.items())])
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(out, item)], [*keep, "items"])

    return table.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document and benchmark item found in it."""
    found = leaks(docs, benchmark, [doc_id], text)
    each = found.select(F.col(doc_id).alias("doc_id"), F.explode("items").alias("i"))
    return each.select("doc_id", "i.item_id", "i.score", "i.word", F.lit(True).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without documents that hold a benchmark passage."""
    d = free_name(docs, "_digest")
    narrow = docs.select(text_digest(text).alias("d"), F.col(f"`{text}`").alias("text"))
    bad_d = free_name(docs, "_bad_d")
    bad = leaks(narrow, benchmark, ["d"]).where(F.size("items") > 0).select(F.col("d").alias(bad_d))
    bad = materialize(bad.distinct())
    rows = docs.withColumn(d, text_digest(text))
    return rows.join(bad, F.col(f"`{d}`") == F.col(bad_d), "left_anti").drop(d)
