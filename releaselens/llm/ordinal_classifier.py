"""Ordinal quality classifier: one score from hashed text features, ordered thresholds between the grades.

P(grade <= k) = sigmoid(threshold_k - score). Weights are shared by all grades; the expected grade and the probability of
the highest grade select documents. The fit uses a bounded sample of the labelled rows (``FIT_ROWS``, those of least
hash): features are written once, each step sums gradients over a fixed number of partitions. Scoring covers all rows.

Grades of the tables at hand: 0 toxic, 1 poor quality, 2 good. Null texts are empty texts (shape features only); rows with
null labels are not fitted; of several labels of one id the least grade counts; of several rows of one
id the one of least grade and feature bytes is fitted, all are scored. ``fit`` without rows raises ``NoLabels``; ``scored`` then gives null scores and verdicts. An empty
table scores to an empty result. Input columns named like the new ones are replaced by them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, free_name
from releaselens.session import materialize

WORDS, SHAPES = 1 << 16, 1 << 10
DIMS, FIT_ROWS, PARTS, STEPS, RATE, DECAY = WORDS + SHAPES, 20_000, 8, 80, 0.3, 1e-4
#: A feature is used if its documents' mean grade is so many standard errors from the mean of all.
SURE = 3.5
_WORD = re.compile(r"[^\W_]+")


class _Buckets(dict):
    """Bucket of each word, kept in a bounded table."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        self[word] = found = WORDS + code % SHAPES if word[0] == "\x00" else code % WORDS
        return found


_BUCKETS = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Buckets of the different words and of the text's shape, each counted once; shapes have buckets of their own."""
    text = text or ""
    words = _WORD.findall(text.lower())
    different = set(words)
    n, size = max(1, len(words)), max(1, len(text))
    letters = sum(map(text.count, "aeiou")) + 1
    upper = sum(map(text.count, "AEIOU"))
    marks = sum(map(text.count, "!|#*$%&<>{}"))
    lines = [x for x in text.split("\n") if x.strip()]
    shape = [
        f"\x00n{min(12, n.bit_length())}",
        f"\x00d{10 * len(different) // n}",
        f"\x00u{10 * upper // (letters + upper)}",
        f"\x00m{min(40, 200 * marks // size)}",
        f"\x00l{10 * len(set(lines)) // max(1, len(lines))}",
        f"\x00w{min(20, size // n)}",
    ]
    return np.unique(np.fromiter(map(_BUCKETS.__getitem__, [*different, *shape]), np.int32))


class NoLabels(ValueError):
    """No labelled document to fit."""


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``grade`` of the labelled documents: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    known = labels.select("doc_id", grade.alias("grade")).where("grade is not null")
    known = known.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return docs.select("doc_id", "text").join(known, "doc_id")


def _sure(table: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """1 for each feature whose documents differ in grade beyond chance, else 0, from one pass of fixed-size sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, DIMS))
        for batch in batches:
            xs = [np.frombuffer(b, np.int32) for b in batch.column("x").to_pylist()]
            grade = np.repeat(batch.column("grade").to_numpy().astype(np.float64), [len(x) for x in xs])
            idx = np.concatenate(xs)
            out += [np.bincount(idx, None, DIMS), np.bincount(idx, grade, DIMS)]
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["s"])

    parts = table.mapInArrow(sums, "s binary").collect()  # PARTS rows of fixed size
    n, total = np.sum([np.frombuffer(bytes(r["s"])).reshape(2, DIMS) for r in parts], axis=0)
    docs = sum(counts.values())
    mean = sum(g * k for g, k in counts.items()) / docs
    spread = np.sqrt(sum(k * (g - mean) ** 2 for g, k in counts.items()) / docs)
    z = np.abs(total - n * mean) / np.maximum(spread * np.sqrt(np.maximum(n, 1)), 1e-9)
    return (z > SURE).astype(np.float64)


def likelihood(xs: list[np.ndarray], y: np.ndarray, weights: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Gradient of the negative log-likelihood by weights, then by thresholds, and its value, in one array."""
    edges = np.concatenate([[-np.inf], cut, [np.inf]])
    idx, row = np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    s = np.bincount(row, weights[idx], len(xs))
    low, high = (1 / (1 + np.exp(np.clip(s - edges[y + k], -40, 40))) for k in (0, 1))
    p = np.maximum(high - low, 1e-12)
    dl, dh = low * (1 - low) / p, high * (1 - high) / p
    gw = np.bincount(idx, (dh - dl)[row], DIMS)
    # Threshold k is the upper edge of grade k, the lower one of k + 1.
    gt = [dl[y == k + 1].sum() - dh[y == k].sum() for k in range(len(cut))]
    return np.concatenate([gw, gt, [-np.log(p).sum()]])


def fit(rows: DataFrame, grades: int = 3, fit_rows: int = FIT_ROWS, steps: int = STEPS) -> Model:
    """Fit by full-batch steps with a rate of its own for each weight."""
    order = F.xxhash64("doc_id", F.lit("fit"))
    chosen = rows.select("doc_id", order.alias("h")).distinct().orderBy("h", "doc_id").limit(fit_rows)
    chosen = materialize(chosen.select("doc_id"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, grade int, x binary"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 16 << 20):
            x = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), pa.array(x, pa.binary())], ["doc_id", "grade", "x"])

    table = rows.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).join(chosen, "doc_id", "left_semi")
    # One row an id, so that repeated ids cannot pass the bound; features move, texts do not.
    table = table.mapInArrow(extract, schema).groupBy("doc_id").agg(F.min(F.struct("grade", "x")).alias("r"))
    table = materialize(table.select("r.grade", "r.x").repartition(PARTS))
    counts = {r["grade"]: r["count"] for r in table.groupBy("grade").count().collect()}  # one row a grade
    total = sum(counts.values())
    if not total:
        raise NoLabels("no labelled rows to fit")
    at_most = np.cumsum([counts.get(k, 0) + 0.5 for k in range(grades)])[:-1] / (total + 0.5 * grades)
    theta = np.log(at_most / (1 - at_most))
    values = _sure(table, counts)
    w, seen_w, seen_t = np.zeros(DIMS), np.full(DIMS, 1e-8), np.full(grades - 1, 1e-8)

    for _ in range(steps):
        w32, cut = (w * values).astype(np.float32), theta.copy()

        def gradient(batches: Iterator[pa.RecordBatch], w32=w32, cut=cut) -> Iterator[pa.RecordBatch]:
            out = np.zeros(DIMS + grades)
            for batch in batches:
                xs = [np.frombuffer(b, np.int32) for b in batch.column("x").to_pylist()]
                if xs:
                    out += likelihood(xs, batch.column("grade").to_numpy(), w32, cut)
            yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], ["g"])

        parts = table.mapInArrow(gradient, "g binary").collect()  # PARTS rows of fixed size
        g = np.sum([np.frombuffer(bytes(r["g"])) for r in parts], axis=0) / total
        gw, gt = g[:DIMS] * values + DECAY * w, g[DIMS:-1]
        seen_w += gw * gw
        seen_t += gt * gt
        w = w - RATE * gw / np.sqrt(seen_w)
        theta = np.maximum.accumulate(theta - RATE * gt / np.sqrt(seen_t))
    return Model((w * values).astype(np.float32), theta)


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Add ``expected_grade``, ``tail_probability`` (of the highest grade) and ``kept`` to every row; the text goes."""
    others = [c for c in docs.columns if c != text and c not in ("expected_grade", "tail_probability", "kept")]
    scored_text = free_name(others, "_scored")
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = kept.schema.add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, scored_text, 16 << 20):
            s = np.array([model.weights[features(t)].sum() for t in batch.column(scored_text).to_pylist()], np.float64)
            tails = model.tails(s)
            own = [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)]
            names = [*others, "expected_grade", "tail_probability", "kept"]
            yield pa.record_batch([*[batch.column(c) for c in others], *own], names)

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(scored_text)).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` by a model of the labelled documents; without any, scores and verdicts are null."""
    try:
        return score(docs, fit(graded(docs, labels)))
    except NoLabels:
        new = {"expected_grade": "double", "tail_probability": "double", "kept": "boolean"}
        others = [F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in new]
        return docs.select(*others, *[F.lit(None).cast(kind).alias(c) for c, kind in new.items()])
