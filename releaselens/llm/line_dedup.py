"""Drops lines that recur across documents: hash of each normalised line, distinct documents per hash, reassembly.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys of ``MIN_CHARS`` code
points or more that ``MIN_DOCS`` different documents hold lose all their lines, except in the smallest id that
holds them. Keys travel as 128-bit digests, one row for each different key of a text with the places of its lines, so a
line never moves. Documents are counted in two steps, first by (key, document), so a line that every document holds
is a row a task before its counts meet; the verdict's join is on the digest and left to adaptive skew splitting.

Null and empty texts are one empty line. Rows of one id are one document when documents are counted, and each
row comes back; equal rows lose the same lines. A null id is an id of its own, smaller than the others. Only the id and the
text are read, whatever other columns there are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, text_bytes
from releaselens.session import materialize

MIN_CHARS, MIN_DOCS = 10, 2
SPACE = b" \t\n\x0b\x0c\r"
BATCH = 4 << 20


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a normalised line; None if the key has fewer code points than ``min_chars``."""
    key = line.strip(SPACE).lower()  # of bytes: A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``d``, ``key`` and its places ``at``: one row for each different key of a text."""
    names = ["doc_id", "d", "key", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", BATCH):
            own, keys, places = [], [], []
            for i, text in enumerate(text_bytes(batch.column("t"))):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split(b"\n")):
                    key = line_key(line, min_chars)
                    if key:
                        found.setdefault(key, []).append(at)
                own += [i] * len(found)
                keys += found.keys()
                places += found.values()
            who = pa.array(own, pa.int64())
            columns = [batch.column("doc_id").take(who), batch.column("d").take(who), pa.array(keys, pa.binary())]
            yield pa.record_batch([*columns, pa.array(places, pa.list_(pa.int32()))], names)

    return rows.mapInArrow(run, "doc_id long, d binary, key binary, at array<int>")


def dropped_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id``, ``d`` and the places ``gone`` of the lines that a text loses."""
    ids = keys.select("key", "doc_id").distinct()
    held = ids.groupBy("key").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unnamed")
    )
    # written, so that the join stands between two exchanges (or a small table) and a crowded key can be split
    recurring = materialize(held.where(F.col("n_docs") >= min_docs).select("key", "least", "unnamed"))
    first = F.when(F.col("unnamed"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("least"))
    losing = keys.join(recurring, "key").where(~first)
    # equal rows hold equal lists: one of each stays
    return losing.groupBy("doc_id", "d").agg(F.flatten(F.collect_set("at")).alias("gone"))


def drop_recurring_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``doc_id``, ``n_lines`` (before dropping), ``n_dropped`` and ``kept``, the text of the lines left."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.unhex(F.md5(content)).alias("d"),
        content.cast("binary").alias("t"),
    )
    keys = materialize(line_keys(rows, min_chars))
    gone = dropped_lines(keys, min_docs).withColumnsRenamed({"doc_id": "_id", "d": "_d"})
    met = rows.join(gone, (rows["d"] == gone["_d"]) & rows["doc_id"].eqNullSafe(gone["_id"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "t", BATCH):
            lines, lost, kept = [], [], []
            for data, places in zip(text_bytes(batch.column("t")), batch.column("gone").to_pylist()):
                own, out = data.split(b"\n"), set(places or ())
                lines.append(len(own))
                lost.append(len(out))
                kept.append((b"\n".join([x for i, x in enumerate(own) if i not in out]) if out else data).decode())
            columns = [pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_lines", "n_dropped", "kept"])

    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    return met.select("doc_id", "t", "gone").mapInArrow(run, schema)
