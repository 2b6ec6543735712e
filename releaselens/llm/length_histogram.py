"""Exact histogram of encoded lengths, and from its suffix sums the answer for every context limit.

The histogram has a row for each length that occurs, so totals, quantiles and truncated totals for any limit follow
without the documents. Lengths are counted on the map side before they meet; sums run over ranges of lengths in
several tasks (``running_totals``), not in one window.

A null or empty text has length 0 and counts. An empty table gives an empty histogram. Repeated rows count each; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes
from releaselens.llm.encoding import encoder, vocabulary
from releaselens.operators.ordering import running_totals
from releaselens.session import materialize


def lengths(docs: DataFrame, vocab: str, text: str = "text") -> DataFrame:
    """``length``, ``n_docs``: how many whole texts encode to each number of ids."""
    path = vocabulary(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in by_bytes(batches, "text", 8 << 20):
            n = [len(code.encode(t)) // 4 for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(n, pa.int64())], ["length"])

    each = docs.select(F.col(text).alias("text")).mapInArrow(run, "length long")
    return each.groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as a context limit, over all documents:

    ``docs_upto`` (of length L or less), ``docs_over``, ``tokens_upto`` (ids in documents of L or less),
    ``truncated_tokens`` (ids left when each document is cut to L), ``lost_tokens``, ``quantile`` (share of documents at or
    below L). Between two neighbouring lengths truncated totals are linear, so these rows answer every limit.
    """
    rows = materialize(histogram)
    first = running_totals(rows, ["length"], F.col("n_docs"), before="_docs_before", total="_docs")
    ids = running_totals(
        rows.select("length", "n_docs"), ["length"], F.col("length") * F.col("n_docs"), before="_ids_before", total="_ids"
    ).select(F.col("length").alias("_length"), "_ids_before", "_ids")
    both = first.join(ids, first["length"] == ids["_length"])
    over = F.col("_docs") - F.col("_docs_before") - F.col("n_docs")
    upto = F.col("_ids_before") + F.col("length") * F.col("n_docs")
    return both.select(
        "length",
        "n_docs",
        (F.col("_docs_before") + F.col("n_docs")).alias("docs_upto"),
        over.alias("docs_over"),
        upto.alias("tokens_upto"),
        (upto + over * F.col("length")).alias("truncated_tokens"),
        (F.col("_ids") - upto - over * F.col("length")).alias("lost_tokens"),
        ((F.col("_docs_before") + F.col("n_docs")) / F.col("_docs")).alias("quantile"),
    )


def totals_at(table: DataFrame, limit: int) -> dict[str, int]:
    """Documents over ``limit`` and ids left when each document is cut to it, for any limit, from ``limits``."""
    below = table.where(F.col("length") <= limit)
    row = below.agg(F.max_by("docs_over", "length"), F.max_by("tokens_upto", "length")).first()
    if row[0] is None:
        over, upto = table.agg(F.sum("n_docs")).first()[0] or 0, 0
    else:
        over, upto = row
    return {"docs_over": over, "truncated_tokens": upto + over * limit}


def quantile(table: DataFrame, share: float) -> int | None:
    """The least length with at least ``share`` of the documents at or below it."""
    return table.where(F.col("quantile") >= share).agg(F.min("length")).first()[0]
