"""Secrets in texts: plain patterns, and weak candidates that count only where complementary parts co-occur.

Base spans are strong by themselves. Weak parts are names of accounts (``key_id``), mixed strings (``blob``) and
``endpoint`` addresses. Parts of a document are intervals; those within ``SCOPE`` code points of each other are found
with an interval join on (row, cell of ``SCOPE`` code points): the interval that starts first is written to each cell that
it and its scope touch, the other to the cell where it starts. A cell holds a bounded number of disjoint spans, so a
document full of parts makes work in proportion to its length. An identifier needs a secret in scope, a secret an
identifier, an endpoint both.

Places are code points, ends exclusive. Null texts are empty. Equal rows are reported each. An empty table gives an
empty result. ``redact`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, free_name, spark_type, text_digest
from releaselens.session import materialize

#: Code points between two parts of one credential.
SCOPE = 256
BASE = ("assign", "access", "hex")
WEAK = ("key_id", "blob", "endpoint")
KINDS = BASE + WEAK
#: What a kind is part of: identifiers, secrets, endpoints.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "key_id": "id", "blob": "secret", "endpoint": "endpoint"}

_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ASSIGN_HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEY_ID = re.compile(
    r"""(?i:access_?key_?id|client_?id|account|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,64})""",
    re.ASCII,
)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s\"'<>]{4,}")
_SPAN = "array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; matches that are too short are dropped after matching."""
    out = []
    if _ASSIGN_HINT.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that need a complement; those inside a base span are left to it."""
    out = []
    if "=" in text or ":" in text:
        out += [("key_id", *m.span()) for m in _KEY_ID.finditer(text)]
    if any(len(x) >= 20 for x in text.split()):
        out += [("blob", *m.span()) for m in _BLOB.finditer(text)]
    if "://" in text:
        out += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    free, at, ends = [], 0, 0
    for span in sorted(out, key=lambda s: (s[1], KINDS.index(s[0]))):
        while at < len(base) and base[at][1] < span[2]:
            ends = max(ends, base[at][2])
            at += 1
        if ends <= span[1]:
            free.append(span)
    return free


def parts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Base and weak spans of each whole text beside the columns ``keep``: ``_base``, ``_weak``, or names not taken."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    base_name, weak_name, scanned = (free_name(docs, c) for c in ("_base", "_weak", "_scanned"))
    schema = kept.schema.add(base_name, spark_type(_SPAN)).add(weak_name, spark_type(_SPAN))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
        for batch in by_bytes(batches, scanned, 16 << 20):
            found = []
            for t in batch.column(scanned).to_pylist():
                base = base_spans(t or "")
                found.append((as_rows(base), as_rows(weak_spans(t or "", base))))
            both = [pa.array([f[k] for f in found], spans) for k in (0, 1)]
            yield pa.record_batch([*[batch.column(c) for c in keep], *both], [*keep, base_name, weak_name])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(scanned)).mapInArrow(run, schema)


def linked(table: DataFrame) -> DataFrame:
    """Weak spans with their complement in scope, from ``row``, ``_base``, ``_weak``: ``row``, ``kind``, ``start``, ``end``."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    both = table.where(F.size("_weak") > 0).select("row", F.explode(F.concat("_base", "_weak")).alias("s"))
    spans = both.select("row", "s.kind", "s.start", "s.end").withColumn("role", role[F.col("kind")])
    early = spans.select(
        "*", F.explode(F.sequence(F.expr(f"start div {SCOPE}"), F.expr(f"(end + {SCOPE}) div {SCOPE}"))).alias("cell")
    )
    late = spans.select(
        "row",
        F.expr(f"start div {SCOPE}").alias("cell"),
        *[F.col(c).alias(f"{c}_2") for c in ("kind", "start", "end", "role")],
    )
    in_scope = (
        (F.col("start_2") >= F.col("start")) & (F.col("start_2") <= F.col("end") + SCOPE) & (F.col("role") != F.col("role_2"))
    )
    pairs = early.join(late, ["row", "cell"]).where(in_scope)
    one = pairs.select("row", "kind", "start", "end", "role", F.col("role_2").alias("other"))
    two = pairs.select(
        "row",
        *[F.col(f"{c}_2").alias(c) for c in ("kind", "start", "end", "role")],
        F.col("role").alias("other"),
    )
    weak = one.unionByName(two).where(F.col("kind").isin(*WEAK))
    has = lambda r: F.max(F.when(F.col("other") == r, 1).otherwise(0)) == 1
    met = weak.groupBy("row", "kind", "start", "end", "role").agg(
        F.when(F.col("role") == "id", has("secret"))
        .when(F.col("role") == "secret", has("id"))
        .otherwise(has("id") & has("secret"))
        .alias("whole")
    )
    return met.where("whole").select("row", "kind", "start", "end")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text), ``base`` and ``spans``: arrays of (kind, start, end) by start and kind.

    Where a kept column has one of these names, the new one has underscores before it.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    base_name, weak_name, row, at, extra = (free_name(docs, c) for c in ("_base", "_weak", "_row", "_at", "_more"))
    table = materialize(parts(docs, keep, text).withColumn(row, F.monotonically_increasing_id()))
    narrow = table.select(
        F.col(f"`{row}`").alias("row"), F.col(f"`{base_name}`").alias("_base"), F.col(f"`{weak_name}`").alias("_weak")
    )
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    own = F.struct("kind", "start", "end")
    more = linked(narrow).groupBy(F.col("row").alias(at)).agg(F.collect_list(own).alias(extra))
    none = F.array().cast(_SPAN)
    every = F.concat(f"`{base_name}`", F.coalesce(F.col(f"`{extra}`"), none))
    keyed = F.transform(
        every, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("k"), s["end"].alias("b"), s.alias("s"))
    )
    out = table.join(more, F.col(f"`{row}`") == F.col(f"`{at}`"), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{base_name}`").alias(free_name(keep, "base")),
        F.transform(F.array_sort(keyed), lambda x: x["s"]).alias(free_name(keep, "spans")),
    )


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum and text form of the spans of ``scan``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )


def masked(text: str, starts: Iterable[int], ends: Iterable[int], mask: str) -> str:
    """The text with the spans, sorted by start, replaced; overlapping spans count as one. Linear in the text."""
    out, at = [], 0
    for start, end in zip(starts, ends):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span replaced by ``mask``; rows without one are unchanged. Spans are joined by text digest."""
    d, spans, met_by = (free_name(docs, c) for c in ("_digest", "_spans", "_found_d"))
    narrow = docs.select(text_digest(text).alias("d"), F.col(f"`{text}`").alias("text"))
    found = scan(narrow).where(F.size("spans") > 0).dropDuplicates(["d"])
    found = found.select(F.col("d").alias(met_by), F.col("spans").alias(spans))
    met = docs.withColumn(d, text_digest(text)).join(found, F.col(f"`{d}`") == F.col(f"`{met_by}`"), "left")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        rows = zip(texts, starts, ends)
        return pd.Series([None if t is None else masked(t, a, b, mask) for t, a, b in rows], dtype=object)

    hit = F.col(f"`{spans}`").isNotNull()
    side = lambda name: F.transform(f"`{spans}`", lambda s: s[name])
    # Texts without a span do not go to Python.
    new = F.when(hit, clean(F.when(hit, F.col(f"`{text}`")), side("start"), side("end"))).otherwise(F.col(f"`{text}`"))
    return met.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
