"""Near duplicates by SimHash, linked through tables of distances to reference fingerprints.

Each different fingerprint has a row of distances to many references. A difference of ``BITS`` bits moves no distance by
more than ``BITS``, so a pair whose largest coordinate difference is larger is discarded, and only survivors are compared
bit by bit. The first references span the bits of one block each: relative to the zero reference, their distances spell
that block (d(f, p) - d(f, 0) = |p| - 2 |f & p|), so equal coordinates on a block are equal bits there and the masked
fingerprint serves as the key of those coordinates. Two fingerprints within ``BITS`` = 3 of each other agree on all
coordinates of at least three of six blocks: pairs meet in one of 20 tables, and no others are looked at. The
remaining references are random and discard inside a bucket. A bucket above ``HOT`` fingerprints is dealt out again by
blocks of its free bits, by the same argument, until none is larger: exact, with no cap. Buckets return a spanning
forest of their links, never all pairs. Exact copies of a fingerprint are one row from the start.

``keep_one``, the stage of the pipeline, checks what these links join by all five-word shingles, and goes beyond ``BITS``: texts
also meet by keys of their shingles.

Links become components in rounds of written tables (least label of the neighbours, then of the label's label).

Null and wordless texts have fingerprint zero and link like any other. Equal and null ids keep a row each; a group
whose ids are all null has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes, free_name, spark_type, text_bytes, text_digest
from releaselens.session import materialize, materialize_with

SHINGLE, BITS, SEED = 3, 3, 42
#: Sizes of the blocks, random references, and the fingerprints of one bucket that are searched at once.
BLOCKS, PIVOTS, HOT = (11, 11, 11, 11, 10, 10), 32, 2048
#: For ``keep_one``: words of a shingle, least similarity (a fraction), least values in a band, bands, rounds of stars, and
#: members of the largest bucket from which all pairs are compared at once.
NEAR, ALIKE, ROWS, BANDS, STARS, FEW = 5, (4, 5), 5, 30, 2, 16


def fingerprint_of(text: bytes) -> int:
    """Majority bits of the hashes of all word shingles of one text."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(*[words[k:] for k in range(SHINGLE)])]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long; the text itself is dropped."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, 32 << 20):
            found = np.array([fingerprint_of(t) for t in text_bytes(batch.column(text))], "<u8").view("<i8")
            yield pa.record_batch([*[batch.column(c) for c in others], pa.array(found)], [*others, out])

    return docs.mapInArrow(run, schema)


def _masks(free: int, parts: int) -> list[int]:
    """Masks that cut the set bits of ``free`` into so many runs."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << int(b) for b in run) for run in np.array_split(bits, min(parts, len(bits)))]


def first_masks() -> list[int]:
    """A mask for each choice of three blocks."""
    blocks, at = [], 0
    for size in BLOCKS:
        blocks.append(((1 << size) - 1) << at)
        at += size
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fp: Column, masks: list[int]) -> Column:
    own = [F.struct(F.lit(_signed(m)).alias("mask"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]
    return F.explode(F.array(*own))


def references(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def bucket_links(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs, as a spanning forest, among rows sorted by ``group``."""
    pivots = references()
    distance = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    left, right = [], []
    at = np.arange(len(fps))
    for shift in range(1, len(fps)):
        at = at[at + shift < len(fps)]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        near = at
        for k in range(0, len(pivots), 8):
            near = near[np.abs(distance[near, k : k + 8] - distance[near + shift, k : k + 8]).max(1) <= BITS]
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= BITS]
        left.append(near)
        right.append(near + shift)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(fps))
    while True:  # least place that is linked, then of that place
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(fps)))
    return child, root[child]


def links(distinct: DataFrame, fp: str = "fp", hot: int = HOT) -> DataFrame:
    """Links between different fingerprints at ``BITS`` or fewer bits: ``a``, ``b``, a spanning forest of each bucket."""
    spark = distinct.sparkSession
    fps = distinct.select(F.col(fp).alias("fp"))
    keyed = fps.select("fp", _keyed(F.col("fp"), first_masks()))
    keyed = keyed.select("fp", F.col("col.mask").alias("mask"), F.col("col.key").alias("key"))
    searched = []
    while True:
        crowded = keyed.groupBy("mask", "key").count().where(F.col("count") > hot).select("mask", "key")
        crowded, size = materialize_with(crowded, n=F.count("*"))
        if not size["n"]:
            searched.append(keyed)
            break
        searched.append(keyed.join(crowded, ["mask", "key"], "left_anti"))
        rest = keyed.join(crowded, ["mask", "key"], "left_semi")
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # a few for each round
        finer = [(m, [_signed((m | f) % (1 << 64)) for f in _masks(~m % (1 << 64), BITS + 1)]) for m in masks]
        own = F.create_map(*[x for m, f in finer for x in (F.lit(m), F.array(*map(F.lit, f)))])
        keyed = rest.select("fp", F.explode(F.element_at(own, F.col("mask"))).alias("mask"))
        keyed = materialize(keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        schema = ["mask", "key", "fp"]

        def solve(rows: list[np.ndarray]) -> pa.RecordBatch | None:
            mask, key, fp_ = rows
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            group = np.cumsum(new)
            sizes = np.bincount(group)
            many = sizes[group] > 1
            if not many.any():
                return None
            kept = fp_[many]
            a, b = bucket_links(group[many], kept.view("<u8"))
            return pa.record_batch([pa.array(kept[a]), pa.array(kept[b])], ["a", "b"]) if len(a) else None

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in schema]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            mask, key, _ = rows
            # the last bucket may go on in the next batch
            cut = len(mask) - 1
            same = (mask == mask[cut]) & (key == key[cut]) if cut >= 0 else np.zeros(0, bool)
            first = int(np.flatnonzero(same)[0]) if same.any() else 0
            held = [x[first:] for x in rows]
            if first and (out := solve([x[:first] for x in rows])):
                yield out
        if held is not None and len(held[0]) and (out := solve(held)):
            yield out

    every = searched[0]
    for part in searched[1:]:
        every = every.unionByName(part)
    dealt = every.repartition("mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node that links reach, for every node of an edge."""
    edges = edges.where(F.col("a") != F.col("b"))
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        step = materialize(step)
        # a label is a node: take that node's label, with the one before as the limit
        above = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = step.join(above, step["root"] == above["_n"]).select(
            "node", "_r", (F.col("_r") != F.col("old")).cast("long").alias("changed")
        )
        jumped, moved = materialize_with(jumped, n=F.sum("changed"))
        labels = jumped.select("node", F.col("_r").alias("root"))
        if not moved["n"]:
            return labels


def grouped(table: DataFrame, fp: str = "fp", doc_id: str = "doc_id") -> DataFrame:
    """Each different fingerprint with its ``component_id``, the least id of its component, and its ``root``."""
    distinct = materialize(table.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    labels = components(materialize(links(distinct)))
    nodes = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    nodes = materialize(nodes)
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return nodes.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of each row."""
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = materialize(fingerprints(table))
    found = table.join(grouped(table).drop("root"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _Hashes(dict):
    """64-bit hash of each word, kept in a bounded table."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_HASHES = _Hashes()
_P, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, ROWS * BANDS, np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles_of(text: bytes) -> np.ndarray:
    """Hashes of the different shingles of ``NEAR`` words, ascending; one shingle for a text of fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(NEAR, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _P + w[k : len(w) - size + 1 + k]
    return np.unique(_mixed(h))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the least values of its ``ROWS`` orders of the shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _FACTORS).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * _P + column)
    return key


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``d``, the fingerprint ``fp``, a digest of the set of shingles, its size and its band keys; the text is dropped."""
    schema = docs.drop("text").schema.add("fp", "long").add("own", "binary").add("n", "long").add("keys", spark_type("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 32 << 20):
            fp, own, n, keys = [], [], [], []
            for t in text_bytes(batch.column("text")):
                fp.append(_signed(fingerprint_of(t)))
                found = shingles_of(t)
                own.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                n.append(len(found))
                keys.append(band_keys(found).view("<i8"))
            last = [pa.array(own, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            columns = [batch.column("doc_id"), batch.column("d"), pa.array(fp, pa.int64()), *last]
            yield pa.record_batch(columns, ["doc_id", "d", "fp", "own", "n", "keys"])

    return docs.select("doc_id", "d", "text").mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """``id`` and its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 16 << 20):
            found = [shingles_of(t).view("<i8") for t in text_bytes(batch.column("text"))]
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have a similarity of ``ALIKE`` or more, by all their shingles."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    up, down = ALIKE
    alike = both * (up + down) >= (F.size("_a") + F.size("_b")) * up
    return pairs.join(b, "b").join(a, "a").where(alike).select(*pairs.columns)


def _joined(labels: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``labels`` after the links among ``pairs`` (``a``, ``b`` and their labels ``ra``, ``rb``): only labels are linked."""
    pairs, size = materialize_with(pairs.distinct(), n=F.count("*"))
    if not size["n"]:
        return labels
    ends = _similar(pairs, sets).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    above = components(ends).select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    met = labels.join(above, F.col("root") == F.col("_old"), "left")
    return materialize(met.select("node", F.coalesce("_new", "root").alias("root")))


def _met(now: DataFrame, other: DataFrame, near: Column) -> DataFrame:
    """Pairs of rows of ``now`` and ``other`` (columns with ``lead_``) on one key with different labels."""
    met = now.join(other, "key").where((F.col("label") != F.col("lead_label")) & near)
    first = F.col("id") < F.col("lead_id")
    a = F.struct(F.col("id").alias("i"), F.col("label").alias("r"))
    b = F.struct(F.col("lead_id").alias("i"), F.col("lead_label").alias("r"))
    pairs = met.select(F.when(first, a).otherwise(b).alias("p"), F.when(first, b).otherwise(a).alias("q"))
    return pairs.select(*[F.col(f"{c}.{x}").alias(n) for n, c, x in (("a", "p", "i"), ("b", "q", "i"), ("ra", "p", "r"), ("rb", "q", "r"))])


def _prefixes(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """``ids`` (with all its columns) by its rarest shingles: ``key`` and their ``place`` in the order of rarity.

    Sets at ``ALIKE`` share one of the shingles that come first in any one order: no more than the share that may differ
    stands before it. Rarest first, near copies that differ too much share none of these.
    """
    up, down = ALIKE
    each = sets.join(ids.select("id"), "id").select("id", F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    # a shingle of one set alone meets nothing, but has its place before the others
    met = each.join(often, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("s"))
    held = ids.join(met, "id").withColumn("alone", F.col("n") - F.size("s"))
    held = held.select(*ids.columns, "alone", F.posexplode("s").alias("at", "s"))
    held = held.select(*ids.columns, (F.col("alone") + F.col("at")).alias("place"), F.col("s.key").alias("key"))
    return held.where((F.col("n") - F.col("place")) * down >= F.col("n") * up)


def similar_components(members: DataFrame, sets: DataFrame, stars: int = STARS, few: int = FEW) -> DataFrame:
    """``node``, ``root`` of all sets that verified links join, from ``key``, ``id``, ``n`` of buckets of two or more.

    A bucket is first compared as a star around one member. What is still apart in a bucket of ``few`` or less is then
    compared in pairs. Larger ones go on with other stars, and what these leave apart meets by its rarest shingles instead
    of its bucket (``_prefixes``): that misses no pair, and members with many shingles of their own meet few others. No pair
    of a bucket is left unjoined unless it was compared, a chain of links joins it, or its shingles rule it out.
    """
    up, down = ALIKE
    near = F.least("n", "lead_n") * down >= F.greatest("n", "lead_n") * up
    labels = materialize(members.select(F.col("id").alias("node"), F.col("id").alias("root")).distinct())
    lead_ = ("id", "n", "label")
    for turn in range(stars + 1):
        now = members.join(labels.select(F.col("node").alias("id"), F.col("root").alias("label")), "id")
        now = now.select("key", "id", "n", "label")
        chance = F.xxhash64("id", F.lit(turn))
        lead = [F.min_by(c, chance).alias(f"lead_{c}") for c in lead_]
        apart = now.groupBy("key").agg(F.count("*").alias("size"), F.countDistinct("label").alias("labels"), *lead)
        # the one pair of a bucket of two is compared in the first turn
        apart = apart.where((F.col("labels") > 1) & (F.col("size") > (2 if turn else 1))).drop("labels")
        apart, left = materialize_with(apart, n=F.count("*"), most=F.max("size"))
        if not left["n"]:
            return labels
        now = materialize(now.join(apart.select("key", "size"), "key"))
        members = now.select("key", "id", "n")
        crowded = apart.where(F.col("size") > few) if turn else apart
        pairs = [_met(now, crowded.drop("size"), near)] if turn < stars else []
        if turn:
            small = now.where(F.col("size") <= few)
            other = small.select("key", *[F.col(c).alias(f"lead_{c}") for c in lead_])
            pairs.append(_met(small, other, near & (F.col("id") < F.col("lead_id"))))
            members = now.where(F.col("size") > few).select("key", "id", "n")
        labels = _joined(labels, reduce(DataFrame.unionByName, pairs), sets) if pairs else labels
        if turn and left["most"] <= few:
            return labels
    return _by_rarest(members, labels, sets)


def _by_rarest(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """``labels`` after all links between members of the crowded buckets, which meet by their rarest shingles."""
    up, down = ALIKE
    labelled = labels.select(F.col("node").alias("id"), F.col("root").alias("label"))
    now = members.join(labelled, "id")
    # every pair that is still apart has a member outside the largest label of its bucket
    sizes = now.groupBy("key", "label").count().groupBy("key")
    largest = sizes.agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count("*").alias("labels"))
    now = now.join(largest.where("labels > 1").drop("labels"), "key")
    rest = F.max(F.col("label") != F.col("largest")).alias("rest")
    ids = materialize(now.groupBy("id", "n", "label").agg(rest))
    dealt = materialize(_prefixes(ids, sets))
    other = dealt.select("key", *[F.col(c).alias(f"lead_{c}") for c in ("id", "n", "label", "place", "rest")])
    # what may still be shared from the first shared shingle on
    enough = F.least(F.col("n") - F.col("place"), F.col("lead_n") - F.col("lead_place"))
    enough = enough * (up + down) >= (F.col("n") + F.col("lead_n")) * up
    once = ~F.col("lead_rest") | (F.col("id") < F.col("lead_id"))
    return _joined(labels, _met(dealt.where("rest"), other, enough & once), sets)


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of ids that the links between their fingerprints (``fps``) join: a star for each fingerprint, and
    the links between the first ids of different ones."""
    each = materialize(nodes.select("id", F.explode("fps").alias("fp")))
    first = materialize(each.groupBy("fp").agg(F.min("id").alias("i")))
    far = first.select(F.col("fp").alias("b"), F.col("i").alias("j"))
    across = links(first).join(first.withColumnRenamed("fp", "a"), "a").join(far, "b").select("i", "j")
    alike = each.join(first, "fp").select("i", F.col("id").alias("j"))
    pairs = across.unionByName(alike).where("i <> j")
    return materialize(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())


def _joined_by_fingerprints(labels: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``labels`` after the links among the pairs that fingerprints join, which may not have labels yet."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("root"))
    labels = materialize(labels.unionByName(new))
    a, b = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
    apart = pairs.join(a, "a").join(b, "b").where("ra <> rb").select("a", "b", "ra", "rb")
    return _joined(labels, apart, sets)


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each component stays, the least id (nulls last).

    Near duplicates have a similarity of ``ALIKE`` or more between their sets of shingles of ``NEAR`` words. Texts meet by the
    links between their fingerprints (``links``); since most pairs differ in more than ``BITS`` bits, also by their shingles. Equal sets are
    one from the start; others meet by several fingerprints a document (``BANDS`` keys of ``ROWS`` least values each), of
    which a pair at a similarity of 0.8 shares none with a chance of 7 in a million, and are linked only if all their
    shingles confirm it. Null and empty texts have the same empty set and are near duplicates of each other; a text of fewer
    words is one shingle. Long texts are read whole.

    The row that stays is found by id and text digest, so texts move once and are not written; of rows that agree in
    both, the one with the least hash of all columns stays.
    """
    d, nth = free_name(docs, "_digest"), free_name(docs, "_nth")
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_digest(text).alias("d"), F.col(f"`{text}`").alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "d")).alias("s")
    fps = F.collect_set("fp").alias("fps")  # equal sets of shingles in another order or number have other fingerprints
    nodes = _sketches(narrow).groupBy("own", "fp").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = nodes.groupBy("own").agg(F.min("s").alias("s"), F.first("n").alias("n"), F.first("keys").alias("keys"), fps)
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()))
    keyed = materialize(nodes.select("id", "n", F.explode("keys").alias("key")))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    members = materialize(keyed.join(shared, "key"))
    pairs = _fingerprint_pairs(nodes)
    met = members.select("id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    wanted = nodes.join(met, "id")
    wanted = wanted.select("id", F.col("s.doc_id").alias("_id"), F.col("s.d").alias("_d"))
    texts = narrow.join(wanted, (F.col("d") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = materialize(_sets(texts).dropDuplicates(["id"]))
    labels = similar_components(members, sets)
    labels = _joined_by_fingerprints(labels, pairs, sets)
    found = nodes.select("id", "s").join(labels, F.col("id") == F.col("node"), "left")
    stay = found.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("s").alias("s"))
    stay_id, stay_d = free_name(docs, "_stay_id"), free_name(docs, "_stay_d")
    stay = materialize(stay.select(F.col("s.doc_id").alias(stay_id), F.col("s.d").alias(stay_d)))
    rows = docs.withColumn(d, text_digest(text))
    same = (F.col(f"`{d}`") == F.col(stay_d)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(stay_id))
    alike = Window.partitionBy(d, doc_id).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    met = rows.join(stay, same, "left_semi").withColumn(nth, F.row_number().over(alike))
    return met.where(F.col(f"`{nth}`") == 1).drop(d, nth)
