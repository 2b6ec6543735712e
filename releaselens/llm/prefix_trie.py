"""Prefix trie of conversations: every distinct sequence of first turns is a node, aggregated over its subtree.

A turn is the pair of role and text, told apart by 120 bits of its SHA-256; a conversation is the array of its turn ids.
Conversations are range-partitioned by that array and their id, so a crowded prefix spans as many shards as its share.
A shard holds a bounded number of conversations: its turns become a matrix of dense ids, padded on the right, which
``numpy.lexsort`` puts in order. Where a row differs from the one before it in a column, it does so in all later ones
(the change mask, OR-accumulated along the row), and each such place starts a node; ``reduceat`` between starts sums every
depth. Only nodes on the paths of a shard's first and last row can reach into other shards: these come out as
parts under a digest of their path and recombine by sums, with corrections from the common prefix of neighbouring shards.
The lists of conversations that end at such a node are hashed in pieces, in order, by one streaming pass per node.

Matrices are ``width`` turns wide. Conversations that go on below a node of that depth are taken up again there, in a
wider matrix under the node's smallest member, if several of them do; a conversation that is alone below it has a
chain of nodes that its turns give directly. So a row never holds more than a matrix' width of turns. The deepest
matrices are summed first, and their totals enter the matrices above with the row of the smallest member.

Turns are ordered by number, null first, and by their ids where numbers are equal; each row is a turn, repeated or not. A
null role or text is empty. Turns without a conversation id belong to no conversation. Other columns are not read. An
empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from releaselens.llm.common import WORD, spark_type
from releaselens.operators.ordering import with_position
from releaselens.session import materialize

#: Turns of the first matrices, the factor by which deeper ones are wider, the widest, and the cells of a matrix.
WIDTH, WIDER, WIDEST, CELLS = 32, 4, 8192, 1 << 20
#: Ids of a piece of a split list.
PIECE = 2000
NOTHING = hashlib.sha256(b"").hexdigest()
SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


@dataclass(frozen=True)
class Shape:
    width: int = WIDTH
    cells: int = CELLS
    widest: int = WIDEST

    def rows(self, width: int) -> int:
        """Conversations of a shard."""
        return max(1, self.cells // (width + 1))

    def wider(self, width: int) -> int:
        return min(width * WIDER, max(width, self.widest))


# ---------------------------------------------------------------------------------------------- turns


def turns(table: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), the turn's id as two longs ``x`` and ``y``, and ``words`` of its text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    spelt = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.sha2(spelt, 256).alias("h"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )

    def bits(first: int) -> Column:
        return F.conv(F.substring("h", first, 15), 16, 10).cast("long")

    rows = rows.select("conv_id", "turn", bits(1).alias("x"), bits(16).alias("y"), "words")
    return with_position(rows, ["turn", "x", "y"], ["conv_id"]).drop("turn")


def _listed(turns_at: Column) -> list[Column]:
    """``ids`` and ``words`` of an ordered array of turns."""
    ids = F.flatten(F.transform(turns_at, lambda t: F.array(t["x"], t["y"])))
    return [ids.alias("ids"), F.transform(turns_at, lambda t: t["words"]).alias("words")]


def sequences(turn_rows: DataFrame, width: int, rebuild: bool) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first ``width + 1`` turns, and the turns of those that are longer than ``width``.

    The first table has ``conv_id``, ``length``, ``ids`` and ``words``; the second ``conv_id``, ``depth``, ``x``, ``y``, ``words``. If
    ``rebuild``, the first h turns of a conversation c are those of conversation c - c % 20 (its first h, none if there is no
    such conversation), where h is the crc32 of the decimal c modulo 4; remainders have the sign of the id.
    """
    if width < 3:
        raise ValueError("the turns that conversations share must fit into the first matrix")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 if rebuild else F.lit(0).cast("long")
    turn_rows = turn_rows.withColumn("h", h)
    later = F.col("pos") - F.col("h")
    own = turn_rows.groupBy("conv_id", "h").agg(
        F.count("*").alias("n_own"),
        F.collect_list(F.when(later.between(1, width + 1), F.struct(later.alias("at"), "x", "y", "words"))).alias("tail"),
        F.collect_list(
            F.when((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3), F.struct(F.col("pos").alias("at"), "x", "y", "words"))
        ).alias("head"),
    )
    own = materialize(own)
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("_base"), F.array_sort("head").alias("_head"))
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("_base"), "left")
    # a slice of what is there: without the other conversation nothing
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("h").cast("int")), F.slice("head", 1, 0))
    n_head, all_turns = F.size(head).cast("long"), F.slice(F.concat(head, F.array_sort("tail")), 1, width + 1)
    convs = materialize(
        met.select(
            "conv_id",
            (n_head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"),
            n_head.alias("n_head"),
            *_listed(all_turns),
        )
    )
    shifts = convs.where(F.col("length") > width).select(F.col("conv_id").alias("_conv"), "n_head")
    later_rows = turn_rows.where(later > 0).join(shifts, F.col("conv_id") == F.col("_conv"))
    return convs, later_rows.select("conv_id", (F.col("n_head") + later).alias("depth"), "x", "y", "words")


# ---------------------------------------------------------------------------------------------- one shard


def dense(pairs: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Matrix of turn ids, one row of each conversation, as dense numbers in the same order, padded with -1."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(pairs), np.int64)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]).any(axis=1)
    number = np.empty(len(pairs), np.int64)
    number[order] = np.cumsum(new) - 1
    out = np.full((len(sizes), width), -1, np.int64)
    out[np.arange(width) < sizes[:, None]] = number
    return out


def path_keys(group: int, first: int, pairs: np.ndarray) -> list[bytes]:
    """A digest for each node of a path, from the node of the group on."""
    h = hashlib.sha256(f"{first}:{group}".encode())
    out = [h.digest()]
    for turn in pairs:
        h.update(turn.tobytes())
        out.append(h.digest())
    return out


def joined(conv: np.ndarray) -> str:
    return ",".join(map(str, conv.tolist()))


@dataclass
class Rows:
    """Conversations of a shard: turns as pairs of longs laid end to end, and totals from deeper matrices."""

    group: np.ndarray
    conv: np.ndarray
    sizes: np.ndarray
    pairs: np.ndarray
    words: np.ndarray
    more_leaves: np.ndarray
    more_saved: np.ndarray


def shard_nodes(rows: Rows, first: int, width: int) -> tuple[dict[str, list], dict, list[dict]]:
    """Columns of a shard's nodes, its first and last path, and pieces of the lists of conversations that end there.

    ``first`` is the depth of the groups' nodes. Turns past ``width`` only tell children from ends.
    """
    n, columns = len(rows.conv), min(width + 1, int(rows.sizes.max()))
    m = dense(rows.pairs, rows.sizes, columns)
    words = np.zeros((n, columns), np.int64)
    words[m >= 0] = rows.words
    order = np.lexsort((rows.conv, *m.T[::-1], rows.group))
    m, words, length = m[order], words[order], rows.sizes[order]
    group, conv = rows.group[order], rows.conv[order]
    begins = (np.cumsum(rows.sizes) - rows.sizes)[order]
    paths = [rows.pairs[begins[i] : begins[i] + length[i]] for i in (0, n - 1)]
    keys = [path_keys(int(group[i]), first, path) for i, path in zip((0, n - 1), paths)]

    # a row that differs from the one before it in a column does so in all later ones
    change = np.ones((n, columns + 1), bool)
    change[1:, 0] = group[1:] != group[:-1]
    change[1:, 1:] = m[1:] != m[:-1]
    change = np.logical_or.accumulate(change, axis=1)
    # turns in common with the row before it; -1 if not even the group is. What the first row has in common is not known here.
    common = np.minimum((~change).sum(axis=1) - 1, length)
    ended = length <= width
    leaf, saved = rows.more_leaves[order], rows.more_saved[order]
    leaf[:-1] += (common[1:] < length[:-1]) & ended[:-1]  # nor whether anything follows on the last one

    # equal rows end at one node, which starts with them
    same = np.flatnonzero(change[:, -1] | np.append(True, length[1:] != length[:-1]))
    ends, pieces = {}, []
    for a, b in zip(same.tolist(), np.append(same[1:], n).tolist()):
        if a and b < n:
            ends[a] = hashlib.sha256(joined(conv[a:b]).encode()).hexdigest()
        elif ended[a]:
            key = keys[0][length[a]] if a == 0 else keys[1][length[a]]
            pieces += [{"key": key, "at": k, "ids": joined(conv[k : min(b, k + PIECE)])} for k in range(a, b, PIECE)]

    levels = []
    for d in range(min(columns, width), -1, -1):
        if d:
            saved = saved + np.where(common >= d, words[:, d - 1], 0)
        starts = np.flatnonzero(change[:, d])
        children = change[:, d + 1] & (length > d) if d < columns else np.zeros(n, bool)
        sums = {
            "n_convs": np.diff(np.append(starts, n)),
            "n_children": np.add.reduceat(children.astype(np.int64), starts),
            "n_leaves": np.add.reduceat(leaf, starts),
            "saved_tokens": np.add.reduceat(saved, starts),
        }
        levels.append((d, starts, np.minimum.reduceat(conv, starts), sums))

    out: dict[str, list] = {k: [] for k in ("key", "parent_key", "conv_id", "parent_conv_id", "depth", "grp", "ends", *SUMS)}
    above = None
    for d, starts, least, sums in reversed(levels):
        last = len(starts) - 1
        real = np.flatnonzero(length[starts] >= d).tolist()
        out["key"] += [keys[0][d] if i == 0 else keys[1][d] if i == last else None for i in real]
        if above is None:
            out["parent_key"] += [None] * len(real)
            out["parent_conv_id"] += [None] * len(real)
        else:
            up = (np.searchsorted(above[0], starts[real], "right") - 1).tolist()
            end = len(above[0]) - 1
            out["parent_key"] += [keys[0][d - 1] if i == 0 else keys[1][d - 1] if i == end else None for i in up]
            out["parent_conv_id"] += above[1][up].tolist()
        out["conv_id"] += least[real].tolist()
        out["depth"] += [first + d] * len(real)
        out["grp"] += group[starts[real]].tolist()
        out["ends"] += [ends.get(s) if size == d else None for s, size in zip(starts[real].tolist(), length[starts[real]].tolist())]
        for k in SUMS:
            out[k] += sums[k][real].tolist()
        above = starts, least
    edge = {
        "groups": group[[0, n - 1]].tolist(),
        "first_ids": paths[0].ravel().tolist(),
        "last_ids": paths[1].ravel().tolist(),
        "first_words": words[0, : length[0]].tolist(),
        "first_keys": keys[0],
        "last_keys": keys[1],
    }
    return out, edge, pieces


# ---------------------------------------------------------------------------------------------- all shards

_NODE = (
    "shard long, key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, grp long, ends string,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long"
)
_EDGE = (
    "struct<groups:array<long>,first_ids:array<long>,last_ids:array<long>,first_words:array<long>,"
    "first_keys:array<binary>,last_keys:array<binary>>"
)
_SCHEMA = f"{_NODE}, edge {_EDGE}, piece struct<key:binary,at:long,ids:string>"
_CORRECTION = "key binary, n_children long, n_leaves long, saved_tokens long"


def _shards(rows: DataFrame, first: int, width: int, n_shards: int) -> DataFrame:
    """Nodes, edges and pieces of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, found = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()

        def flat(name: str) -> np.ndarray:
            column = table.column(name).combine_chunks()
            return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)

        sizes = np.diff(table.column("words").combine_chunks().offsets.to_numpy())
        more = [flat(k).astype(np.int64) for k in ("more_leaves", "more_saved")]
        rows_here = Rows(flat("grp"), flat("conv_id"), sizes.astype(np.int64), flat("ids").reshape(-1, 2), flat("words"), *more)
        nodes, edge, pieces = shard_nodes(rows_here, first, width)
        n = len(nodes["depth"])
        kinds = arrow_schema
        for a in range(0, n, 10_000):
            part = {k: v[a : a + 10_000] for k, v in nodes.items()}
            size = len(part["depth"])
            part |= {"shard": [shard] * size, "edge": [None] * size, "piece": [None] * size}
            yield pa.RecordBatch.from_pydict({k.name: part[k.name] for k in kinds}, kinds)
        for extra in [{"edge": edge}, *[{"piece": p} for p in pieces]]:
            yield pa.RecordBatch.from_pylist([{"shard": shard, **extra}], kinds)

    arrow_schema = to_arrow_schema(spark_type(_SCHEMA))
    dealt = rows.repartitionByRange(n_shards, "grp", "ids", "conv_id")
    return dealt.select("grp", "conv_id", "ids", "words", "more_leaves", "more_saved").mapInArrow(run, _SCHEMA)


def _corrections(edges: DataFrame, width: int) -> DataFrame:
    """What the nodes on the shards' outer paths count twice or miss, from the turns that neighbours have in common.

    One row a shard, and of it the two outer paths only, go through the window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("shard")
    near = F.struct(F.get("edge.groups", F.lit(1)).alias("grp"), F.col("edge.last_ids").alias("ids"))
    after = F.struct(F.get("edge.groups", F.lit(0)).alias("grp"), F.col("edge.first_ids").alias("ids"))
    met = edges.select("edge", F.lag(near).over(order).alias("before"), F.lead(after).over(order).alias("after"))

    def shared(group: int, ids: list, other: dict | None) -> int:
        if other is None or other["grp"] != group:
            return -1
        same = next((i for i, (a, b) in enumerate(zip(ids, other["ids"])) if a != b), min(len(ids), len(other["ids"])))
        return same // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                edge, out = row["edge"], []
                again = shared(edge["groups"][0], edge["first_ids"], row["before"])
                saved = 0
                for d in range(again, -1, -1):
                    if d > width:
                        continue
                    saved += edge["first_words"][d - 1] if d else 0
                    out.append((edge["first_keys"][d], -int(d < again), 0, saved))
                size = len(edge["last_ids"]) // 2
                if size <= width and shared(edge["groups"][1], edge["last_ids"], row["after"]) < size:
                    out += [(edge["last_keys"][d], 0, 1, 0) for d in range(size + 1)]
                if out:
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                    yield pa.record_batch(columns, ["key", "n_children", "n_leaves", "saved_tokens"])

    return met.mapInArrow(run, _CORRECTION)


def _hashed(pieces: DataFrame) -> DataFrame:
    """``key``, ``hashed``: the digest of each list whose pieces lie in several shards, read in order and never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, h = None, None

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([held], pa.binary()), pa.array([h.hexdigest()])], ["key", "hashed"])

        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == held:
                    h.update(b"," + ids.encode())
                    continue
                if held is not None:
                    yield out()
                held, h = key, hashlib.sha256(ids.encode())
        if held is not None:
            yield out()

    ordered = pieces.select("shard", "piece.*").repartition("key").sortWithinPartitions("key", "shard", "at")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, hashed string")


def _matrix_nodes(rows: DataFrame, first: int, width: int, shape: Shape) -> DataFrame:
    """All nodes of depths ``first`` to ``first + width`` below the groups, with ``grp``."""
    n_shards = -(-rows.count() // shape.rows(width)) or 1
    out = materialize(_shards(rows, first, width, n_shards))
    parts = out.where("key is not null")
    summed = parts.select("key", "parent_key", "conv_id", "depth", "grp", "ends", *SUMS).unionByName(
        _corrections(out.where("edge is not null"), width), allowMissingColumns=True
    )
    totals = summed.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max("grp").alias("grp"),
        F.max("ends").alias("ends"),
        *[F.sum(k).alias(k) for k in SUMS],
    )
    hashed = _hashed(out.where("piece is not null")).withColumnRenamed("key", "_key")
    totals = totals.join(hashed, F.col("key") == F.col("_key"), "left").withColumn("ends", F.coalesce("ends", "hashed"))
    totals = materialize(totals.drop("_key", "hashed"))
    names = ["grp", "conv_id", "depth", "parent_conv_id", *SUMS, "ends"]
    tops = totals.select(F.col("key").alias("_key"), F.col("conv_id").alias("parent_conv_id"))
    outer = totals.join(tops, F.col("parent_key") == F.col("_key"), "left").select(*names)
    # a parent that reaches into other shards: asked for shard by shard, so no parent is one crowded key
    inner = out.where("key is null and depth is not null")
    known = parts.select(F.col("shard").alias("_shard"), F.col("key").alias("_part")).join(tops, F.col("_part") == F.col("_key"))
    asked = inner.where("parent_key is not null").drop("parent_conv_id")
    told = asked.join(known, (F.col("shard") == F.col("_shard")) & (F.col("parent_key") == F.col("_part")))
    parts_of_all = [inner.where("parent_key is null").select(*names), told.select(*names), outer]
    return parts_of_all[0].unionByName(parts_of_all[1]).unionByName(parts_of_all[2])


def nodes(table: DataFrame, rebuild: bool = True, shape: Shape = Shape()) -> DataFrame:
    """One row of each node of the trie of ``table`` (conv_id, turn, role, text); see the module for its columns.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (of the node above; null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree: words of each node's last turn
    times members but one), ``ends_sha256`` (of the ids of the members that end here, ascending, joined by commas).
    """
    width, first = shape.width, 0
    convs, later = sequences(materialize(turns(table)), width, rebuild)
    lengths = convs.select(F.col("conv_id").alias("_conv"), "length")
    rows = convs.select(F.lit(0).cast("long").alias("grp"), "conv_id", "ids", "words")
    blocks = []
    while True:
        # conversations that reach the last depth of the matrix, by their node there
        spelt = F.sha2(F.array_join(F.slice("ids", 1, 2 * width), ","), 256)
        deep = rows.where(F.size("words") >= width).select("grp", "conv_id", spelt.alias("at"), (F.size("words") > width).alias("on"))
        met = deep.groupBy("grp", "at").agg(F.min("conv_id").alias("least"), F.count_if("on").alias("n_on"))
        met = met.where("n_on > 0").select(F.col("grp").alias("_grp"), F.col("at").alias("_at"), "least", "n_on")
        going = deep.where("on").join(met, (F.col("grp") == F.col("_grp")) & (F.col("at") == F.col("_at")))
        going = materialize(going.select(F.col("conv_id").alias("_conv"), "least", "n_on"))
        blocks.append((rows, first, width, going))
        first += width
        several = going.where("n_on > 1")
        if several.isEmpty():
            break
        width = shape.wider(width)
        own = later.where(F.col("depth").between(first + 1, first + width + 1))
        own = own.join(several, F.col("conv_id") == F.col("_conv")).groupBy("least", "conv_id")
        own = own.agg(F.array_sort(F.collect_list(F.struct("depth", "x", "y", "words"))).alias("own"))
        rows = materialize(own.select(F.col("least").alias("grp"), "conv_id", *_listed(F.col("own"))))

    found, below = [], None
    for rows, first, width, going in reversed(blocks):
        alone = going.where("n_on = 1")
        more = alone.select(F.col("least").alias("_least"), F.lit(1).cast("long").alias("more_leaves"), F.lit(0).cast("long").alias("more_saved"))
        more = more.unionByName(below) if below is not None else more
        met = rows.join(more, F.col("conv_id") == F.col("_least"), "left").drop("_least")
        part = materialize(_matrix_nodes(met.fillna(0, ["more_leaves", "more_saved"]), first, width, shape))
        below = part.where(F.col("depth") == first).select(
            F.col("grp").alias("_least"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")
        )
        if first:
            part = part.where(F.col("depth") > first).withColumn(
                "parent_conv_id", F.when(F.col("depth") == first + 1, F.col("grp")).otherwise(F.col("parent_conv_id"))
            )
        found.append(part.drop("grp"))
        # below the matrix a conversation that is alone there is a chain of its turns
        chain = later.join(alone.join(lengths, "_conv"), F.col("conv_id") == F.col("_conv")).where(F.col("depth") > first + width)
        found.append(
            chain.select(
                "conv_id",
                "depth",
                F.when(F.col("depth") == first + width + 1, F.col("least")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                F.lit(1).cast("long").alias("n_convs"),
                (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
                F.lit(1).cast("long").alias("n_leaves"),
                F.lit(0).cast("long").alias("saved_tokens"),
                F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).alias("ends"),
            )
        )
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")
