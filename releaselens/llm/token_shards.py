"""Token ids in binary shards: static range asymmetric numeral system with one shared frequency table.

Layout of a shard file, all little-endian: ``MAGIC``, then sections of (length, crc32, bytes): header (JSON), document
table (ids and token counts), block table, blocks. A block holds up to ``BLOCK`` ids dealt over ``LANES`` coders that share
one stream of 32-bit words, and stands alone: its checkpoint (the coders' states), its place in the file and its checksum
are in the block table, so blocks are decoded in any order, in parallel, or only those that a range of ids needs.
The frequency table is written once beside the shards; shards carry its checksum.

A shard's size is bounded by ``shard_tokens`` plus one document. Files are written under a temporary name and renamed, so a
task that is run again replaces its own shard only. Null texts are empty: they hold the end id alone. Rows with
equal or null ids keep one place each (nulls first); an empty table gives no shards and an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from releaselens.llm.common import by_bytes
from releaselens.llm.encoding import encoder, vocabulary, vocabulary_size
from releaselens.session import materialize, scratch_path

MAGIC = b"RANS\x01\x00\x00\x00"
#: Frequencies add up to 2 ** SCALE; states stay in [2 ** 31, 2 ** 63).
SCALE, LOW = 22, 1 << 31
LANES, BLOCK = 4096, 1 << 19


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of all ids that occur, at least 1 each, that add up to 2 ** SCALE."""
    total, size = int(counts.sum()), 1 << SCALE
    seen = counts > 0
    if int(seen.sum()) > size:
        raise ValueError("more distinct ids than the frequency table has places")
    if not total:
        return np.zeros_like(counts)
    freq = np.where(seen, np.maximum(1, counts * size // total), 0)
    gap = size - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if gap > 0:
        freq[order[0]] += gap
    for i in order:  # what rounding up has taken comes back from the largest
        if gap >= 0:
            break
        give = min(int(freq[i]) - 1, -gap)
        freq[i] -= give
        gap += give
    return freq


class Coder:
    """Encodes and decodes blocks of ids with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._ids = None

    @property
    def ids(self) -> np.ndarray:
        """The id of each place in the frequency range."""
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._ids

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(states, words) of a block; the last row of lanes may be short."""
        lanes = min(LANES, max(1, len(ids)))
        state = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        f_all, c_all = self.freq[ids], self.cum[ids]
        if len(ids) and not f_all.all():
            raise ValueError("an id has no place in the frequency table")
        top = np.uint64(63 - SCALE)
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, c = f_all[at : at + lanes], c_all[at : at + lanes]
            x = state[: len(f)]
            full = x >= (f << top)
            if full.any():
                out.append(x[full].astype("<u4")[::-1])
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + c
        words = np.concatenate(out)[::-1] if out else np.zeros(0, "<u4")
        return state.astype("<u8").tobytes(), words.tobytes()

    def decode(self, states: bytes, words: bytes, n: int) -> np.ndarray:
        """The ids of a block."""
        state, stream = np.frombuffer(states, "<u8").astype(np.uint64), np.frombuffer(words, "<u4")
        lanes, at, out = len(state), 0, np.empty(n, np.uint32)
        mask = np.uint64((1 << SCALE) - 1)
        ids, freq, cum = self.ids, self.freq, self.cum
        for i in range(0, n, lanes):
            x = state[: min(lanes, n - i)]
            place = x & mask
            found = ids[place.astype(np.int64)]
            out[i : i + len(x)] = found
            x = freq[found] * (x >> np.uint64(SCALE)) + place - cum[found]
            low = x < LOW
            k = int(low.sum())
            if k:
                x[low] = (x[low] << np.uint64(32)) | stream[at : at + k].astype(np.uint64)
                at += k
            state[: len(x)] = x
        if at != len(stream) or (state != LOW).any():
            raise ValueError("a block does not end where it should")
        return out


def _section(data: bytes) -> bytes:
    return struct.pack("<QI", len(data), zlib.crc32(data)) + data


def _sections(data: bytes, at: int) -> Iterator[bytes]:
    while at < len(data):
        size, crc = struct.unpack_from("<QI", data, at)
        part = data[at + 12 : at + 12 + size]
        if zlib.crc32(part) != crc:
            raise ValueError("a section's checksum differs")
        yield part
        at += 12 + size


_BLOCK = np.dtype([("at", "<u8"), ("states", "<u4"), ("words", "<u4"), ("n", "<u4"), ("crc", "<u4")])
_DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u4")])


def shard_bytes(coder: Coder, table_crc: int, start: int, docs: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole shard file."""
    blocks, parts, at = [], [], 0
    for i in range(0, len(ids), BLOCK):
        states, words = coder.encode(ids[i : i + BLOCK])
        blocks.append((at, len(states), len(words), len(ids[i : i + BLOCK]), zlib.crc32(states + words)))
        parts.append(states + words)
        at += len(parts[-1])
    head = json.dumps({"scale": SCALE, "lanes": LANES, "table": table_crc, "start": start, "ids": len(ids)}).encode()
    body = [head, docs.tobytes(), np.array(blocks, _BLOCK).tobytes(), b"".join(parts)]
    return MAGIC + b"".join(map(_section, body))


def read_shard(coder: Coder, table_crc: int, data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(start, documents, ids) of a shard file; raises where a checksum differs."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard")
    head, docs, blocks, body = _sections(data, len(MAGIC))
    head = json.loads(head)
    if head["table"] != table_crc or head["scale"] != SCALE:
        raise ValueError("the shard was written with another frequency table")
    ids = [decode_block(coder, body, b) for b in np.frombuffer(blocks, _BLOCK)]
    return head["start"], np.frombuffer(docs, _DOC), np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def decode_block(coder: Coder, body: bytes, block: np.void) -> np.ndarray:
    """One block by its entry in the block table, whatever came before it."""
    at, cut = int(block["at"]), int(block["at"]) + int(block["states"])
    states, words = body[at:cut], body[cut : cut + int(block["words"])]
    if zlib.crc32(states + words) != int(block["crc"]):
        raise ValueError("a block's checksum differs")
    return coder.decode(states, words, int(block["n"]))


def decode_range(coder: Coder, data: bytes, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a shard; only the blocks that hold them are decoded."""
    _, _, blocks, body = _sections(data, len(MAGIC))
    table = np.frombuffer(blocks, _BLOCK)
    ends = np.cumsum(table["n"].astype(np.int64))
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last)
    if first >= last or a >= len(table):
        return np.zeros(0, np.uint32)
    ids = np.concatenate([decode_block(coder, body, x) for x in table[a : b + 1]])
    skipped = int(ends[a] - table["n"][a])
    return ids[first - skipped : last - skipped]


def _put(path: str, data: bytes) -> None:
    """Write under a temporary name, then rename: a reader never sees part of a file, a second run replaces it."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    folder = at.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, at)


def ordered_tokens(
    docs: DataFrame, vocab: str, end_id: int | None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Ids of each whole text with the end id, written in ascending order of ``doc_id``.

    Texts are dealt by ranges of ``doc_id`` (nulls first; ties by hash) and encoded behind that one shuffle, so ids never
    move. Columns: ``part``, ``at`` (number of the row in its part), ``before`` (ids before it in its part), ``doc_id``,
    ``n_tokens`` and ``ids`` (little-endian, two bytes each where the vocabulary allows, else four).
    """
    path, kind = vocabulary(vocab), id_kind(vocabulary_size(vocab))
    end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, at, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in by_bytes(batches, "text", 8 << 20):
            ids = [np.frombuffer(code.encode(t) + end, "<u4") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            columns = [
                pa.array(np.full(len(n), part, np.int64)),
                pa.array(np.arange(at, at + len(n))),
                pa.array(before + np.cumsum(n) - n),
                batch.column("doc_id"),
                pa.array(n),
                pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()),
            ]
            at, before = at + len(n), before + int(n.sum())
            yield pa.record_batch(columns, ["part", "at", "before", "doc_id", "n_tokens", "ids"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, "part long, at long, before long, doc_id long, n_tokens long, ids binary"))


def id_kind(size: int) -> str:
    """How the ids of a vocabulary of ``size`` entries are kept between the two passes."""
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(table: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the column ``ids``: one row for each id and task is shuffled."""
    kind = id_kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in by_bytes(batches, "ids", 8 << 20):
            joined = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(joined, kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    found = table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for row in found:  # one row for each entry of the vocabulary at most
        out[row["id"]] = row["n"]
    return out


def write_shards(
    docs: DataFrame, vocab: str, end_id: int | None, path: str | None = None, shard_tokens: int = 4 << 20
) -> str:
    """Encode ``docs`` and write their ids in ascending order of ``doc_id``; returns the folder.

    Only texts are shuffled. The ids lie in order in their parts; the parts' totals (one row each) give every document its
    ``start``, and each task codes the rows that it reads in place. A shard is a stretch of successive rows of one part,
    named by part and row, so a task that runs again writes the same files.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark)
    size = vocabulary_size(vocab)
    kind = id_kind(size)
    table = ordered_tokens(docs, vocab, end_id)
    freq = normalised(id_counts(table, size))
    crc = zlib.crc32(freq.astype("<u4").tobytes())
    _put(f"{path}/table/freq.bin", freq.astype("<u4").tobytes())
    _put(f"{path}/shards/_README", b"Shards of token ids; see freq.bin beside this folder.\n")

    starts, total = {}, 0
    for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each part
        starts[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, first, next_, size_ = Coder(freq), [], None, None, 0

        def close() -> pa.RecordBatch:
            docs_ = np.array([(d or 0, d is None, n) for d, n, _ in held], _DOC)
            ids = np.frombuffer(b"".join(b for _, _, b in held), kind).astype(np.uint32)
            part, at, before = first
            data = shard_bytes(coder, crc, starts[part] + before, docs_, ids)
            _put(f"{path}/shards/shard-{part:06d}-{at:012d}.rans", data)
            return pa.record_batch([pa.array([len(data)], pa.int64())], ["bytes"])

        for batch in by_bytes(batches, "ids", 8 << 20):
            columns = [batch.column(c).to_pylist() for c in ("part", "at", "before", "doc_id", "n_tokens", "ids")]
            for part, at, before, doc, n, ids in zip(*columns):
                if held and ((part, at) != next_ or size_ >= shard_tokens):
                    yield close()
                    held, size_ = [], 0
                if not held:
                    first = (part, at, before)
                held.append((doc, n, ids))
                next_, size_ = (part, at + 1), size_ + n
        if held:
            yield close()

    table.mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written shards: ``doc_id``, ``start``, ``n_tokens``, ``ids``; checksums are verified."""
    table = spark.read.format("binaryFile").load(f"{path}/table/freq.bin").select("content").first()["content"]
    freq, crc = np.frombuffer(bytes(table), "<u4"), zlib.crc32(bytes(table))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rans").load(f"{path}/shards").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for data in batch.column("content"):
                start, docs, ids = read_shard(coder, crc, data.as_py())
                ends = np.cumsum(docs["n"].astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                for i in range(0, len(docs), 4096):
                    part, end = docs[i : i + 4096], ends[i : i + 4096]
                    begin = end - part["n"]
                    yield pa.record_batch(
                        [
                            pa.array(part["doc"], mask=part["null"].astype(bool)),
                            pa.array(begin + start),
                            pa.array(part["n"].astype(np.int64)),
                            pa.array([raw[4 * a : 4 * b] for a, b in zip(begin, end)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
