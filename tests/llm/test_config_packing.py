import random
import zlib

import numpy as np
import pytest

from releaselens.llm import config_packing as c
from releaselens.llm.encoding import Encoder, vocabulary

NAME = "byte_bpe_50k.json"


def filled(plan, size, counts):
    got = np.zeros_like(counts)
    for config, n in plan:
        assert n > 0 and sum(l * a for l, a in config.items()) <= size
        for l, a in config.items():
            got[l] += a * n
    assert (got == counts).all()
    return sum(n for _, n in plan)


@pytest.mark.parametrize("kind", range(6))
def test_plan_is_whole_and_near_the_bound(kind):
    rng, size = np.random.default_rng(kind), 256
    lengths = [
        rng.integers(1, 257, 4000),
        rng.geometric(0.02, 4000).clip(1, 256),
        np.full(999, 129),
        np.full(999, 86),
        rng.choice([256, 128, 100, 28], 3000),
        np.zeros(0, int),
    ][kind]
    counts = np.bincount(lengths, minlength=size + 1)
    used = filled(c.solve(counts, size), size, counts)
    bound = max(-(-int(lengths.sum()) // size), int((lengths > size // 2).sum()))
    if kind == 3:
        bound = 500  # two of 86 fit
    assert used <= bound * 1.02 + 2


@pytest.mark.parametrize("kind", range(4))
def test_program_is_solved_to_its_tolerance(kind):
    rng, size = np.random.default_rng(kind), [24, 24, 20, 40][kind]
    lengths = [
        rng.integers(1, 25, 900),
        rng.integers(9, 25, 900),  # few fill a sequence: the bound by sizes is far below the optimum
        np.array([11] * 7 + [3]),
        rng.geometric(0.1, 5000).clip(1, 39),
    ][kind]
    counts = np.bincount(lengths, minlength=size + 1)
    found = c.covering(counts, size)
    assert found.gap <= c.TOLERANCE + 1e-9
    cover = np.zeros(size + 1)
    for config, often in found.often.items():
        assert often > 0 and sum(l * a for l, a in config) <= size
        for l, a in config:
            cover[l] += a * often
    assert (cover >= counts * (1 - 1e-9)).all()
    # The bound by duality: no configuration is worth more than 1 at the prices (best of each room by brute force).
    best = [0.0] * (size + 1)
    for room in range(1, size + 1):
        best[room] = max([best[room - 1]] + [best[room - l] + found.prices[l] for l in range(1, room + 1)])
    assert best[size] <= 1 + 1e-9 and found.bound == pytest.approx(float(found.prices @ counts))


def test_program_places_most_pieces():
    lengths = np.random.default_rng(5).lognormal(5.5, 1.0, 20_000).astype(int).clip(1, 2047)
    counts = np.bincount(lengths, minlength=2049)
    plan = c.program(counts, 2048)
    placed = sum(n * sum(a for _, a in config) for config, n in plan)
    assert placed >= 0.5 * len(lengths)
    used = filled(c.solve(counts), 2048, counts)
    assert used <= lengths.sum() / 2048 * 1.01 + 1


def test_classes_give_all_their_lengths():
    counts = np.zeros(65, np.int64)
    counts[[33, 34, 36]] = [5, 1, 4]
    plan = c.of_lengths([(((9, 1),), 3), (((9, 2),), 3)], counts, 4)
    got = np.zeros_like(counts)
    for config, n in plan:
        for l, a in config:
            got[l] += a * n
    assert (got[[33, 34, 36]] <= counts[[33, 34, 36]]).all() and got.sum() == 9 and got[[34, 36]].sum() == 5


def test_knapsack_against_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        size = rng.randrange(5, 30)
        prices = np.array([0.0] + [rng.random() * rng.randrange(2) for _ in range(size)])
        got = c.best_config(prices, size)
        best = [0.0] * (size + 1)
        for room in range(1, size + 1):
            best[room] = max([best[room - 1]] + [best[room - l] + prices[l] for l in range(1, room + 1)])
        assert sum(l * a for l, a in got.items()) <= size
        assert sum(prices[l] * a for l, a in got.items()) == pytest.approx(best[size])


def test_pieces_and_places_against_brute_force(spark, table):
    rng = random.Random(2)
    texts = [None, "", "a", "same words", "same words"]
    texts += [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([3, 20, 21, 90, 400]))) for _ in range(150)]
    ids = [*range(len(texts) - 2), 7, None]
    size = 64
    docs = table(texts, ids, clash=True)
    raw = c.pieces(docs, NAME, 0, size)
    rows = c.pack(raw, size, 50).collect()
    e, want = Encoder(vocabulary(NAME)), []
    for doc, text in zip(ids, texts):
        data = e.direct([text or ""])[0] + b"\0\0\0\0"
        n = len(data) // 4
        first = n if n <= size else n % size or size
        cuts = [0, *range(first, n + 1, size)]
        assert cuts[-1] == n
        want += [(doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[x] for x in names) for r in rows), key=str) == sorted(want, key=str)
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in inside.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    total = sum(x[3] for x in want)
    halves = sum(x[3] > size // 2 for x in want)
    assert len(inside) <= max(-(-total // size), halves) * 1.02 + 2


def test_sequences_hold_the_ids(spark, table):
    from releaselens.session import materialize

    raw = c.pieces(table(["a b c", "d e", "f " * 60]), NAME, 0, 32)
    raw = materialize(raw.repartition(1))
    packed = c.pack(raw, 32, 10)
    from pyspark.sql import functions as F

    keyed = raw.join(packed.select("doc_id", "piece", "row"), ["doc_id", "piece"])
    out = {r["sequence_id"]: bytes(r["ids"]) for r in c.sequences(packed, keyed).collect()}
    total = packed.agg(F.sum("length")).first()[0]
    assert sum(map(len, out.values())) == 4 * total and all(len(x) <= 128 for x in out.values())


def test_empty_table(table):
    assert c.pack(c.pieces(table(["a"]).limit(0), NAME, 0)).count() == 0
