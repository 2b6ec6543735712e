import random

import numpy as np
import pytest
import xxhash

from releaselens.llm import simhash_pivots as p


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_against_brute_force(table):
    rng = random.Random(1)
    texts = [None, "", " \n", "A", "a b", "A  B c", "a b C d É"]
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(20, 200))) for _ in range(40)]
    texts += base
    for t in base[:30]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    ids = rng.sample(range(1000), len(texts))
    fps = [brute_fp(t) for t in texts]
    rows = {r["doc_id"]: r for r in p.near_duplicates(table(texts, ids, clash=True)).collect()}
    want = brute_components(ids, fps)
    assert len(rows) == len(texts) and len(set(want)) < len(texts) - 20
    for d, f, c in zip(ids, fps, want):
        assert (rows[d]["fingerprint"], rows[d]["component_id"]) == (f"{f:016x}", c)


@pytest.mark.parametrize("hot", [p.HOT, 3])
def test_links_are_whole_in_crowded_buckets(spark, hot):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 64, 6, np.uint64)
    fps = {int(c) for c in centres} | {int(x) for x in rng.integers(0, 1 << 64, 300, np.uint64)}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(p._signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in p.components(p.links(df, hot=hot)).collect()}
    signed = [p._signed(f) for f in fps]
    want = brute_components(signed, fps)
    assert [got.get(f, f) for f in signed] == want


def test_long_chains(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in p.components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_keep_one_row_of_each_group(table):
    t = " ".join(f"w{i}" for i in range(300))
    df = table([t, t, t + " x", None, "", "other words here"], [5, 5, None, None, 8, 9], clash=True)
    out = p.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [5, 8, 9]
    assert p.keep_one(df.limit(0)).count() == 0
    assert p.near_duplicates(df.limit(0)).count() == 0


def brute_survivors(ids, texts):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) * 5 >= len(a | b) * 4:
                root[find(i)] = find(j)
                links += a != b
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values()), links


@pytest.mark.parametrize("stars, few", [(0, p.FEW), (1, 1), (p.STARS, 3), (p.STARS, p.FEW)])
def test_keep_one_against_brute_force_jaccard(table, monkeypatch, stars, few):
    rng = random.Random(5)
    texts = [None, "", "a", "a", "a b c d", "a b c d e"]
    for group in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(60 if group < 2 else rng.randrange(8)):  # edits of 0 to 4 per cent: similarities around 0.8, chains and near misses
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randrange(max(2, len(w) // 25))):
                w[at] = "new"
            texts.append(" ".join(w))
    ids = rng.sample(range(1000), len(texts))
    want, links = brute_survivors(ids, texts)
    assert links > 100
    whole = p.similar_components
    monkeypatch.setattr(p, "similar_components", lambda m, s: whole(m, s, stars, few))
    assert {r["doc_id"] for r in p.keep_one(table(texts, ids, clash=True)).collect()} == want


def test_keep_one_joins_what_fingerprints_link_and_shingles_confirm(spark, table, monkeypatch):
    # without the keys of the shingles
    monkeypatch.setattr(p, "similar_components", lambda m, s: spark.createDataFrame([], "node long, root long"))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    close = [rng.choice(base) for _ in range(3000)]
    texts = [" ".join(close), " ".join([*close[:-1], "new"]), " ".join([*close, "more"])]
    # few different shingles and one passage many times over: fingerprints agree, sets do not
    texts += [" ".join(base[:3] * 400 + [f"u{k}x{j}" for j in range(20)]) for k in range(4)]
    texts += [" ".join(rng.sample(base, 200)) for _ in range(5)] + [None, ""]
    ids = rng.sample(range(100), len(texts))
    linked = set(brute_components(ids, [brute_fp(t) for t in texts]))
    want, _ = brute_survivors(ids, texts)
    assert len(linked) == 1 + 1 + 5 + 1 and want == linked | set(ids[3:7])
    assert {r["doc_id"] for r in p.keep_one(table(texts, ids, clash=True)).collect()} == want


def test_crowded_buckets_do_not_meet_pair_by_pair(spark, table, monkeypatch):
    rng, rows, whole = random.Random(8), [], p.materialize_with

    def seen(df, *args, **metrics):
        out = whole(df, *args, **metrics)
        rows.append(out[1]["n"] if df.columns == ["a", "b", "ra", "rb"] else 0)
        return out

    monkeypatch.setattr(p, "materialize_with", seen)
    base, made = [f"w{i}" for i in range(150)], {}
    for n in (150, 600):
        rows.clear()
        texts = []
        for k in range(n):  # near copies of one text, each with five words of its own
            w = list(base)
            for j, at in enumerate(rng.sample(range(150), 5)):
                w[at] = f"own{n}x{k}x{j}"
            texts.append(" ".join(w))
        p.keep_one(table(texts)).count()
        made[n] = sum(rows)
    assert made[600] < 6 * made[150]
