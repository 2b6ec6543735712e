import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from releaselens.llm import prefix_trie as s

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    h = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return (turn is not None, turn or 0, h[:30])


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for r in sorted([r for r in rows if r[0] is not None], key=turn_order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        convs[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        cost = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += cost
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), up, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in df.select(*names).collect()], key=repr)


def corpus(seed, convs=150, spread=3, longest=8):
    """Few different turns, so that prefixes are shared at all depths, groups of copies, and some long conversations."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(2 * convs), convs):
        n = rng.randrange(1, longest) if rng.random() < 0.9 else rng.randrange(1, 5 * longest)
        kind = rng.random()
        for t in range(n):
            text = f"turn {t}" if kind < 0.3 else " ".join(rng.choice("ab c") for _ in range(rng.randrange(1, spread)))
            rows.append((c, t, rng.choice(["user", "assistant"]) if kind > 0.8 else "user", text))
    rng.shuffle(rows)
    return rows


SHAPES = [s.Shape(), s.Shape(3, 4, 3), s.Shape(3, 40, 6), s.Shape(4, 200, 16), s.Shape(32, 33 * 20)]


@pytest.mark.parametrize("shape, rebuild", [*[(shape, True) for shape in SHAPES[:4]], (SHAPES[4], False)])
def test_nodes_against_brute_force(spark, shape, rebuild):
    rows = corpus(shape.cells + rebuild)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit("x") for k in ("pos", "ids", "words", "depth", "h", "grp")})
    assert got(s.nodes(table, rebuild, shape)) == brute(rows, rebuild)


@pytest.mark.parametrize("shape", [s.Shape(), s.Shape(3, 12, 3)])
def test_nulls_ties_repeated_rows_and_long_chains(spark, shape):
    rows = [(40, None, None, None), (40, None, "user", "x"), (40, 1, None, "y"), (None, 0, "user", "gone")]
    rows += [(41, 0, "user", "same"), (41, 0, "user", "same"), (41, 0, "user", "other"), (41, 0, None, "same")]
    rows += [(c, t, "u", f"copy {t}\v\f of it") for c in range(60, 80) for t in range(5)]
    rows += [(c, t, "u", f"long {t}") for c in (101, 102, 110) for t in range(60 + c % 3)]
    rows += [(103, 0, "", ""), (104, 0, None, None), (7, 0, "u", "a very long text " * 20_000), (-21, 0, "u", "negative"), (-20, 0, "u", "base")]
    if shape.cells < 100:
        rows = [r for r in rows if r[1] is None or r[1] < 15]
    assert got(s.nodes(spark.createDataFrame(rows, SCHEMA), shape=shape)) == brute(rows)


def test_conversations_without_turns(spark):
    # crc32("5") % 4 > 0 and crc32("45") % 4 > 0, and conversations 0 and 40 are not there
    turnless = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4][:5]
    rows = [(c, 0, "user", "hello") for c in turnless]
    (root,) = got(s.nodes(spark.createDataFrame(rows, SCHEMA)))
    ends = hashlib.sha256(",".join(map(str, turnless)).encode()).hexdigest()
    assert root == (turnless[0], 0, None, 5, 0, 1, 0, ends)


def test_empty_table(spark):
    assert s.nodes(spark.createDataFrame([], SCHEMA)).collect() == []
