import random
from collections import Counter

import numpy as np
import pytest

from releaselens.llm import suffix_dedup as s


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), [tuple(x) for x in edges.reshape(-1, 2).tolist()], kept))
    return out


def test_suffix_array_against_sorting():
    rng = random.Random(1)
    for letters in (b"ab", b"abc\xff", bytes(range(256))):
        for n in (0, 1, 2, 30, 400):
            data = bytes(rng.choice(letters) for _ in range(n))
            order = s.suffix_array(data, 500)
            assert order.tolist() == sorted(range(n), key=lambda p: data[p:])
            lcp = s.common_prefixes(data, order, 500)
            for k in range(1, n):
                a, b = data[order[k - 1] :], data[order[k] :]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                # the padding after the data is zero bytes, which may lengthen a prefix that reaches the end
                assert lcp[k] >= same if same == min(len(a), len(b)) else lcp[k] == same


def texts_for(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    passage = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    out = [None, "", "a", "a" * (length - 1), "b" * length, "c" * (length + 1), "c" * (3 * length), "xy" * length]
    for _ in range(60):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(word() for _ in range(15)) for _ in range(4)]
        out.append(" ".join(parts))
    out += rng.sample(out[8:], 10)
    # near copies: one letter changed
    for t in rng.sample(out[8:60], 10):
        at = rng.randrange(len(t))
        out.append(t[:at] + "Z" + t[at + 1 :])
    out.append(("lorem %d " * 40) % tuple(range(40)) + ("lorem %d " * 40) % tuple(range(40)))
    return out


@pytest.mark.parametrize("hot", [s.HOT, 1])
@pytest.mark.parametrize("length", [64, 100])
def test_removed_bytes_against_brute_force(table, hot, length):
    texts = texts_for(length, length)
    rows = s.remove_repeats(table(texts, clash=True), length=length, hot=hot).collect()
    want = brute(texts, length)
    assert len(rows) == len(texts)
    for r in rows:
        n, gone, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"]) == (n, gone), texts[r["doc_id"]]
        assert [(x["start"], x["end"]) for x in r["spans"]] == spans
        assert bytes(r["kept"]) == kept


def test_equal_rows_null_ids_and_empty_table(table):
    t = " ".join(f"w{i}" for i in range(200))
    rows = s.remove_repeats(table([t, t, t, "short", t + " more"], [4, 4, None, None, 9])).collect()
    assert sorted(r["n_bytes"] - r["n_removed"] for r in rows) == [0, 0, 0, 5, 5]
    assert s.remove_repeats(table(["a"]).limit(0)).count() == 0


def test_runs_cover_each_window_once():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcdef ") for _ in range(n)) for n in (10, 399, 400, 401, 3000)] + [b"z" * 2000]
    got = Counter()
    for i, _, _, lo, n, _ in s.runs_of(texts):
        for p in range(lo, lo + n):
            got[i, p] += 1
    assert got == Counter({(i, p): 1 for i, t in enumerate(texts) for p in range(len(t) - s.LENGTH + 1)})
