import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from releaselens.llm import periodic_runs as s


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(words, least=s.LEAST, times=s.TIMES):
    """All runs by trying each period at each place."""
    n, out = len(words), set()
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and smallest_period(words[i : i + length]) == q:
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def texts_for(seed, many=120):
    rng = random.Random(seed)
    out = [None, "", " \n", "a", "a " * 6, "a " * 5, "ab " * 3000, "a b " * 200 + "c " + "a b " * 200, "a b " * 8]
    for _ in range(many):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        parts = []
        for _ in range(rng.randrange(1, 6)):
            block = [rng.choice(letters) for _ in range(rng.randrange(1, 7))]
            parts += block * rng.randrange(1, 9) if rng.random() < 0.7 else block
        if rng.random() < 0.3:
            parts = parts * 4
        out.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return out


@pytest.mark.parametrize("least, times", [(6, 4), (2, 3), (9, 4), (6, 5)])
def test_runs_against_brute_force(least, times):
    texts = [(t or "").encode().split() for t in texts_for(least + times, 400) if not t or len(t) < 1500]
    for words, runs in zip(texts, s.runs_of(texts, least, times)):
        assert runs == brute(words, least, times), words


def test_suffixes_against_sorting():
    rng = np.random.default_rng(3)
    for n in (2, 3, 50, 300):
        words, owner = rng.integers(0, 3, n), np.sort(rng.integers(0, 3, n))
        order, lcp = s.suffixes(words, owner)
        pairs = list(zip(owner.tolist(), words.tolist()))
        assert order.tolist() == sorted(range(n), key=lambda i: pairs[i:])
        for k in range(n - 1):
            a, b = pairs[order[k] :], pairs[order[k + 1] :]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_digest_against_brute_force(table):
    texts = texts_for(1)
    rows = {r["doc_id"]: r for r in s.digest(s.find_runs(table(texts, clash=True), loop=True)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        words = looped(i, (t or "").encode().split())
        runs = brute(words) if len(words) < 1500 else [(0, 3000, 1)]
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want = [len(runs), None, None, None, None]
        if runs:
            a, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            want[1:] = [a, n, q, 1000 * n // q]
        spelt = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want += [hashlib.sha256(x).hexdigest() for x in (spelt.encode(), kept)]
        assert list(rows[i])[1:] == want, (i, t)


def test_repeated_rows_null_ids_and_empty_table(table):
    t = "x y " * 5
    out = s.find_runs(table([t, t, t, "z"], [None, 4, 4, None])).collect()
    assert sorted((r["doc_id"] is None, len(r["runs"])) for r in out) == [(False, 1), (False, 1), (True, 0), (True, 1)]
    assert {r["collapsed"] for r in out} == {"x y", "z"}
    assert s.digest(s.find_runs(table(["a"]).limit(0), loop=True)).collect() == []


def test_a_very_long_text(table):
    block = " ".join(f"w{i}" for i in range(5000))
    text = "start " + " ".join([block] * 30) + " end " + "u v " * 100_000
    (row,) = s.find_runs(table([text])).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 150_000, 5000), (150_002, 200_000, 2)]
    assert row["collapsed"] == f"start {block} end u v"
