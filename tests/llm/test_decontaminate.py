import os
import random
import tracemalloc

import numpy as np
import pytest

from releaselens.llm import decontaminate as d

FOLDER = "/root/testdata/sf0.001"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert d.lcs(np.array(a), np.array(b)) == brute_lcs(a, b)


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def test_copies_and_paraphrases_are_found_and_clean_rows_left(spark, table):
    rng = random.Random(2)
    words = vocabulary(rng, 1500)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [say(n) for n in (15, 20, 30, 45, 60, 80)]
    texts, planted = [], set()
    for i in range(120):
        t = say(rng.randrange(50, 400))
        if i % 3 == 0:
            k = i // 3 % len(items)
            item = items[k].split()
            if i % 2:  # a paraphrase: a tenth of the words changed, the answer kept
                for _ in range(len(item) // 10):
                    item[rng.randrange(len(item) - max(3, len(item) // 5))] = rng.choice(words)
            cut = rng.randrange(len(t.split()))
            w = t.split()
            t = " ".join(w[:cut] + item + w[cut:])
            planted.add((i, k))
        texts.append(t.upper() if i % 4 == 0 else t)
    texts += [None, "", "one", items[0], items[0]]
    n = len(texts)
    planted |= {(n - 2, 0), (n - 1, 0)}
    bench = spark.createDataFrame([*enumerate(items), (97, None), (98, " . ")], "item_id long, text string")
    docs = table(texts, clash=True)
    found = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, bench).collect()}
    assert found <= planted and len(found) >= 0.9 * len(planted)
    # every exact copy
    assert {x for x in planted if x[0] % 2 == 0 or x[0] >= n - 2} <= found
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(n)) - {i for i, _ in found}


def test_the_driver_holds_three_matrices_of_the_fit(spark):
    """Tasks' matrices are added up before they are collected; directions are those of the whole decomposition."""
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 3000, d.SEGMENT).astype(np.uint32) for _ in range(300)]
    sample = spark.createDataFrame([(bytearray(r.tobytes()),) for r in rows], "words binary").repartition(4)
    sample.count()
    idf = np.ones(d.BUCKETS, np.float32)
    tracemalloc.start()
    directions, values = d.fit(sample, idf, rank=8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 4 * d.BUCKETS * (8 + d.OVER)
    dense = np.zeros((len(rows), d.BUCKETS))
    for i, r in enumerate(rows):
        np.add.at(dense[i], r, 1 / 4)
    assert np.allclose(directions.T.astype(float) @ directions, np.eye(8), atol=1e-6)
    assert np.allclose(np.linalg.norm(dense @ directions, axis=0), values, rtol=1e-3)
    assert values[0] <= np.linalg.norm(dense, 2) * (1 + 1e-6)


def test_the_basis_is_fitted_on_every_passage(spark, monkeypatch):
    """Texts of odd lengths and items: directions are those of all their passages, however few words a task holds at once."""
    monkeypatch.setattr(d, "WORDS_AT_ONCE", 64)
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 200, n).astype(np.uint32) for n in [0, 1, 15, 16, 17, 300, *rng.integers(1, 90, 3000)]]
    items = [rng.integers(0, 200, n).astype(np.uint32) for n in (5, 16, 40)]
    table = spark.createDataFrame([(bytearray(w.tobytes()),) for w in texts], "words binary").repartition(7)
    idf = rng.uniform(1, 3, d.BUCKETS).astype(np.float32)
    directions, values = d.fit(table, idf, rank=200, items=items)
    rows = [w[at : at + d.SEGMENT] for w in texts for at in range(0, len(w), d.SEGMENT)] + items
    dense = np.zeros((len(rows), 200))
    for i, r in enumerate(rows):
        np.add.at(dense[i], r, idf[r])
    dense /= np.sqrt([(idf[r].astype(float) ** 2).sum() for r in rows])[:, None]
    assert len(rows) > 5000
    assert np.allclose(values, np.linalg.svd(dense, compute_uv=False), rtol=1e-2)
    assert np.allclose(directions.T.astype(float) @ directions, np.eye(200), atol=1e-5)


def test_a_basis_is_not_fitted_on_a_share_of_the_texts(spark, table, monkeypatch):
    """All passages of all texts reach the fit."""
    seen = []
    plain = d.fit
    monkeypatch.setattr(d, "fit", lambda t, *a, **k: seen.append(t) or plain(t, *a, **k))
    texts = [" ".join(f"w{(i * 7 + j) % 911}" for j in range(16 * 300)) for i in range(140)]
    bench = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    assert d.find_leaks(table(texts), bench).count() == 0
    words = seen[0].selectExpr("sum(length(words)) / 4").first()[0]
    assert words == 140 * 16 * 300  # 42,000 passages


def test_orthonormal_keeps_the_span():
    rng = np.random.default_rng(5)
    dense = (rng.standard_normal((d.BUCKETS, 12)) * np.logspace(0, -4, 12)).astype(np.float32)
    basis = dense.copy()
    d.orthonormal(basis)
    assert np.allclose(basis.T.astype(float) @ basis, np.eye(12), atol=1e-6)
    assert np.allclose(basis.astype(float) @ (basis.T.astype(float) @ dense), dense, atol=1e-6)
    few = np.zeros_like(dense)  # fewer rows than columns that are not zero
    few[:5] = dense[:5]
    d.orthonormal(few)
    assert np.isfinite(few).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_against_all_passages(spark):
    """Candidates of the latent search against verification of every window with every item."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r["item_id"]: d.word_hashes(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        words = d.word_hashes(r["text"])
        held = set(words.tolist())
        for i, item in items.items():
            if len(set(item.tolist()) & held) < d.LEAST * len(set(item.tolist())):
                continue
            if any(d.verify(item, words, at)[0] > 0 for at in range(0, max(1, len(words)), d.SEGMENT)):
                want.add((r["doc_id"], i))
    found = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, bench).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_words_of_odd_texts():
    rng = random.Random(3)
    marks = [chr(c) for c in (*range(1, 0x250), *range(0x2000, 0x2070), 0x3000, 0x4E16, 0x1F600, 0x661, 0xB2, 0x2167)]
    texts = [None, "", "___", "A_b c-D", "İı ẞß ǅ"] + ["".join(rng.choices(marks[:n], k=400)) for n in (40, 90, 600, len(marks)) for _ in range(20)]
    for t in texts:
        assert d.words_of(t) == (d._WORD.findall(t.lower()) if t else [])


def test_empty_tables(spark, table):
    bench = spark.createDataFrame([(1, "some words of an item here")], "item_id long, text string")
    assert d.find_leaks(table(["a"]).limit(0), bench).count() == 0
    assert d.find_leaks(table(["a b c"]), bench.limit(0)).count() == 0
    assert d.clean(table(["a b c", None]), bench.limit(0)).count() == 2
