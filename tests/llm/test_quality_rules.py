import random
import re

from releaselens.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    places = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(places)


def test_counts_against_brute_force(table):
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\nx\n\nx\n \n", "é é \U0001f600|#\x0b\x0c."]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(400))) for _ in range(60)]
    texts.append(" ".join(f"w{i % 700}" for i in range(20_000)))
    rows = {r["doc_id"]: r for r in q.judge(table(texts, clash=True), keep=["doc_id"]).select("doc.doc_id", "*").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts[:-1]):
        r = rows[i]
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert found == brute(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert rows[len(texts) - 1]["n_repeat_words"] == 20_000


def quartile(sorted_values, k):
    buckets = []
    for v in sorted_values:
        low = max(0, v.bit_length() - q.BITS)
        buckets.append(v >> low << low)
    buckets.sort()
    return next(b for i, b in enumerate(buckets, 1) if 4 * i >= k * len(buckets))


def test_thresholds_follow_group_sketches(spark, table):
    rng = random.Random(2)
    texts, langs, sources = [], [], []
    for i in range(300):
        n = rng.randrange(60, 120)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        texts.append(" ".join(words))
        langs.append(None if i % 3 == 0 else "en")
        sources.append(None if i % 2 else "big")
    texts.append("only one of its language " * 3 + " ".join(f"u{i}" for i in range(60)))
    langs.append("xx")
    sources.append("alone")
    df = q.judge(table(texts, langs=langs, sources=sources)).select("doc.doc_id", "doc.lang", "doc.source", "*")
    rows = df.collect()
    assert len(rows) == len(texts)
    groups = {}
    for r in rows:
        if not r["base_failed"]:
            for key in ((r["lang"], r["source"]), r["lang"], "every"):
                groups.setdefault(("k", key), []).append(r)
    for r in rows:
        if r["base_failed"]:
            assert not r["kept"]
            continue
        own = next(
            g
            for key in ((r["lang"], r["source"]), r["lang"], "every")
            if len(g := groups[("k", key)]) >= q.MIN_DOCS or key == "every"
        )
        kept = True
        for m, (least, low) in q.RULES.items():
            values = sorted(x[m] for x in own)
            q1, q3 = quartile(values, 1), quartile(values, 3)
            far = max(q.FENCE * (q3 - q1), least)
            kept &= r[m] <= q3 + far and (not low or r[m] >= q1 - far)
        assert r["kept"] == kept
    bad = {r["doc_id"] for r in rows if not r["kept"]}
    assert {i for i in range(0, 300, 20)} <= bad and len(bad) < 25


def test_sketches_merge(table):
    df = q.measures(table(["a b c " * k for k in range(1, 40)], sources=[str(k % 3) for k in range(39)]))
    df = df.select("doc.source", "*")
    merged = q.merge(q.sketches(df, ["source"]), []).collect()
    whole = q.sketches(df, []).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, whole))


def test_kept_rows_keep_columns(table):
    df = table([" ".join(f"w{i}{k}" for k in range(60)) for i in range(5)] + [None], clash=True)
    out = q.kept_rows(df)
    assert out.columns == df.columns and out.count() == 5
    assert q.kept_rows(df.limit(0)).count() == 0
