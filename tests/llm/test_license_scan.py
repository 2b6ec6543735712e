import random
import re

from releaselens.llm import license_scan as l

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lower(text))
    at = []
    for phrase, label in l.BASE.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at.sort()
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force(table):
    rng = random.Random(1)
    bits = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "BY", "nc", "ÉTÉ", "x"]
    texts = [None, "", "Under the MIT License.", "cc-by-nc cc by nc", "CC BY NC" * 3]
    texts += [rng.choice([" ", "-", ", "]).join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = l.scan(table(texts, clash=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
        assert found == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_notices_are_found_in_noise_and_phrases_are_needed(table):
    noise = [" ".join(random.Random(i).choice(["the", "and", "foo", f"w{i}"]) for _ in range(200)) for i in range(40)]
    notices = [f"{noise[i]} {n} {noise[i]}" for i, (_, n, _) in enumerate(l.TEMPLATES)]
    # words of a notice in another order, and a notice without its key phrases
    mixed = [" ".join(sorted(n.split())) for _, n, _ in l.TEMPLATES]
    broken = l.TEMPLATES[0][1].replace("permission is hereby granted", "permission was granted")
    rows = {r["doc_id"]: r for r in l.scan(table([*notices, *mixed, broken, *noise])).collect()}
    for i, (label, _, _) in enumerate(l.TEMPLATES):
        assert label in rows[i]["labels"].split(","), label
        assert rows[i]["score"] >= l.AGREE
        assert rows[len(notices) + i]["labels"] == rows[len(notices) + i]["base_labels"]
    assert "mit" not in rows[2 * len(notices)]["labels"]
    assert all(rows[2 * len(notices) + 1 + i]["labels"] == "" for i in range(40))


def test_long_texts_and_empty_table(table):
    many = ("licence software redistribution permitted warranty foo " * 4000) + l.TEMPLATES[2][1]
    rows = l.scan(table([many, many])).collect()
    assert [r["labels"] for r in rows] == ["bsd", "bsd"]
    assert l.scan(table(["a"]).limit(0)).count() == 0


def test_several_notices_in_one_text_are_all_found(table):
    rng = random.Random(3)
    notices = [n for _, n, _ in l.TEMPLATES]
    rare = " ".join(w for n in notices for w in n.split() if rng.random() < 0.3)
    want = [({a, b}, f"{notices[a]} some words {notices[b]}") for a in range(8) for b in range(8) if a != b]
    want.append((set(range(8)), " end ".join(notices)))
    want += [({t}, f"{rare} {notices[t]} {rare}") for t in range(8)]
    rows = {r["doc_id"]: r for r in l.scan(table([x for _, x in want])).select("doc_id", "labels", "score", "template_places").collect()}
    for i, (which, _) in enumerate(want):
        assert {l.TEMPLATES[t][0] for t in which} <= set(rows[i]["labels"].split(",")), which
        assert len(rows[i]["template_places"]) >= len(which)
        assert rows[i]["score"] == 1.0
