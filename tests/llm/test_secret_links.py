import hashlib
import random
import re

from releaselens.llm import secret_links as s

KEY = "A" + "KIA" + "QWERTYUIOP12345"


def brute(text):
    """Plain matching of each base kind, leftmost and non-overlapping, then dropping."""
    text, out = text or "", []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in (
        "password", "passwd", "secret", "token"))
    key += "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 16:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 32:
            out.append((m.start(), 2, "hex", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_against_brute_force(table):
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", ' "', "'", "abcdefgh", "xyz", KEY,
            "AKIA", "AKIAQ", "0123456789abcdef" * 2, "deadbeef", " ", "é", "\n", "\U0001f600", "ſecret", "toKen"]
    texts = [None, "", "token: secret: abcdefgh", "password: token=abcdefghijk"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = s.digest(s.scan(table(texts).select("doc_id", "text"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in s.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) or not want


BLOB = "Zx9" + "kQ2mN8" * 5


def test_weak_parts_need_their_complement(table):
    far = " filler" * 100
    texts = [
        f"blob {BLOB} alone",  # 0: nothing
        f"user=alice {BLOB}",  # 1: identifier and secret
        f"user=alice{far} {BLOB}",  # 2: out of scope
        f"{KEY} and {BLOB}",  # 3: strong identifier with a weak secret
        f"https://db.example/x user=alice {BLOB}",  # 4: all three
        "https://db.example/x user=alice",  # 5: no secret
        f"https://db.example/x {BLOB}",  # 6: no identifier
        f"{BLOB} then user=alice",  # 7: the other order
    ]
    rows = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in s.scan(table(texts)).collect()}
    assert rows == {
        0: [], 1: ["key_id", "blob"], 2: [], 3: ["access", "blob"], 4: ["endpoint", "key_id", "blob"], 5: [], 6: [],
        7: ["blob", "key_id"],
    }


def brute_links(spans, scope):
    out = set()
    for x in spans:
        roles = {
            s.ROLES[y[0]]
            for y in spans
            if s.ROLES[y[0]] != s.ROLES[x[0]]
            and (x[1] <= y[1] <= x[2] + scope or y[1] <= x[1] <= y[2] + scope)
        }
        need = {"id": {"secret"}, "secret": {"id"}, "endpoint": {"id", "secret"}}[s.ROLES[x[0]]]
        if x[0] in s.WEAK and need <= roles:
            out.add(x)
    return out


def test_links_against_all_pairs(table):
    rng = random.Random(4)
    parts = ["user=alice ", f"{BLOB} ", "https://h.example/p ", f"{KEY} ", "password=12345678 "]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.2 else "word " * rng.randrange(30) for _ in range(60)) for _ in range(20)]
    texts += [texts[0], "user=bob " + "é" * 5000 + f" {BLOB}", f"{BLOB} " * 800 + "user=alice"]
    rows = s.scan(table(texts)).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        base = s.base_spans(text)
        want = set(base) | brute_links(base + s.weak_spans(text, base), s.SCOPE)
        assert [(x["kind"], x["start"], x["end"]) for x in r["spans"]] == sorted(
            want, key=lambda x: (x[1], s.KINDS.index(x[0]))
        )


def test_redaction_keeps_rows_and_columns(table):
    texts = [f"é {KEY} x password={KEY} y", "clean", None, "", f"user=alice {BLOB}"]
    df = table(texts, [1, 1, None, 3, 4], clash=True)
    out = s.redact(df)
    assert out.columns == df.columns
    got = sorted((r["text"] for r in out.collect()), key=str)
    assert got == sorted(["é [REDACTED] x [REDACTED] y", "clean", None, "", "[REDACTED] [REDACTED]"], key=str)
    assert s.redact(df.limit(0)).count() == 0
    found = s.scan(df)
    assert set(found.columns) >= set(df.columns) - {"text"} and found.count() == 5
    assert s.scan(df.limit(0)).count() == 0


def test_masking_is_linear_in_a_long_text(table):
    part = f"{KEY} é filler words "
    text = part * (5_000_000 // len(part))
    assert s.redact(table([text])).first()["text"] == "[REDACTED] é filler words " * (5_000_000 // len(part))


def test_overlapping_spans_are_masked_once():
    assert s.masked("abcdefgh", [1, 2, 5], [4, 3, 6], "*") == "a*e*gh"
    assert s.masked("abc", [], [], "*") == "abc"
