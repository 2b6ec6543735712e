import random

import pytest

from releaselens.llm import line_dedup as s


def brute(rows, min_chars=s.MIN_CHARS, min_docs=s.MIN_DOCS):
    """(id, lines, dropped, kept text) of each row; None sorts before all ids."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    order = lambda i: (i is not None, i or 0)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            lost = len(k) >= min_chars and len(holders[k]) >= min_docs and i != min(holders[k], key=order)
            kept += [] if lost else [line]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()], key=repr)


def texts_for(seed):
    rng = random.Random(seed)
    pool = ["A common LINE of text", "a common line of text", "  a common line of text\t\r", "short", "ÉÉÉÉÉÉÉÉÉÉ lange", "éééééé"]
    pool += [" a common line of text", "İstanbul line one", "ninechars", "tenchars10", "日本語日本語日本語日", "日本語日本語日本語", ""]
    pool += [f"line number {k} of the pool" for k in range(30)]
    out = [None, "", "\n", "\n\n\n", "tenchars10", " TENCHARS10 "]
    for _ in range(80):
        out.append("\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))))
    out.append("\n".join(["a very long document's line"] * 20_000 + ["its end is here"]))
    out.append("x" * 200_000 + "\na very long document's line\n")
    return out + rng.sample(out[6:], 8)


@pytest.mark.parametrize("min_docs", [2, 3, 7])
def test_against_brute_force(table, min_docs):
    texts = texts_for(min_docs)
    df = s.drop_recurring_lines(table(texts, clash=True), min_docs=min_docs)
    assert got(df) == brute(list(enumerate(texts)), min_docs=min_docs)


def test_repeated_rows_null_ids_and_ties(table):
    rows = [(7, "one shared line\nmine"), (7, "one shared line\nmine"), (7, "another text\none shared line"), (9, "one shared line")]
    rows += [(3, "only twice in one\nonly twice in one"), (None, "held by no name\nx"), (None, "held by no name"), (5, "HELD BY NO NAME")]
    df = s.drop_recurring_lines(table([t for _, t in rows], [i for i, _ in rows]))
    assert got(df) == brute(rows)
    assert (7, 2, 0, "one shared line\nmine") in got(df) and (5, 1, 1, "") in got(df)


def test_empty_table(table):
    assert s.drop_recurring_lines(table(["a"]).limit(0)).collect() == []


def test_text_and_id_of_other_names_and_types(table):
    df = table(["the same line again", "the same line again"]).selectExpr("cast(doc_id as int) as `my.id`", "text as `a text`")
    out = got(s.drop_recurring_lines(df, "a text", "my.id"))
    assert out == [(0, 1, 0, "the same line again"), (1, 1, 1, "")]
