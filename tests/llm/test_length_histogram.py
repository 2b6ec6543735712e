from releaselens.llm import length_histogram as h
from releaselens.llm.encoding import Encoder, vocabulary

NAME = "byte_bpe_50k.json"


def test_every_limit_against_brute_force(table):
    texts = [None, "", "a", "a", "the cat\n\nsat", "x " * 40, "x " * 40, "word " * 900]
    docs = table(texts, clash=True)
    n = [len(Encoder(vocabulary(NAME)).direct([t or ""])[0]) // 4 for t in texts]
    out = h.limits(h.lengths(docs, NAME)).cache()
    rows = {r["length"]: r for r in out.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == {k: n.count(k) for k in set(n)}
    for k, r in rows.items():
        assert r["docs_upto"] == sum(x <= k for x in n) and r["docs_over"] == sum(x > k for x in n)
        assert r["tokens_upto"] == sum(x for x in n if x <= k)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n)
        assert r["lost_tokens"] == sum(max(0, x - k) for x in n)
        assert r["quantile"] == r["docs_upto"] / len(n)
    for limit in range(0, max(n) + 3, 7):
        want = {"docs_over": sum(x > limit for x in n), "truncated_tokens": sum(min(x, limit) for x in n)}
        assert h.totals_at(out, limit) == want
    assert h.quantile(out, 0.5) == sorted(n)[3]


def test_empty_table(table):
    assert h.limits(h.lengths(table(["a"]).limit(0), NAME)).count() == 0
