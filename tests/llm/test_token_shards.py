import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from releaselens.llm import token_shards as t
from releaselens.llm.encoding import Encoder, vocabulary

VOCAB = "word_bpe_49k.json"


def sample(seed, n):
    rng = random.Random(seed)
    words = ["The", "café", "don't", "x y", "9.99", "\U0001f600", "re-", "ÉTÉ,", "Á", "zu!?"]
    space = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", " "]
    return ["".join(rng.choice(words) + rng.choice(space) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name", [VOCAB, "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    e = Encoder(vocabulary(name), kept=50)
    texts = sample(3, 400) + ["", " ", "\n", "a<|endoftext|>b", "w" * 500, " ".join(f"q{i}" for i in range(300))]
    assert [e.encode(x) for x in texts] == e.direct(texts)
    assert e.joins_blank is not None and e.encode(None) == b""


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_as_in_a_fresh_tokenizer(name):
    fresh, e = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name))
    tokens = [t.content for t in fresh.get_added_tokens_decoder().values()]
    texts = sample(5, 50)
    for token in tokens:
        texts += [token, f"hello {token} x", f"a{token}b  c", f" {token}\n{token} {token.upper()}", token[:-1], f"{token[1:]} <| |>"]
        texts += [f"{x[:40]}{token}{x[40:]}" for x in sample(6, 20)]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == fresh.encode(x, add_special_tokens=False).ids, x
    assert tokens


def test_coder_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 511, 512, 513, 5000, 140_000):
        ids = np.minimum(rng.geometric(0.02, n) - 1, 999).astype(np.uint32)
        counts = np.bincount(ids, minlength=1000)
        freq = t.normalised(counts)
        assert not n or freq.sum() == 1 << t.SCALE
        assert ((freq > 0) == (counts > 0)).all()
        coder = t.Coder(freq)
        docs = np.array([(7, False, n)], t._DOC)
        data = t.shard_bytes(coder, 1, 40, docs, ids)
        start, back, found = t.read_shard(coder, 1, data)
        assert start == 40 and (found == ids).all() and back["n"][0] == n
        for a, b in ((0, n), (n // 3, n // 2), (n - 1, n), (n, n)):
            if 0 <= a:
                assert (t.decode_range(coder, data, a, b) == ids[a:b]).all()
    assert len(data) < 2 * n  # under the 16 bits of a plain id
    spoilt = bytearray(data)
    spoilt[-5] ^= 1
    with pytest.raises(ValueError):
        t.read_shard(coder, 1, bytes(spoilt))
    with pytest.raises(ValueError):
        t.read_shard(coder, 2, data)


def test_rare_ids_keep_a_place():
    counts = np.zeros(70_000, np.int64)
    counts[:60_000] = 1
    counts[5] = 10**12
    freq = t.normalised(counts)
    assert freq.sum() == 1 << t.SCALE and (freq[:60_000] > 0).all()


def test_files_against_brute_force(spark, table):
    texts = [*sample(4, 50), None, "", "word " * 3000, "same", "same"]
    ids = [*range(100, 150), 3, 2, 1, 7, 7]
    docs = table(texts, ids, clash=True)
    path = t.write_shards(docs, VOCAB, 2, shard_tokens=500)
    rows = t.read_shards(spark, path).collect()
    e, at = Encoder(vocabulary(VOCAB)), 0
    want = []
    for doc, text in sorted(zip(ids, texts), key=lambda x: x[0]):
        data = e.direct([text or ""])[0] + b"\x02\0\0\0"
        want.append((doc, at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in rows) == sorted(want)


def test_null_ids_come_first_and_empty_tables(spark, table):
    path = t.write_shards(table(["a", "b"], [5, None]), VOCAB, 2)
    assert {(r["doc_id"], r["start"]) for r in t.read_shards(spark, path).collect()} == {(None, 0), (5, 2)}
    empty = t.write_shards(table(["a"]).limit(0), VOCAB, 2)
    assert t.read_shards(spark, empty).count() == 0


@pytest.mark.parametrize("vocab", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kept", [3, 1_000_000])
def test_encoder_with_few_kept_units_and_odd_spaces(vocab, kept):
    from releaselens.llm.encoding import KEPT_CHARS, Encoder, _odd_space, _OTHER_SPACE, vocabulary

    code = Encoder(vocabulary(vocab), kept)
    long = "x" * (KEPT_CHARS + 1)
    texts = ["a new Word, café Öl.", "a a a new\nWord 7-up", f"{long} a {long}", "a  b", "a\x0bb", "a\x85b é", "a b", "世 a　b"]
    for _ in range(2):
        assert [code.encode(t) for t in texts] == code.direct(texts)
    assert max(len(code.units), len(code.words)) <= kept and long not in code.words
    assert [_odd_space(t) for t in texts] == [bool(_OTHER_SPACE.search(t)) for t in texts]


@pytest.mark.parametrize("vocab", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_with_marks_need_no_whole_library(vocab):
    """Each kind of word with marks goes to the model alone; a word is learned once, whatever texts hold it."""
    from releaselens.llm.encoding import Encoder, vocabulary

    code, whole = Encoder(vocabulary(vocab)), Encoder(vocabulary(vocab))
    marks = ["", ",", "...", "###", "$$$", ".&&&", ",%%%", "*!?;:", "#1", "'s", "-", "###x"]
    words = ["word", "Word", "caf" + chr(0xE9), "A" + chr(0xDF), "z" + chr(0x131), "\u03a3\u03a3", "7", "x" * 70]
    units = [w + m for w in words for m in marks] + ["###", "."]
    texts = [" ".join(units), "\n".join(units), "  ".join(units), *units]
    direct, asked = code.direct, []
    code.direct = lambda found: (asked.extend(found), direct(found))[1]
    assert [code.encode(t) for t in texts] == whole.direct(texts)
    plain = {lead + w + m for lead in ("", " ", "\n") for w in words[:4] for m in marks[:8]}
    assert asked and not plain & set(asked)


def test_batches_are_cut_by_the_bytes_of_their_values():
    import pyarrow as pa

    from releaselens.llm.common import by_bytes

    texts = ["a" * 4, None, chr(0xE9) * 3, "", "b" * 20, "c"]
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        batch = pa.record_batch([pa.array([None if t is None else t.encode() for t in texts], pa.binary()).cast(kind)], ["t"])
        cut = [b.num_rows for b in by_bytes(iter([batch.slice(0, 3), batch.slice(3)]), "t", 8)]
        assert cut == [2, 1, 2, 1]
