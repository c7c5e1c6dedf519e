import zlib

import numpy as np
import pyarrow as pa
import pytest

from clipgrove.llm import queries, tokenfiles as T
from clipgrove.llm.words import text_slices


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENS().tokenizer)


TEXTS = ["The cat, the CAT. it's 12,000 x\x1cy a\x85b c d", "É été. Ⅷ ǅ İ ﬁ é. ≮ 日本 😀👍🏽 <|endoftext|> a<|startoftext|>b", "", " \t\n", "don't. we'll, 'S. A.B. a.. ,a ., é, —,",
         "x" * 5000, "ab " * 4000, "\x00\x01 \x7f"]


def test_words_have_the_ids_of_whole_texts(tok, documents):
    texts = TEXTS + [r.text for r in documents.select("text").limit(120).collect()]
    enc = T.Encoder(T.Settings(queries.TOKENS().tokenizer, cache=300))  # small: forgets again and again
    got = []
    for _, _, data, offs in text_slices(pa.array(texts), 4096):
        ids, at = enc.encode(data, offs)
        got += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def morse(n, a, b):
    """Thue-Morse word: a classic collision of polynomial hashes."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_of_equal_hash_have_their_own_ids(tok, monkeypatch):
    texts = [f"{morse(n, 'a', 'b')} x {morse(n, 'b', 'a')} {morse(n, 'B', 'a')}" for n in (1024, 4096)] + ["one two ONE three two"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]

    def got(enc):
        out = []
        for _, _, data, offs in text_slices(pa.array(texts), 4096):
            ids, at = enc.encode(data, offs)
            out += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
        return out

    settings = T.Settings(queries.TOKENS().tokenizer, cache=300)
    assert got(T.Encoder(settings)) == want
    monkeypatch.setattr(T, "word_hashes", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3) + np.uint64(5))
    enc = T.Encoder(settings)
    assert got(enc) == want and got(enc) == want


def test_other_kinds_of_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        T.Encoder(T.Settings(public_tokenizers.path("byte_bpe_50k.json")))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    s = T.Settings("", least=2, per_round=50, gain=0.0)
    docs = [rng.choice(12, n, p=np.r_[[0.3, 0.2], [0.05] * 10]).astype(np.uint16) for n in (0, 1, 2, 700, 0, 3000)] + [np.zeros(999, np.uint16)]
    mark = np.array([T.MARK], np.uint16)
    seq = np.concatenate([x for d in docs for x in (d, mark)])
    short, rules = T.repair(seq, 100, s)
    length, _ = T.expansions(rules, 100)
    assert len(short) < len(seq) / 2 and (short == T.MARK).sum() == len(docs)
    offset = np.concatenate([[0], np.flatnonzero(short == T.MARK) + 1]).astype(np.uint32)
    shard = T.Shard({"base": 100, "end_id": 1, "symbols": short.tobytes(), "rules": rules.tobytes(), "rule_lengths": length[100:].astype(np.uint32).tobytes(), "offsets": offset.tobytes()})
    ids, at = shard.whole()
    for i, d in enumerate(docs):
        want = [*d.tolist(), 1]
        assert shard.tokens(i).tolist() == ids[at[i]:at[i + 1]].tolist() == want
        assert [shard.token(i, k) for k in range(0, len(want), 97)] == want[::97] and shard.token(i, len(d)) == 1


def test_files(spark, tok, odd, empty, tmp_path):
    s = T.Settings(queries.TOKENS().tokenizer, shard=2000)
    docs = odd.drop("position").withColumn("position", -odd.doc_id)
    T.write_tokens(docs, f"{tmp_path}/a", s)
    want, at = {}, 0
    for r in sorted(odd.select("doc_id", "text").collect(), key=lambda r: -r.doc_id):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.token_digests(spark, f"{tmp_path}/a").collect()} == {k: v[:3] for k, v in want.items()}
    assert {r.doc_id: r.tokens for r in T.read_tokens(spark, f"{tmp_path}/a").collect()} == {k: v[3] for k, v in want.items()}
    T.write_tokens(empty, f"{tmp_path}/b", s)
    assert T.token_digests(spark, f"{tmp_path}/b").count() == 0
