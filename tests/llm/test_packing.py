"""Packing against plain best fit, the tokenizer on whole texts and the rules of the contract."""

import random
import zlib

import numpy as np
import pytest

from clipgrove.llm import packing, queries


def plain_best_fit(lengths, size):
    windows = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [w for w in windows if size - sum(lengths[k] for k in w) >= lengths[i]]
        if fit:
            min(fit, key=lambda w: size - sum(lengths[k] for k in w)).append(i)
        else:
            windows.append([i])
    return windows


def test_best_fit_is_the_plain_one():
    rng = random.Random(3)
    for size in (1, 7, 16, 50):
        for _ in range(60):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 40))]
            fill = lambda ws: sorted(sum(lengths[i] for i in w) for w in ws)  # noqa: E731 which of two equally full windows is taken changes no sum
            assert sorted(i for w in packing.best_fit(lengths, size) for i in w) == list(range(len(lengths)))
            assert fill(packing.best_fit(lengths, size)) == fill(plain_best_fit(lengths, size))


@pytest.mark.parametrize("slack", [0, 3])
def test_every_id_once_and_little_padding(slack):
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.choice([1, rng.randint(1, 64), rng.randint(1, 300)]) for _ in range(rng.randint(0, 60))]
        seen = {}
        for s in packing.pack(lengths, 64, slack):
            n = sum(x for *_, x in s)
            assert 1 <= n <= 64 and (not n & n - 1 or 64 - n <= slack)
            for i, a, k in s:
                assert k > 0
                seen.setdefault(i, []).append((a, k))
        for i, n in enumerate(lengths):
            at = 0
            for a, k in sorted(seen[i]):
                assert a == at
                at += k
            assert at == n


def held(spark, df, tmp_path, **kw):
    from tokenizers import Tokenizer

    window = packing.Window(queries.TOKENS().tokenizer, **kw)
    path = str(tmp_path / "w")
    packing.write_windows(df, path, window)
    tok = Tokenizer.from_file(window.tokenizer)
    rows = df.select("doc_id", "text").collect()
    want = sorted([tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows])
    sequences = packing.read_windows(spark, path).collect()
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    docs = {}
    for s in sequences:
        at = 0
        for k, p in enumerate(s.pieces):
            assert p.offset == at and p.length > 0
            docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, s.ids[at:at + p.length]))
            at += p.length
        n = len(s.ids)
        assert n in (at, window.size) and (n == window.size or not n & n - 1) and set(s.ids[at:]) <= {window.pad}
    return rows, want, docs, path, sequences


def test_files_hold_whole_texts(spark, documents, tmp_path):
    rows, want, docs, path, sequences = held(spark, documents, tmp_path)
    got = []
    for (_, total), parts in docs.items():
        parts.sort()
        assert sum(len(x) for _, x in parts) == total and [a for a, _ in parts] == [sum(len(x) for _, x in parts[:k]) for k in range(len(parts))]
        got.append(tuple(i for _, x in parts for i in x))
    assert sorted(got) == want
    padding = sum(len(s.ids) - sum(p.length for p in s.pieces) for s in sequences)
    assert padding < 0.005 * sum(map(len, want))
    digests = {(r.doc_id, r.start): r for r in packing.piece_digests(spark, path).collect()}
    assert len(digests) == sum(len(s.pieces) for s in sequences)
    for s in sequences:
        for p in s.pieces:
            r = digests[p.doc_id, p.start]
            assert r.ids_crc32 == zlib.crc32(np.array(s.ids[p.offset:p.offset + p.length], "<u4").tobytes())
            assert (r.length, r.doc_tokens, r.sequence_id, r.offset) == (p.length, p.doc_tokens, s.sequence_id, p.offset)


def test_odd_rows_small_groups_and_empty_tables(spark, odd, empty, tmp_path):
    twice = odd.select("doc_id", "text", "id").unionByName(odd.selectExpr("cast(null as long) as doc_id", "text", "id"))
    _, want, docs, _, _ = held(spark, twice, tmp_path, size=64, ids=100, pieces=2)
    assert sum(len(x) for parts in docs.values() for _, x in parts) == sum(map(len, want))
    packing.write_windows(empty, str(tmp_path / "none"), packing.Window(queries.TOKENS().tokenizer))
    assert packing.piece_digests(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        packing.Window("", size=100)
