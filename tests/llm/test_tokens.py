import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadloom.llm import bpe, dac

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def expected(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    return [(d, t, e.ids) for (d, t), e in zip(rows, TOK.encode_batch([t for _, t in rows], add_special_tokens=False))]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("max_words", [0, 300, 500_000])
def test_bpe_is_the_librarys(documents, max_words):
    got = bpe.decode_corpus(bpe.encode_corpus(documents, PATH, max_words=max_words), PATH, out="again").collect()
    want = [(d, i, TOK.decode(i, skip_special_tokens=False)) for d, _, i in expected(documents)]
    assert sorted([(r.doc_id, r.ids, r.again) for r in got], key=key) == sorted(want, key=key)


def test_bpe_query(documents):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(t.encode())) for d, t, i in expected(documents)]
    assert sorted(map(tuple, bpe.digests(documents, PATH).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(documents.limit(0), PATH).count() == 0


def test_words_are_joined_by_the_word(monkeypatch):
    """Words that share a hash have their own ids."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "hash64", lambda words, seed=0: np.full(len(words), 7, np.uint64))
    own = bpe.Encoder(bpe.tokenizer_json(PATH))
    ids, sizes = own.words(pa.array(["alpha"]))
    table = np.array([7], np.uint64), np.array([0, len(ids)]), ids, pa.array(["alpha"])
    got, n = own.encode(pa.array(["alpha", "beta", "alpha"]), table)
    assert got.tolist() == [i for w in ("alpha", "beta", "alpha") for i in TOK.encode(w, add_special_tokens=False).ids] and n.sum() == len(got)


def test_unknown_ids_give_nothing(spark):
    ids = TOK.encode("some text", add_special_tokens=False).ids
    rows = [(1, [ids[0], 999_999, *ids[1:], 2**31 - 1, -1]), (2, None), (3, [])]
    got = bpe.decode_corpus(spark.createDataFrame(rows, "k int, ids array<int>"), PATH).collect()
    assert {r.k: r.text for r in got} == {1: "some text", 2: "", 3: ""}


@given(st.lists(st.lists(st.integers(0, 2**31), max_size=9), max_size=9))
def test_token_file(docs):
    flat = np.array([x for d in docs for x in d], np.uint32)
    t = dac.TokenFile(dac.dump(flat, [None if k == 1 else k for k in range(len(docs))], np.array([len(d) for d in docs], np.int64)))
    assert [t.token(i) for i in range(len(flat))] == flat.tolist()
    assert [t.tokens(a, b).tolist() for a, b in zip(t.starts[:-1], t.starts[1:])] == docs
    assert t.doc_ids == [None if k == 1 else k for k in range(len(docs))]


def test_rank_over_many_blocks():
    ids = np.random.default_rng(1).integers(0, 60000, 5000).astype(np.uint32) >> np.random.default_rng(2).integers(0, 16, 5000).astype(np.uint32)
    t = dac.TokenFile(dac.dump(ids, [7], np.array([5000])))
    assert all(t.token(i) == ids[i] for i in range(0, 5000, 13)) and (t.tokens(777, 4001) == ids[777:4001]).all()


def test_token_files_query(documents):
    rows = sorted(expected(documents), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for d, _, i in rows:
        i = [*i, 0]
        want.append((d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert sorted(map(tuple, dac.round_trip(documents, PATH).collect()), key=lambda r: r[1]) == want
    assert dac.round_trip(documents.limit(0), PATH).count() == 0
