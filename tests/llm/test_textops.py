import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadloom.llm import textops as T

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SPECIAL = "<|endoftext|>"
alphabet = st.sampled_from(list("aZé1٣ \n\t 　'!<|>.strvedlm\U0001f600ß") + [SPECIAL, "'s", "'re", "  ", "'ll"])


def expected(text):
    """Pieces as the library splits them, special strings apart."""
    out = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(SPECIAL)
        if part:
            out += [part[a:b] for _, (a, b) in TOK.pre_tokenizer.pre_tokenize_str(part)]
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(alphabet, max_size=14).map("".join), max_size=6))
def test_pieces_are_the_librarys(texts):
    got, counts = T.pieces(pa.array(texts, pa.string()), (SPECIAL,))
    got, ends = got.to_pylist(), np.cumsum(counts)
    assert [got[e - c : e] for c, e in zip(counts, ends)] == [expected(t) for t in texts]


def test_classes_are_the_librarys():
    table = T.classes()
    step = [*range(0x3400), *range(0x3400, 0x110000, 37)]
    for i in (i for i in step if not 0xD800 <= i < 0xE000):
        c = chr(i)
        own = "LNSO"[table[i]]
        alone = {"L": "a", "N": "1", "S": "\n", "O": "!"}[own]
        assert len(TOK.pre_tokenizer.pre_tokenize_str(alone + c)) == 1, hex(i)


def brute_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


@given(st.lists(st.none() | st.text("ab \n\tÉ\x1c ", max_size=40), max_size=6))
def test_shingle_counts(texts):
    w, c = T.words(pa.array(texts, pa.string()))
    _, n = T.shingle_sets(T.word_hashes(w), c)
    assert n.tolist() == [len(brute_sets(t)) for t in texts]


def test_slices():
    texts = ["é à  b" * k for k in range(40)] + [None, " ü"]
    whole = T.words(pa.array(texts))
    parts = [T.words(p) for _, p in T.chunks(pa.array(texts), 50)]
    assert len(parts) > 5 and [w for p in parts for w in p[0].to_pylist()] == whole[0].to_pylist()
    assert np.concatenate([p[1] for p in parts]).tolist() == whole[1].tolist()


@pytest.mark.parametrize("texts", [[], [None], ["", None, ""]])
def test_nothing(texts):
    assert T.pieces(pa.array(texts, pa.string()))[1].tolist() == [0] * len(texts)
    assert [x for _, a in T.chunks(pa.array(texts, pa.string())) for x in a.to_pylist()] == texts


def test_gather():
    assert T.gather(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_workers_keep_no_caches_of_other_tasks():
    import pyarrow as pa

    from roadloom.llm import bpe, textops
    from roadloom.llm.queries import BYTE_BPE

    spec = bpe.tokenizer_json(BYTE_BPE)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    own = bpe.encoder(spec)
    assert list(textops.freed(lambda batches: batches, bpe.encoder)(iter([batch]))) == [batch]
    assert bpe.encoder(spec) is own  # a task that needs it finds it again
    assert list(textops.freed(lambda batches: batches)(iter([batch, batch]))) == [batch, batch]
    assert bpe.encoder.cache_info().currsize == 0
