import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from roadloom.llm import langid

from .conftest import SF


@given(st.lists(st.integers(0, 2), max_size=14))
def test_suffix_automaton(text):
    moves = langid.suffix_automaton(text)
    found, todo = set(), [((), 0)]
    while todo:
        path, s = todo.pop()
        found.add(path)
        todo += [((*path, c), t) for c, t in moves[s].items()]
    assert found == {tuple(text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1)}


def brute_phrases(sample, text):
    """Longest matches, a letter that never occurs being a phrase of its own; lanes of LANE symbols."""
    n = 0
    for a in range(0, len(text), langid.LANE):
        lane, cur = text[a : a + langid.LANE], ""
        for c in lane:
            if cur + c in sample and c not in "?":
                cur += c
            else:
                n += 1
                cur = c if c in sample and c != "?" else ""
        n += 1
    return n


@pytest.mark.parametrize("dense", [langid.DENSE, 0])
def test_phrases(dense):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    samples = {"aa": " ".join(word("abcd") for _ in range(60)), "bb": " ".join(word("bcde") for _ in range(60))}
    model = langid.fit(list(samples.items()), dense)
    texts = [" ".join(word("abcdexé") for _ in range(n)) for n in (1, 5, 300, 900)] + ["", None]
    got, size, letters = langid.phrases(model, pa.array(texts))
    for k, t in enumerate(texts):
        t = (t or "").replace("x", "?").replace("é", "?")
        assert got[k].tolist() == [brute_phrases(samples[s], t) for s in ("aa", "bb")]
        assert size[k] == len(t) and letters[k] == len(t.replace(" ", ""))


def test_many_letters_and_unequal_samples(spark):
    """Large alphabets have a model, and a language of few labelled rows is found as well as others."""
    rng = random.Random(2)
    alphabets = {f"l{k}": [chr(0x4E00 + 1500 * k + j) for j in range(3000)] for k in range(6)} | {"few": list("abcdefghij"), "many": list("hijklmnopq")}
    words = {k: ["".join(rng.choices(a, k=rng.randint(2, 5))) for _ in range(300)] for k, a in alphabets.items()}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    model = langid.fit([(k, text(k, 40)) for k in alphabets for _ in range(2 if k == "few" else 150)])
    assert model.keys is not None
    rows = [(k, text(k, 60)) for k in alphabets for _ in range(10)]
    got = langid.predict(spark.createDataFrame(rows, "lang string, text string"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_letters_are_lowered_alike():
    sample = "\u0130stanbul \u03a3\u039f\u03a6\u039f\u03a3 stra\u00dfe"
    model = langid.fit([("x", sample)])
    found, size, _ = langid.phrases(model, pa.array([sample]))
    assert found[0, 0] == 1 and size[0] > 10


def test_query(spark, documents):
    got = langid.identify(documents)
    rows = got.collect()
    truth = {r.doc_id: r for r in documents.collect()}
    assert len(rows) == documents.count()
    right = total = 0
    for r in rows:
        d = truth[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.held_out and d.lang and r.doc_id >= 0:
            total += 1
            right += r.lang_pred == d.lang
    assert right / total > 0.95
    assert langid.identify(documents.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(documents, langid.fit([])).collect()} == {"und"}


def test_labels_of_held_out_rows_are_not_used(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(spoilt).collect()))
